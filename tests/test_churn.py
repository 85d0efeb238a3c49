import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from holdfast.operators import churn
from tests.helpers import as_dict

NUMBERS = [*churn.LIFETIME, *churn.RECENT]


def frame(spark, n=400, seed=3):
    """People whose churn depends on frequency and recent orders, with gaps to fill."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        freq = rng.randint(1, 9)
        recent = rng.randint(0, 3)
        recency = max(0, int(rng.gauss(260 - 20 * freq - 40 * recent, 60)))
        rows.append(
            (
                f"p{i:04d}",
                freq,
                round(rng.uniform(10, 900), 2),
                round(rng.uniform(10, 90), 2),
                1.0,
                rng.uniform(1, 2),
                rng.randint(0, 500),
                None if freq == 1 else round(rng.uniform(5, 80), 2),
                recency,
                rng.choice(["Champions", "New Customers", None]),
                float(recent * 10) if recent else None,
                float(recent * 30),
                float(recent * 60),
                recent,
                recent + 1,
                recent + 2,
                0.1,
                0.2,
            )
        )
    return spark.createDataFrame(
        rows,
        "customer_unique_id string, frequency long, monetary double, avg_order_value double, "
        "avg_items_per_order double, avg_category_diversity double, tenure_days int, "
        "avg_days_between_orders double, recency_days int, segment_name string, spend_30d double, "
        "spend_90d double, spend_180d double, orders_30d long, orders_90d long, orders_180d long, "
        "recent_order_ratio double, recent_spend_ratio double",
    )


@pytest.fixture(scope="module")
def trainable(spark):
    return churn.label_churn(churn.impute_training(frame(spark))).persist()


def test_impute_uses_medians_zeros_and_unknown(spark):
    raw = frame(spark, 50)
    rows = {r["customer_unique_id"]: r for r in churn.impute_training(raw).collect()}
    gaps = sorted(
        r["avg_days_between_orders"] for r in raw.collect() if r["avg_days_between_orders"] is not None
    )
    middle = len(gaps) // 2
    median = gaps[middle] if len(gaps) % 2 else (gaps[middle - 1] + gaps[middle]) / 2
    for before in raw.collect():
        after = rows[before["customer_unique_id"]]
        assert all(after[c] is not None for c in [*NUMBERS, "segment_name"])
        if before["avg_days_between_orders"] is None:
            assert after["avg_days_between_orders"] == pytest.approx(median)
        if before["segment_name"] is None:
            assert after["segment_name"] == "Unknown"
        if before["spend_30d"] is None:
            assert after["spend_30d"] == 0.0


def test_gap_fill_only_where_no_gap_is_known(spark):
    alone = frame(spark, 20).withColumn("avg_days_between_orders", F.lit(None).cast("double"))
    filled = churn.impute_training(alone)
    assert {r["avg_days_between_orders"] for r in filled.collect()} == {9999.0}


def test_label_at_the_threshold(spark):
    df = spark.createDataFrame([(179,), (180,), (181,), (None,)], "recency_days int")
    assert [r["churned"] for r in churn.label_churn(df).collect()] == [0, 1, 1, 0]
    assert [r["churned"] for r in churn.label_churn(df, 200).collect()] == [0, 0, 0, 0]


@pytest.mark.parametrize(
    "counts,expected",
    [
        ({0: 50, 1: 50}, {0: 40, 1: 40}),
        ({0: 7, 1: 3}, {0: 6, 1: 2}),
        ({0: 101, 1: 4}, {0: 81, 1: 3}),
        ({0: 1, 1: 9}, {0: 1, 1: 7}),
        ({0: 5}, {0: 4}),
    ],
)
def test_train_counts(counts, expected):
    assert churn._train_counts(counts, 0.2) == expected


def test_split_is_exact_stable_and_whole(trainable):
    def keys(df):
        return {r["customer_unique_id"] for r in df.select("customer_unique_id").collect()}

    train, held_out = churn.stratified_split(trainable)
    sizes = {r["churned"]: r["count"] for r in trainable.groupBy("churned").count().collect()}
    expected = churn._train_counts(sizes, 0.2)
    assert {r["churned"]: r["count"] for r in train.groupBy("churned").count().collect()} == expected
    assert len(keys(held_out)) == 80
    assert keys(train) | keys(held_out) == keys(trainable)
    assert not keys(train) & keys(held_out)
    again, _ = churn.stratified_split(trainable.repartition(3))
    assert keys(again) == keys(train)
    other, _ = churn.stratified_split(trainable, seed=1)
    assert keys(other) != keys(train)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "churned int")
    weights = churn.balanced_weights(df).groupBy("churned").agg(F.sum("_weight").alias("w"))
    assert as_dict(weights, "churned", "w") == pytest.approx({0: 4.0, 1: 4.0})


def test_encoding_scales_by_population_and_zeroes_unseen_segments(spark, trainable):
    model = churn.fit_churn(trainable)
    rows = model.transform(trainable).select("_z", "_onehot").collect()
    first = [row["_z"][0] for row in rows]
    assert sum(first) / len(first) == pytest.approx(0.0, abs=1e-9)
    assert sum(v * v for v in first) / len(first) == pytest.approx(1.0)
    assert rows[0]["_onehot"].size == 3
    stranger = trainable.limit(1).withColumn("segment_name", F.lit("Never Seen"))
    assert model.transform(stranger).first()["_onehot"] == Vectors.sparse(3, {})


def test_model_ranks_churn_and_is_a_minimum_of_the_penalised_loss(spark, trainable):
    scored, auc, report = churn.score_churn(trainable)
    assert 0.75 < auc <= 1.0
    rows = scored.collect()
    assert len(rows) == 400
    assert all(0.0 <= r["churn_risk"] <= 1.0 for r in rows)
    assert {r["class"] for r in report.collect()} == {"0", "1", "accuracy", "macro avg", "weighted avg"}

    model = churn.fit_churn(trainable)
    weighted = churn.balanced_weights(trainable)
    points = model.transform(weighted).select("_features", "churned", "_weight", "_probability").collect()
    stage = model.stages[-1]
    pull = [0.0] * len(stage.coefficients)
    for row in points:
        error = row["_weight"] * (row["_probability"][1] - row["churned"])
        for i, x in enumerate(row["_features"].toArray()):
            pull[i] += error * x
    for gradient, coefficient in zip(pull, stage.coefficients, strict=True):
        assert gradient + coefficient == pytest.approx(0.0, abs=0.5)


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_counts_ties_half(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 1), rng.randint(0, 1)) for _ in range(120)]
    df = spark.createDataFrame(rows, "churn_risk double, churned int")
    assert churn.roc_auc(df) == pytest.approx(brute_auc(rows))


def test_report_by_hand(spark):
    rows = [(0.9, 1)] * 3 + [(0.5, 0)] * 1 + [(0.2, 1)] * 2 + [(0.1, 0)] * 4
    df = spark.createDataFrame(rows, "churn_risk double, churned int")
    got = as_dict(
        churn.classification_report(df), "class", "precision", "recall", "f1_score", "support"
    )
    assert got["1"] == pytest.approx((3 / 4, 3 / 5, 2 / 3, 5))
    assert got["0"] == pytest.approx((4 / 6, 4 / 5, 8 / 11, 5))
    assert got["accuracy"] == pytest.approx((0.7, 0.7, 0.7, 10))
    assert got["macro avg"][0] == pytest.approx((3 / 4 + 4 / 6) / 2)
    nobody = as_dict(churn.classification_report(df, threshold=2.0), "class", "precision")
    assert nobody["1"] == 0.0


def test_bands_deciles_and_lift(spark):
    rows = [(f"p{i:03d}", i / 90, float((i * 37) % 90 + 1), int(i > 45)) for i in range(90)]
    df = spark.createDataFrame(
        rows, "customer_unique_id string, churn_risk double, monetary double, churned int"
    )
    banded = churn.priority_band(churn.risk_decile(df))
    for row in banded.collect():
        risk = 3 - int(row["churn_risk"] * 90 // 30)
        value = 3 - int((row["monetary"] - 1) // 30)
        assert (row["risk_band"], row["value_band"]) == (risk, value)
        expected = {(1, 1): "HIGH", (1, 2): "MEDIUM", (2, 1): "MEDIUM"}.get((risk, value), "LOW")
        assert row["priority_band"] == expected
    lift = as_dict(churn.decile_lift(banded), "risk_decile", "customers", "churn_rate")
    assert sorted(lift) == list(range(10))
    assert lift[9] == (9, 1.0)
    assert lift[0] == (9, 0.0)


def test_scores_keep_optional_columns_only_when_there(spark, trainable):
    scored = churn.value_at_risk(trainable.withColumn("churn_risk", F.lit(0.5)))
    assert churn.churn_scores(scored).columns == churn.SCORE_COLUMNS
    assert len(churn.SCORE_COLUMNS) == 17
    extra = scored.withColumn("risk_decile", F.lit(1)).withColumn("priority_band", F.lit("LOW"))
    assert churn.churn_scores(extra).columns[-2:] == ["risk_decile", "priority_band"]
    assert all(r["value_at_risk"] <= r["monetary"] for r in scored.collect())


def test_class_balance(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "churned int")
    assert as_dict(churn.class_balance(df), "churned", "customers", "share") == {0: (3, 0.75), 1: (1, 0.25)}
