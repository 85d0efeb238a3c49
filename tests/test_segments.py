import math

import pytest
from pyspark.sql import functions as F

from holdfast.functions import labels
from holdfast.operators import impute, segments
from tests.helpers import as_dict


def rfm_rows(spark, rows):
    """RFM frame from (person, recency, frequency, monetary, gap); other metrics are constant."""
    df = spark.createDataFrame(
        rows, "customer_unique_id string, recency_days int, frequency long, m string, g string"
    )
    return df.select(
        "customer_unique_id",
        "recency_days",
        "frequency",
        F.col("m").cast("decimal(14,2)").alias("monetary"),
        F.col("m").cast("decimal(14,2)").alias("avg_order_value"),
        F.lit("1.5").cast("decimal(10,2)").alias("avg_items_per_order"),
        F.lit("2.0").cast("decimal(10,2)").alias("avg_category_diversity"),
        F.lit(3).alias("tenure_days"),
        F.col("g").cast("decimal(10,2)").alias("avg_days_between_orders"),
    )


def test_features_are_complete(spark):
    rows = [("a", 1, 1, "9.00", None), ("b", None, 2, "99.00", "5.00"), ("c", 4, 3, None, "6.00"),
            ("d", 2, 4, "0.00", "7.00")]
    got = as_dict(
        segments.prepare_rfm_features(rfm_rows(spark, rows)),
        "customer_unique_id",
        "recency_days",
        "monetary",
        "monetary_log",
        "avg_days_between_orders",
    )
    assert got["a"] == (1.0, 9.0, math.log1p(9.0), 9999.0)
    assert got["b"][0] == 2.0
    assert got["c"][1] == 9.0
    assert got["d"][2] == 0.0


def test_text_and_nan_count_as_missing(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,), ("4",)], "v string")
    numbers = impute.as_numbers(df, ["v"])
    assert [r["v"] for r in numbers.collect()] == [1.5, None, None, None, 4.0]
    assert [r["v"] for r in impute.fill_medians(numbers, ["v"]).collect()] == [1.5, 2.75, 2.75, 2.75, 4.0]


def test_median_of_an_empty_column_stays_missing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "v double, w double")
    assert [tuple(r) for r in impute.fill_medians(df, ["v", "w"]).collect()] == [(None, 1.0), (None, 1.0)]


def test_standardize_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0), (6.0, 7.0)], "v double, c double")
    rows = segments.standardize(df, ["v", "c"]).collect()
    deviation = math.sqrt(sum((x - 3.0) ** 2 for x in (1, 2, 3, 6)) / 4)
    assert [r["v_z"] for r in rows] == pytest.approx([(r["v"] - 3.0) / deviation for r in rows])
    assert {r["c_z"] for r in rows} == {0.0}


def people(spark):
    """Five clear groups of 40 people each."""
    rows = []
    for group, (recency, freq, money, gap) in enumerate(
        [(5, 9, 900, 20), (300, 6, 800, 50), (200, 8, 20, 25), (10, 1, 60, None), (150, 2, 100, 90)]
    ):
        for i in range(40):
            rows.append(
                (
                    f"g{group}-{i}",
                    recency + i % 3,
                    freq,
                    f"{money + i % 5}.00",
                    None if gap is None else f"{gap}.00",
                )
            )
    return rfm_rows(spark, rows)


def test_kmeans_finds_the_groups_and_names_follow_the_ranks(spark):
    assigned, profile = segments.segment_customers(people(spark))
    rows = assigned.collect()
    assert len(rows) == 200
    assert assigned.columns == ["customer_unique_id", "segment", "segment_name", *segments.METRICS]
    by_group = {}
    for row in rows:
        by_group.setdefault(row["customer_unique_id"].split("-")[0], set()).add(
            (row["segment"], row["segment_name"])
        )
    assert all(len(found) == 1 for found in by_group.values())
    names = {group: next(iter(found))[1] for group, found in by_group.items()}
    assert names["g0"] == labels.CHAMPIONS
    assert names["g1"] == labels.AT_RISK
    assert names["g2"] == labels.LOYAL_LOW
    assert names["g3"] == labels.NEW
    assert names["g4"] == labels.OCCASIONAL
    sizes = as_dict(profile, "segment", "customers", "share")
    assert sorted(sizes.values()) == [(40, 0.2)] * 5


def test_kmeans_labels_repeat_with_the_seed(spark):
    first, _ = segments.segment_customers(people(spark), seed=7)
    second, _ = segments.segment_customers(people(spark), seed=7)
    assert as_dict(first, "customer_unique_id", "segment") == as_dict(
        second, "customer_unique_id", "segment"
    )


def test_choose_k_prefers_the_real_group_count(spark):
    scaled = segments.standardize(segments.prepare_rfm_features(people(spark)))
    scores = dict(segments.choose_k(scaled, [f"{f}_z" for f in segments.FEATURES], [2, 5]))
    assert scores[5] > scores[2]


@pytest.mark.parametrize(
    "recency,value,freq,name",
    [
        (1, 1, 1, labels.CHAMPIONS),
        (2, 1, 2, labels.CHAMPIONS),
        (3, 1, 1, labels.OCCASIONAL),
        (4, 2, 5, labels.AT_RISK),
        (4, 1, 1, labels.AT_RISK),
        (3, 4, 2, labels.LOYAL_LOW),
        (1, 4, 2, labels.LOYAL_LOW),
        (2, 3, 4, labels.NEW),
        (5, 5, 5, labels.OCCASIONAL),
        (3, 3, 3, labels.OCCASIONAL),
    ],
)
def test_naming_rules(spark, recency, value, freq, name):
    row = spark.range(1).select(labels.segment_name(F.lit(recency), F.lit(value), F.lit(freq)).alias("n"))
    assert row.first()["n"] == name


def test_equal_means_share_a_rank(spark):
    rows = [("a", 1, 1, "5.00", "1.00"), ("b", 1, 1, "5.00", "1.00"), ("c", 3, 1, "4.00", "1.00")]
    labelled = rfm_rows(spark, rows).withColumn("segment", F.ascii("customer_unique_id"))
    ranks = as_dict(
        segments.profile_segments(labelled), "segment", "recency_rank", "value_rank", "freq_rank"
    )
    assert ranks == {97: (1, 1, 1), 98: (1, 1, 1), 99: (2, 2, 1)}


def test_playbook_has_one_entry_per_name(spark):
    actions = segments.segment_actions(spark)
    names = [r["segment_name"] for r in actions.collect()]
    assert names == [labels.CHAMPIONS, labels.AT_RISK, labels.LOYAL_LOW, labels.NEW, labels.OCCASIONAL]
    assert actions.columns == ["segment_name", "objective", "recommended_actions"]


def test_the_fit_does_not_depend_on_the_input_partitions(spark):
    rows = [(str(k), float(k % 17), float(k * k % 23)) for k in range(600)]
    df = spark.createDataFrame(rows, "customer_unique_id string, a double, b double")
    centres = [
        sorted(c.tolist() for c in segments.fit_kmeans(df.repartition(n), ["a", "b"], 4).stages[-1].clusterCenters())
        for n in (1, 4, 16)
    ]
    for other in centres[1:]:
        for mine, theirs in zip(centres[0], other, strict=True):
            assert mine == pytest.approx(theirs, abs=1e-9)
