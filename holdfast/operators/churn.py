"""Churn: training frame, split, model, diagnostics and scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, nan, sqrt
from operator import or_
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (
    ElementwiseProduct,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import labels
from holdfast.operators import logistic
from holdfast.operators.facts import PERSON
from holdfast.operators.impute import FIT_PARTITIONS, as_numbers, fill_medians, laid_out
from holdfast.operators.ranking import quantile_bins
from holdfast.operators.segments import NO_REPEAT_GAP, SEED

# Label threshold, hold-out share, solver limit, feature columns
# and the column order of the score table.
CHURN_DAYS = 180
TEST_SHARE = 0.2
HASH_BITS, STEP_BITS, FEW_ROWS = 60, 12, 1000
MAX_ITERATIONS = 2000
LIFETIME = [
    "frequency",
    "monetary",
    "avg_order_value",
    "avg_items_per_order",
    "avg_category_diversity",
    "tenure_days",
    "avg_days_between_orders",
]
RECENT = ["spend_30d", "spend_90d", "orders_30d", "orders_90d"]
SCORE_COLUMNS = [
    PERSON,
    "segment_name",
    "churned",
    "churn_risk",
    "value_at_risk",
    "recency_days",
    *LIFETIME,
    "orders_30d",
    "orders_90d",
    "spend_30d",
    "spend_90d",
]
OPTIONAL_COLUMNS = ["risk_decile", "priority_band"]
REPORT_SCHEMA = "class string, precision double, recall double, f1_score double, support long"


def training_frame(rfm: DataFrame, segments: DataFrame, features: DataFrame) -> DataFrame:
    """RFM, segment name and time features per person; every table has one row per person."""
    return (
        rfm.select(PERSON, *LIFETIME, "recency_days")
        .join(segments.select(PERSON, "segment_name"), PERSON, "left")
        .join(
            features.select(
                PERSON,
                "spend_30d",
                "spend_90d",
                "spend_180d",
                "orders_30d",
                "orders_90d",
                "orders_180d",
                "recent_order_ratio",
                "recent_spend_ratio",
            ),
            PERSON,
            "left",
        )
    )


def impute_training(df: DataFrame, gap_fill: float = NO_REPEAT_GAP) -> DataFrame:
    """Complete numeric features and segment names.

    Lifetime metrics take their median, so ``gap_fill`` only reaches the gap column
    when it has no value at all; recent activity takes 0, segments "Unknown".
    """
    numbers = as_numbers(df, [*LIFETIME, *RECENT])
    return fill_medians(numbers, LIFETIME).na.fill(
        {
            **dict.fromkeys(RECENT, 0.0),
            "avg_days_between_orders": float(gap_fill),
            "segment_name": labels.UNKNOWN,
        }
    )


def label_churn(df: DataFrame, days: int = CHURN_DAYS) -> DataFrame:
    """``churned`` is 1 when the last order is at least ``days`` before the dataset end."""
    return df.withColumn(
        "churned", F.coalesce(F.col("recency_days") >= days, F.lit(False)).cast("int")
    )


def class_balance(df: DataFrame, label: str = "churned") -> DataFrame:
    """Rows per class, and the class's share of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("_all")).scalar()
    return (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("customers"))
        .withColumn("share", F.col("customers") / total)
    )


def _train_counts(counts: dict, share: float) -> dict:
    """Training rows per class: the hold-out is rounded up, leftovers go to the largest remainders."""
    total = sum(counts.values())
    training = total - ceil(total * share)
    exact = {label: training * n / total for label, n in counts.items()}
    given = {label: int(value) for label, value in exact.items()}
    left = training - sum(given.values())
    for label in sorted(counts, key=lambda c: (given[c] - exact[c], str(c)))[:left]:
        given[label] += 1
    return given


def _cuts(hashed: DataFrame, label: str, key: str, ranks: dict) -> dict:
    """The (hash, key) that stands at each class's rank, for all classes together.

    One aggregation counts every class's rows by the leading bits of the hash; only the
    range that holds the rank is counted again by its next bits, until it has a few rows.
    """
    spans = {value: (0, HASH_BITS, rank) for value, rank in ranks.items()}

    def inside(value) -> Column:
        low, bits, _ = spans[value]
        within = F.col("_hash").between(low, low + (1 << bits) - 1)
        return F.col(label).eqNullSafe(F.lit(value)) & within

    open_spans = set(spans)
    while open_spans:
        step = {value: min(STEP_BITS, spans[value][1]) for value in open_spans}
        part = F.coalesce(
            *[
                F.when(inside(v), F.shiftright("_hash", spans[v][1] - step[v])) for v in open_spans
            ]
        )
        counted = (
            hashed.where(reduce(or_, [inside(v) for v in open_spans]))
            .groupBy(F.col(label).alias("_class"), part.alias("_part"))
            .count()
            .collect()
        )
        for value in list(open_spans):
            _, bits, rank = spans[value]
            rest = bits - step[value]
            for row in sorted((r for r in counted if r["_class"] == value), key=lambda r: r["_part"]):
                if rank < row["count"]:
                    spans[value] = (row["_part"] << rest, rest, rank)
                    if row["count"] <= FEW_ROWS or rest == 0:
                        open_spans.discard(value)
                    break
                rank -= row["count"]
            else:  # the class has no row at this rank: nothing is held out
                del spans[value]
                open_spans.discard(value)
    if not spans:
        return {}
    rows = hashed.where(reduce(or_, [inside(v) for v in spans])).select(label, "_hash", key).collect()
    found = {}
    for value, (_, _, rank) in spans.items():
        own = sorted((r["_hash"], r[key]) for r in rows if r[label] == value)
        found[value] = own[rank]
    return found


def stratified_split(
    df: DataFrame,
    label: str = "churned",
    share: float = TEST_SHARE,
    seed: int = SEED,
    key: str = PERSON,
) -> tuple[DataFrame, DataFrame]:
    """Training and hold-out rows with exact class proportions.

    Rows are ordered by a seeded hash of their unique key (the first 60 bits of the MD5
    of ``seed:key``), and each class is cut at one exact rank, so the split does not
    depend on partitioning, needs no sort, and is the same when a task is run again.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    hashed = df.withColumn("_hash", F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long"))
    counts = {row[label]: row["count"] for row in df.groupBy(label).count().collect()}
    held_out = F.lit(False)
    for value, (at, name) in _cuts(hashed, label, key, _train_counts(counts, share)).items():
        beyond = (F.col("_hash") > at) | ((F.col("_hash") == at) & (F.col(key) >= F.lit(name)))
        held_out = held_out | (F.col(label).eqNullSafe(F.lit(value)) & beyond)
    return hashed.where(~held_out).drop("_hash"), hashed.where(held_out).drop("_hash")


def balanced_weights(df: DataFrame, label: str = "churned", out: str = "_weight") -> DataFrame:
    """Row weights that give both classes the same total; the weights add up to the row count."""
    counts = {row[label]: row["count"] for row in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        share = F.lit(total / (len(counts) * n))
        weight = F.when(F.col(label) == value, share).otherwise(weight)
    return df.withColumn(out, weight)


def encoding(numeric: Sequence[str], category: str, rows: int) -> Pipeline:
    """Scaled numbers in ``_z`` and the one-hot category in ``_onehot``, for ``rows`` rows.

    The scaler divides by the sample deviation; the product after it turns that
    into the population deviation.  An unseen category encodes to all zeros.
    """
    to_population = sqrt(rows / (rows - 1)) if rows > 1 else 1.0
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(numeric), outputCol="_numbers"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
            ElementwiseProduct(
                inputCol="_scaled",
                outputCol="_z",
                scalingVec=Vectors.dense([to_population] * len(numeric)),
            ),
            StringIndexer(
                inputCol=category,
                outputCol="_index",
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=["_index"], outputCols=["_onehot"], dropLast=True),
        ]
    )


def churn_pipeline(
    numeric: Sequence[str],
    category: str,
    rows: int,
    label: str = "churned",
    weight: str = "_weight",
    strength: float = 1.0,
) -> Pipeline:
    """Encoding and an L2 logistic regression for ``rows`` training rows.

    The solver's loss is a mean, so a penalty weight of ``1 / strength`` on the sum
    is ``1 / (strength * rows)`` here.
    """
    return Pipeline(
        stages=[
            *encoding(numeric, category, rows).getStages(),
            VectorAssembler(inputCols=["_z", "_onehot"], outputCol="_features"),
            LogisticRegression(
                featuresCol="_features",
                labelCol=label,
                weightCol=weight,
                probabilityCol="_probability",
                rawPredictionCol="_raw",
                predictionCol="_prediction",
                regParam=1.0 / (strength * rows),
                elasticNetParam=0.0,
                standardization=False,
                maxIter=MAX_ITERATIONS,
            ),
        ]
    )


def encode_features(
    train: DataFrame,
    df: DataFrame,
    numeric: Sequence[str] = (*LIFETIME, *RECENT),
    category: str = "segment_name",
    key: str = PERSON,
) -> DataFrame:
    """Encoded features of ``df`` as plain columns, with scales and categories from ``train``.

    One ``<name>_z`` column per number and one ``is_<category>`` flag per category of ``train``.
    """
    model = encoding(numeric, category, train.count()).fit(train)
    encoded = model.transform(df)
    z, flags = vector_to_array("_z"), vector_to_array("_onehot")
    names = [name.lower().replace(" ", "_") for name in model.stages[3].labels]
    return encoded.select(
        key,
        *[z[i].alias(f"{name}_z") for i, name in enumerate(numeric)],
        *[flags[i].cast("int").alias(f"is_{name}") for i, name in enumerate(names)],
    )


def fit_churn(
    train: DataFrame,
    numeric: Sequence[str] = (*LIFETIME, *RECENT),
    category: str = "segment_name",
    label: str = "churned",
    key: str = PERSON,
    partitions: int = FIT_PARTITIONS,
) -> PipelineModel:
    """The fitted churn pipeline with balanced class weights."""
    weighted = laid_out(balanced_weights(train, label), key, partitions).persist()
    try:
        return churn_pipeline(numeric, category, weighted.count(), label).fit(weighted)
    finally:
        weighted.unpersist()


def score_customers(model: PipelineModel, df: DataFrame, out: str = "churn_risk") -> DataFrame:
    """``df`` with the modelled probability of churn."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("_probability")[1].alias(out))


def roc_auc(df: DataFrame, score: str = "churn_risk", label: str = "churned") -> float:
    """Area under the ROC curve over all distinct scores, ties counted half."""
    points = df.select(F.col(score).cast("double"), F.col(label).cast("double"))
    return BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol=label, metricName="areaUnderROC", numBins=0
    ).evaluate(points)


def classification_report(
    df: DataFrame, score: str = "churn_risk", label: str = "churned", threshold: float = 0.5
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages.

    One aggregation counts the four outcomes; the rest is arithmetic on one row.
    A ratio without a denominator is 0.
    """
    actual, said = F.col(label) == 1, F.col(score) >= threshold
    outcome = df.agg(
        F.count_if(actual & said).cast("double").alias("tp"),
        F.count_if(~actual & said).cast("double").alias("fp"),
        F.count_if(actual & ~said).cast("double").alias("fn"),
        F.count_if(~actual & ~said).cast("double").alias("tn"),
    )

    def over(part, whole):
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))
    all_rows = tp + fp + fn + tn

    def line(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1_score"),
            support.cast("long").alias("support"),
        )

    stats = {
        "0": (over(tn, tn + fn), over(tn, tn + fp), over(2 * tn, 2 * tn + fn + fp), tn + fp),
        "1": (over(tp, tp + fp), over(tp, tp + fn), over(2 * tp, 2 * tp + fp + fn), tp + fn),
    }
    hit_rate = over(tp + tn, all_rows)
    macro = [(low + high) / 2 for low, high in zip(stats["0"][:3], stats["1"][:3], strict=True)]
    weighted = [
        over(low * stats["0"][3] + high * stats["1"][3], all_rows)
        for low, high in zip(stats["0"][:3], stats["1"][:3], strict=True)
    ]
    lines = F.array(
        *[line(name, *values) for name, values in stats.items()],
        line("accuracy", hit_rate, hit_rate, hit_rate, all_rows),
        line("macro avg", *macro, all_rows),
        line("weighted avg", *weighted, all_rows),
    )
    return outcome.select(F.inline(lines))


def risk_decile(
    df: DataFrame,
    risk: str = "churn_risk",
    out: str = "risk_decile",
    duplicates: str = "raise",
) -> DataFrame:
    """Decile of the score, 9 the highest."""
    return quantile_bins(df, risk, 10, out, duplicates)


def decile_lift(df: DataFrame, bin_col: str = "risk_decile", label: str = "churned") -> DataFrame:
    """People and churn rate per score decile."""
    return df.groupBy(bin_col).agg(
        F.count(F.lit(1)).alias("customers"), F.avg(label).alias("churn_rate")
    )


def priority_band(
    df: DataFrame,
    risk: str = "churn_risk",
    value: str = "monetary",
    duplicates: str = "raise",
) -> DataFrame:
    """``risk_band`` and ``value_band`` (tertiles, 1 the highest) and their priority."""
    binned = quantile_bins(df, risk, 3, "risk_band", duplicates)
    binned = quantile_bins(binned, value, 3, "value_band", duplicates)
    return binned.withColumns(
        {name: F.lit(3) - F.col(name) for name in ("risk_band", "value_band")}
    ).withColumn(
        "priority_band",
        labels.by_tiles(
            F.col("risk_band"), F.col("value_band"), labels.BAND_LABELS, labels.BAND_DEFAULT
        ),
    )


def value_at_risk(df: DataFrame, risk: str = "churn_risk", value: str = "monetary") -> DataFrame:
    """Expected loss: lifetime value times churn probability."""
    return df.withColumn(
        "value_at_risk", F.col(value).cast("double") * F.col(risk).cast("double")
    )


def churn_scores(df: DataFrame) -> DataFrame:
    """The score table: its fixed columns, and decile and priority where present."""
    return df.select(*SCORE_COLUMNS, *[name for name in OPTIONAL_COLUMNS if name in df.columns])


class ChurnModel(NamedTuple):
    """An encoder and the regression on its columns, which stand in the order of ``names``."""

    encoder: PipelineModel
    names: list[str]
    logit: logistic.Logit


class Evaluation(NamedTuple):
    """Everybody scored, the hold-out AUC and report, and the AUC without the ablated features."""

    scored: DataFrame
    auc: float
    report: DataFrame
    auc_without: float


def _encoded(encoder: PipelineModel, df: DataFrame, numbers: int) -> tuple[DataFrame, list[str]]:
    """``df`` with one plain column per encoded feature, and their names."""
    z, flags = vector_to_array("_z"), vector_to_array("_onehot")
    columns = {f"_x{i}": z[i] for i in range(numbers)}
    columns |= {f"_x{numbers + i}": flags[i] for i in range(len(encoder.stages[3].labels))}
    made = encoder.transform(df).select(*df.columns, *[c.alias(name) for name, c in columns.items()])
    return made, list(columns)


def fit_churn_newton(
    train: DataFrame,
    numeric: Sequence[str] = (*LIFETIME, *RECENT),
    category: str = "segment_name",
    label: str = "churned",
    strength: float = 1.0,
) -> ChurnModel:
    """The model of ``fit_churn`` at its optimum: balanced weights, L2 penalty, free intercept."""
    weighted = balanced_weights(train, label)
    encoder = encoding(numeric, category, train.count()).fit(train)
    rows, names = _encoded(encoder, weighted, len(numeric))
    rows = rows.select(label, "_weight", *names).persist()
    try:
        logit = logistic.fit(rows, names, label, "_weight", strength)
    finally:
        rows.unpersist()
    return ChurnModel(encoder, names, logit)


def score_newton(model: ChurnModel, df: DataFrame, out: str = "churn_risk") -> DataFrame:
    """``df`` with the modelled probability of churn."""
    numbers = len(model.names) - len(model.encoder.stages[3].labels)
    rows, _ = _encoded(model.encoder, df, numbers)
    return rows.select(*df.columns, logistic.probability(model.logit).alias(out))


def evaluate_churn(train_all: DataFrame, ablate: Sequence[str] | None = RECENT) -> Evaluation:
    """Fits on a stratified 80 %, scores everybody, and fits again without ``ablate``.

    Recent activity partly gives the label away, which looks back from the same date; the second
    AUC, on the same split, says what the other features know by themselves (NaN if ``ablate``
    is None).  The frame is kept in memory or on disk only while the split and the fits read
    it over and over.
    """
    frame = train_all.persist()
    try:
        train, held_out = stratified_split(frame)
        model = fit_churn_newton(train)
        checked = score_newton(model, held_out)
        auc = roc_auc(checked)
        report = train_all.sparkSession.createDataFrame(
            classification_report(checked).collect(), REPORT_SCHEMA
        )
        auc_without = nan
        if ablate is not None:
            fewer = [name for name in (*LIFETIME, *RECENT) if name not in set(ablate)]
            auc_without = roc_auc(score_newton(fit_churn_newton(train, fewer), held_out))
    finally:
        frame.unpersist()
    return Evaluation(score_newton(model, train_all), auc, report, auc_without)


def score_churn(train_all: DataFrame) -> tuple[DataFrame, float, DataFrame]:
    """All people scored, the hold-out AUC and its report."""
    return evaluate_churn(train_all, ablate=None)[:3]
