"""Behavioural segments: K-Means on RFM features, profiles and names."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.functions import labels
from holdfast.functions.dates import whole_days
from holdfast.functions.numbers import MEAN, cents, from_cents, mean_of
from holdfast.operators import clustering
from holdfast.operators.facts import PERSON, WHEN
from holdfast.operators.impute import FIT_PARTITIONS, as_numbers, fill_medians, laid_out

# Metrics in table order, cluster count, seed, and the gap that
# stands for "never came back".
METRICS = [
    "recency_days",
    "frequency",
    "monetary",
    "avg_order_value",
    "avg_items_per_order",
    "avg_category_diversity",
    "tenure_days",
    "avg_days_between_orders",
]
CLUSTERS = 5
SEED = 42
NO_REPEAT_GAP = 9999

LOGGED = ("monetary", "avg_order_value")
FEATURES = [f"{name}_log" if name in LOGGED else name for name in METRICS]


def prepare_rfm_features(rfm: DataFrame, gap_fill: float = NO_REPEAT_GAP) -> DataFrame:
    """Person, the eight metrics as complete doubles, and the logged spend metrics."""
    numbers = as_numbers(rfm.select(PERSON, *METRICS), METRICS)
    gapped = numbers.na.fill({"avg_days_between_orders": float(gap_fill)})
    complete = fill_medians(gapped, [m for m in METRICS if m != "avg_days_between_orders"])
    return complete.withColumns({f"{name}_log": F.log1p(F.col(name)) for name in LOGGED})


def standardize(df: DataFrame, cols: Sequence[str] = FEATURES, suffix: str = "_z") -> DataFrame:
    """Adds z-scores with the population deviation; a constant column becomes 0.

    One aggregation brings two numbers per column to the driver.
    """
    stats = df.agg(
        *[F.avg(name).alias(f"{name}_mean") for name in cols],
        *[F.stddev_pop(name).alias(f"{name}_dev") for name in cols],
    ).first()
    return df.withColumns(
        {
            f"{name}{suffix}": (F.col(name) - F.lit(stats[f"{name}_mean"]))
            / F.lit(stats[f"{name}_dev"] or 1.0)
            for name in cols
        }
    )


def _clustering(features: Sequence[str], k: int, seed: int) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="_features"),
            KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="segment"),
        ]
    )


def fit_kmeans(
    df: DataFrame,
    features: Sequence[str],
    k: int = CLUSTERS,
    seed: int = SEED,
    key: str = PERSON,
    partitions: int = FIT_PARTITIONS,
) -> PipelineModel:
    """K-Means on already standardised columns; the fit does not depend on how ``df`` is split."""
    return _clustering(features, k, seed).fit(laid_out(df.select(key, *features), key, partitions))


def label_segments(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with the cluster number in ``segment``."""
    return model.transform(df).drop("_features")


def choose_k(
    df: DataFrame,
    features: Sequence[str],
    ks: Iterable[int] = range(2, 11),
    seed: int = SEED,
    key: str = PERSON,
    steps: int = clustering.STEPS,
) -> list[tuple[int, float]]:
    """Silhouette per cluster count, all counts in the same passes over the rows."""
    return sorted(clustering.fit(df, features, ks, seed, key, steps, scores=True)[1].items())


def profile_segments(df: DataFrame, label: str = "segment") -> DataFrame:
    """Size, mean metrics, share and dense ranks per segment.

    The windows run over one row per segment, after the aggregation.
    """
    means = df.groupBy(label).agg(
        F.count(PERSON).alias("customers"),
        *[F.avg(F.col(name).cast("double")).alias(name) for name in METRICS],
    )

    def dense(column: Column) -> Column:
        return F.dense_rank().over(Window.orderBy(column))

    return means.select(
        "*",
        (F.col("customers") / F.sum("customers").over(Window.partitionBy())).alias("share"),
        dense(F.col("recency_days").asc()).alias("recency_rank"),
        dense(F.col("monetary").desc()).alias("value_rank"),
        dense(F.col("frequency").desc()).alias("freq_rank"),
    )


def name_segments(profile: DataFrame) -> DataFrame:
    """Profile with a name per segment; several segments may get the same name."""
    return profile.withColumn(
        "segment_name",
        labels.segment_name(F.col("recency_rank"), F.col("value_rank"), F.col("freq_rank")),
    )


def assign_segments(labelled: DataFrame, named_profile: DataFrame, label: str = "segment") -> DataFrame:
    """Person, segment, segment name and metrics.

    The profile has one row per cluster, so it is always small enough to broadcast.
    """
    names = F.broadcast(named_profile.select(label, "segment_name"))
    return labelled.join(names, label, "left").select(PERSON, label, "segment_name", *METRICS)


def segment_customers(
    rfm: DataFrame, k: int = CLUSTERS, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Segments per person and the named segment profile.

    The metrics are kept while gaps, scales and the fit read them over and over.
    """
    people = rfm.select(PERSON, *METRICS).persist()
    try:
        scaled = standardize(prepare_rfm_features(people))
        centres, _ = clustering.fit(scaled, [f"{name}_z" for name in FEATURES], [k], seed, PERSON)
    finally:
        people.unpersist()
    labelled = clustering.nearest(scaled, centres[k])
    profile = name_segments(profile_segments(labelled))
    return assign_segments(labelled, profile), profile


def segment_kpis(
    enriched: DataFrame, as_of: date | str | None = None, weighting: str = "order"
) -> DataFrame:
    """Ten measures per segment, from one evaluation of the orders.

    An order belongs to one person, so a segment's orders are the sum of its people's.

    ``weighting="order"`` counts a person's own averages and recency once per
    order, ``"customer"`` once per person.  Orders shrink to one row per person
    first; weights replace a join back to the orders.  Recency is in whole days,
    so the exact median keeps one counter per day, not one per person.
    """
    if weighting not in ("order", "customer"):
        raise ValueError(f"unknown weighting: {weighting}")
    base = enriched.where(F.col("segment_name").isNotNull() & F.col(PERSON).isNotNull())
    averaged = {  # measure: (column, whether it is in hundredths)
        "avg_order_value": (cents(F.col("gross_order_value")), True),
        "avg_items_per_order": (F.col("items_count"), False),
        "avg_category_diversity": (F.col("category_diversity"), False),
        "avg_review_score": (cents(F.col("avg_review_score")), True),
    }
    people = base.groupBy("segment_name", PERSON).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.countDistinct("order_id").alias("_orders"),
        F.max(WHEN).alias("_last"),
        *[F.sum(value).alias(f"_sum_{name}") for name, (value, _) in averaged.items()],
        *[F.count(value).alias(f"_n_{name}") for name, (value, _) in averaged.items()],
    )
    today = (F.lit(str(as_of)).cast("date") if as_of else F.current_date()).cast("timestamp_ntz")
    weight = F.col("_rows") if weighting == "order" else F.lit(1).cast("long")
    spend = F.col("_sum_avg_order_value").cast("decimal(20,0)")  # times a weight below
    kpis = people.groupBy("segment_name").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("_orders").alias("orders"),
        from_cents(F.sum(spend), "decimal(28,2)").alias("revenue"),
        *[
            mean_of(F.sum(f"_sum_{name}"), F.sum(f"_n_{name}"), MEAN, hundredths).alias(name)
            for name, (_, hundredths) in averaged.items()
        ],
        mean_of(F.sum(F.col("_orders") * weight), F.sum(weight), MEAN).alias(
            "avg_orders_per_customer"
        ),
        mean_of(
            F.sum(spend * weight),
            F.sum(F.when(spend.isNotNull(), weight)),
            "decimal(14,2)",
            hundredths=True,
        ).alias("avg_spend_per_customer"),
        F.percentile(whole_days(today, F.col("_last")), F.lit(0.5), weight)
        .cast(MEAN)
        .alias("median_recency_days"),
    )
    return kpis.select(
        "segment_name",
        "customers",
        "orders",
        "revenue",
        *averaged,
        "avg_orders_per_customer",
        "avg_spend_per_customer",
        "median_recency_days",
    )


def segment_actions(spark: SparkSession) -> DataFrame:
    """The marketing playbook: objective and actions per segment name."""
    return spark.createDataFrame(
        labels.PLAYBOOK, "segment_name string, objective string, recommended_actions string"
    )
