"""Monthly cohorts and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.dates import month_start, months_between_starts
from holdfast.functions.numbers import RATE, rate
from holdfast.operators.facts import PERSON, WHEN


def customer_cohort(orders: DataFrame, key: str = PERSON, ts: str = WHEN) -> DataFrame:
    """One row per person and active month, with the month of the first purchase.

    Orders shrink to person-months on the map side, so the window over a person
    holds at most one row per calendar month however many orders there are.
    """
    active = (
        orders.where(F.col(key).isNotNull())
        .select(key, month_start(F.col(ts)).alias("order_month"))
        .distinct()
    )
    first = F.min("order_month").over(Window.partitionBy(key))
    return active.withColumn("cohort_month", first).select(
        key,
        "cohort_month",
        "order_month",
        months_between_starts(F.col("order_month"), F.col("cohort_month")).alias("month_index"),
    )


def cohort_retention(cohort: DataFrame, by: Sequence[str] = (), key: str = PERSON) -> DataFrame:
    """People still active per cohort and month index, overall or per ``by`` columns.

    ``cohort`` holds each person at most once per month (see ``customer_cohort``),
    so counting rows counts people.  The cohort size is the count at index 0;
    the window that spreads it runs over the aggregated table.
    """
    group = ["cohort_month", *by]
    retained = cohort.groupBy(*group, "month_index").agg(F.count(key).alias("retained_customers"))
    size = F.sum(F.when(F.col("month_index") == 0, F.col("retained_customers"))).over(
        Window.partitionBy(*group)
    )
    return (
        retained.withColumn("cohort_size", size)
        .where(F.col("cohort_size").isNotNull())
        .select(
            *group,
            "month_index",
            "cohort_size",
            "retained_customers",
            rate(F.col("retained_customers"), F.col("cohort_size")).alias("retention_rate"),
        )
    )


def cohort_retention_by(
    cohort: DataFrame, segments: DataFrame, by: str = "segment_name", key: str = PERSON
) -> DataFrame:
    """Retention per cohort and segment, for people who have a segment."""
    labelled = cohort.join(segments.select(key, by), key).where(F.col(by).isNotNull())
    return cohort_retention(labelled, (by,), key)


def retention_curve(retention: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted retention per month index: retained people over the cohorts observed there.

    Rates of single cohorts do not add up; their counts do.
    """
    return (
        retention.groupBy(*by, "month_index")
        .agg(
            F.sum("cohort_size").alias("cohort_size"),
            F.sum("retained_customers").alias("retained_customers"),
        )
        .withColumn("retention_rate", rate(F.col("retained_customers"), F.col("cohort_size")))
    )


def cohort_heatmap(retention: DataFrame, months: Sequence[int] | None = None) -> DataFrame:
    """One row per cohort with one rate column per month index (NULL if not observed).

    Without ``months``, every index that occurs gets a column; they are read from the
    retention table first, at most one per month between the first and last order.
    """
    if months is None:
        months = sorted(row["month_index"] for row in retention.select("month_index").distinct().collect())
    return (
        retention.groupBy("cohort_month")
        .pivot("month_index", list(months))
        .agg(F.first("retention_rate"))
        .select("cohort_month", *[F.col(str(m)).alias(f"month_{m}") for m in months])
    )


def heatmap_cells(heatmap: DataFrame) -> DataFrame:
    """The heatmap as one row per cohort and month index, unobserved cells (NULL) included."""
    months = [name for name in heatmap.columns if name != "cohort_month"]
    if not months:
        return heatmap.select("cohort_month", F.lit(0).alias("month_index"), F.lit(None).cast(RATE).alias("retention_rate")).limit(0)
    cells = heatmap.unpivot("cohort_month", months, "month", "retention_rate")
    return cells.select(
        "cohort_month",
        F.substring_index("month", "_", -1).cast("int").alias("month_index"),
        "retention_rate",
    )


def cohort_baseline(retention: DataFrame) -> DataFrame:
    """Smallest month index per cohort; 0 everywhere in a sound table."""
    return retention.groupBy("cohort_month").agg(F.min("month_index").alias("min_month_index"))
