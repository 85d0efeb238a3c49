"""Recency, frequency, monetary value and purchase gaps per person."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.dates import elapsed_seconds, whole_days
from holdfast.functions.numbers import MEAN, TOTAL, money_mean, money_sum, whole_mean
from holdfast.operators.facts import PERSON, WHEN

SECONDS_PER_DAY = 86400


def dataset_end(df: DataFrame, ts: str = WHEN, end_ts: datetime | str | None = None) -> Column:
    """The latest timestamp of the table as a scalar subquery, or the given moment."""
    if end_ts is not None:
        return F.lit(str(end_ts)).cast("timestamp_ntz")
    return df.agg(F.max(ts).alias("_end")).scalar()


def mean_gap_days(first: Column, last: Column, n: Column) -> Column:
    """Mean days between consecutive events; NULL for a single event.

    Consecutive gaps add up to last minus first, so no sort within a key is needed.
    """
    steps = F.nullif(n - 1, F.lit(0)).cast("decimal(14,0)") * F.lit(SECONDS_PER_DAY)
    return (elapsed_seconds(last, first) / steps).cast(MEAN)


def interpurchase_gaps(df: DataFrame, key: str = PERSON, ts: str = WHEN) -> DataFrame:
    """Mean gap in days per key, for keys with at least two events."""
    spans = (
        df.where(F.col(ts).isNotNull())
        .groupBy(key)
        .agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
    )
    return spans.select(
        key,
        mean_gap_days(F.col("_first"), F.col("_last"), F.col("_n")).alias(
            "avg_days_between_orders"
        ),
    )


def customer_rfm(
    customer_orders: DataFrame,
    end_ts: datetime | str | None = None,
    value: str = "gross_order_value",
) -> DataFrame:
    """RFM features per person in one aggregation; recency counts back from the dataset end."""
    orders = customer_orders.where(F.col(WHEN).isNotNull())
    people = orders.groupBy(PERSON).agg(
        F.min(WHEN).alias("first_order_ts"),
        F.max(WHEN).alias("last_order_ts"),
        F.count(F.lit(1)).alias("_n"),
        F.countDistinct("order_id").alias("frequency"),
        money_sum(F.col(value), TOTAL).alias("monetary"),
        money_mean(F.col(value), TOTAL).alias("avg_order_value"),
        whole_mean(F.col("items_count"), MEAN).alias("avg_items_per_order"),
        whole_mean(F.col("category_diversity"), MEAN).alias("avg_category_diversity"),
    )
    first, last = F.col("first_order_ts"), F.col("last_order_ts")
    return people.select(
        PERSON,
        whole_days(dataset_end(customer_orders, WHEN, end_ts), last).alias("recency_days"),
        "frequency",
        "monetary",
        "avg_order_value",
        "avg_items_per_order",
        "avg_category_diversity",
        whole_days(last, first).alias("tenure_days"),
        mean_gap_days(first, last, F.col("_n")).alias("avg_days_between_orders"),
        "first_order_ts",
        "last_order_ts",
    )
