"""Spend and order counts in trailing time windows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.dates import days_before
from holdfast.functions.numbers import cents, from_cents, ratio_or_zero
from holdfast.operators.facts import PERSON, WHEN
from holdfast.operators.joins import heavy_keys, skew_join
from holdfast.operators.rfm import dataset_end

WINDOWS = (30, 90, 180)


def _with_own_last(orders: DataFrame, counted_on: DataFrame) -> DataFrame:
    """Orders with the moment ``_last`` of their person's last one; orders of nobody go.

    Where no person is hot, one window over the persons does it: one scan, and the totals that
    follow need no other shuffle.  Otherwise orders shrink to one row per person and
    moment, and the last moments are joined to these with hot persons dealt out.
    """
    orders = orders.where(F.col(PERSON).isNotNull())
    partitions = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not heavy_keys(counted_on, PERSON, partitions)[0]:
        return orders.withColumn("_last", F.max(WHEN).over(Window.partitionBy(PERSON)))
    moments = orders.groupBy(PERSON, WHEN).agg(F.sum("_cents").alias("_cents"), F.sum("_n").alias("_n"))
    own_last = moments.groupBy(PERSON).agg(F.max(WHEN).alias("_last"))
    return skew_join(moments, own_last, PERSON, spread=[WHEN], counted_on=counted_on)


def time_features(
    customer_orders: DataFrame,
    windows: Sequence[int] = WINDOWS,
    anchor: str = "dataset_end",
    ratio_window: int | None = None,
    end_ts: datetime | str | None = None,
    value: str = "gross_order_value",
) -> DataFrame:
    """Trailing-window spend and orders per person, lifetime totals and recent ratios.

    ``anchor="dataset_end"`` counts back from the last order of the whole table;
    ``anchor="customer_last"`` from each person's own last order.  A window
    includes its lower bound.  ``ratio_window`` (default: the longest window, or
    the shortest for ``customer_last``) is the one behind the average value and
    the ratios.  One aggregation serves all windows and the lifetime totals.
    """
    if anchor not in ("dataset_end", "customer_last"):
        raise ValueError(f"unknown anchor: {anchor}")
    windows = sorted(windows)
    orders = customer_orders.select(PERSON, WHEN, cents(F.col(value)).alias("_cents"), F.lit(1).alias("_n"))
    if anchor == "dataset_end":
        end = dataset_end(customer_orders, WHEN, end_ts)
        recent = ratio_window or windows[-1]
    else:
        orders = _with_own_last(orders, customer_orders)
        end = F.col("_last")
        recent = ratio_window or windows[0]
    if recent not in windows:
        raise ValueError(f"ratio_window {recent} is not one of {windows}")

    within = {days: F.col(WHEN) >= days_before(end, days) for days in windows}
    spent = "decimal(22,2)"
    totals = orders.groupBy(PERSON).agg(
        *[
            from_cents(F.sum(F.when(inside, F.col("_cents")).otherwise(F.lit(0))), spent).alias(
                f"spend_{days}d"
            )
            for days, inside in within.items()
        ],
        *[
            F.sum(F.when(inside, F.col("_n")).otherwise(F.lit(0))).cast("long").alias(f"orders_{days}d")
            for days, inside in within.items()
        ],
        F.sum("_n").cast("long").alias("lifetime_orders"),
        from_cents(F.sum("_cents"), spent).alias("lifetime_spend"),
    )
    spend, orders_in = F.col(f"spend_{recent}d"), F.col(f"orders_{recent}d")
    return totals.select(
        "*",
        ratio_or_zero(spend, orders_in).alias(f"avg_order_value_{recent}d"),
        ratio_or_zero(orders_in, F.col("lifetime_orders")).alias("recent_order_ratio"),
        ratio_or_zero(spend, F.col("lifetime_spend")).alias("recent_spend_ratio"),
    )
