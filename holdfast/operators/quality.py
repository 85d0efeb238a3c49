"""Data-quality checks: declarative rules, and the checks as named queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import money_mean
from holdfast.operators.facts import PERSON, WHEN


@dataclass(frozen=True)
class Rule:
    """A named number and the condition it has to meet.

    ``measure`` aggregates the table.  With ``key``, the table is grouped first
    and ``measure`` is a condition on each group; the number is then how many
    groups meet it.
    """

    name: str
    measure: Column
    passes: Callable[[Column], Column]
    key: tuple[str, ...] = ()


def _at_most(limit: float) -> Callable[[Column], Column]:
    return lambda observed: observed <= limit


def row_count(name: str, at_least: int = 1) -> Rule:
    return Rule(name, F.count(F.lit(1)), lambda observed: observed >= at_least)


def no_nulls(col: str, at_most: int = 0) -> Rule:
    return Rule(f"null {col}", F.count_if(F.col(col).isNull()), _at_most(at_most))


def within(col: str, low: float, high: float) -> Rule:
    outside = ~F.col(col).between(low, high)
    return Rule(f"{col} within {low}..{high}", F.count_if(outside), _at_most(0))


def unique(*key: str) -> Rule:
    return Rule(f"duplicate {', '.join(key)}", F.count(F.lit(1)) > 1, _at_most(0), key)


def single_valued(key: str, *parts: str, at_most: int = 0) -> Rule:
    """Keys that occur with several values of the joined parts; a NULL part does not count."""
    return Rule(
        f"{key} with several {', '.join(parts)}",
        F.countDistinct(joined(*parts)) > 1,
        _at_most(at_most),
        (key,),
    )


def starts_at(col: str, key: str, value: int = 0) -> Rule:
    """Keys whose smallest value is another one; a key without any value does not start at it."""
    elsewhere = F.coalesce(F.min(col) != value, F.lit(True))
    return Rule(f"{key} whose {col} does not start at {value}", elsewhere, _at_most(0), (key,))


def joined(*parts: str) -> Column:
    cells = [F.col(part).cast("string") for part in parts]
    return F.concat(*[c for cell in cells for c in (F.lit("|"), cell)][1:])


def check(df: DataFrame, *rules: Rule) -> DataFrame:
    """``rule, observed, passed`` per rule: one aggregation for all plain rules, one per keyed rule."""
    plain = [rule for rule in rules if not rule.key]
    results = []
    if plain:
        measured = df.agg(*[rule.measure.cast("double").alias(f"_{i}") for i, rule in enumerate(plain)])
        results.append(
            measured.select(F.inline(F.array(*[_line(r, F.col(f"_{i}")) for i, r in enumerate(plain)])))
        )
    for rule in rules:
        if rule.key:
            groups = df.groupBy(*rule.key).agg(rule.measure.alias("_hit"))
            counted = groups.agg(F.count_if("_hit").cast("double").alias("_0"))
            results.append(counted.select(F.inline(F.array(_line(rule, F.col("_0"))))))
    return reduce(DataFrame.unionByName, results)


def _line(rule: Rule, observed: Column) -> Column:
    return F.struct(
        F.lit(rule.name).alias("rule"),
        observed.alias("observed"),
        F.coalesce(rule.passes(observed), F.lit(False)).alias("passed"),
    )


def multi_location_customers(customers: DataFrame) -> DataFrame:
    """How many people occur with more than one city and state."""
    places = customers.groupBy(PERSON).agg(
        F.countDistinct(joined("customer_city", "customer_state")).alias("_places")
    )
    return places.agg(F.count_if(F.col("_places") > 1).alias("customers_with_multiple_locations"))


def table_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def null_count(df: DataFrame, col: str = WHEN, out: str = "null_purchase_ts") -> DataFrame:
    return df.agg(F.count_if(F.col(col).isNull()).alias(out))


def value_range(
    df: DataFrame,
    col: str = "recency_days",
    low: str = "min_recency",
    high: str = "max_recency",
) -> DataFrame:
    return df.agg(F.min(col).alias(low), F.max(col).alias(high))


def repeat_customers(rfm: DataFrame) -> DataFrame:
    """People with more than one order."""
    return rfm.agg(F.count_if(F.col("frequency") > 1).alias("repeat_customers"))


def window_spend_means(features: DataFrame, windows: Sequence[int] = (30, 90, 180)) -> DataFrame:
    """People and their mean spend per trailing window."""
    return features.agg(
        F.count(F.lit(1)).alias("customers"),
        *[
            money_mean(F.col(f"spend_{days}d"), "decimal(20,6)", places=6).alias(
                f"avg_spend_{days}d"
            )
            for days in windows
        ],
    )


def window_activity(features: DataFrame, windows: Sequence[int] = (30, 90, 180)) -> DataFrame:
    """How many people ordered at all in each trailing window."""
    return features.agg(
        *[F.count_if(F.col(f"orders_{days}d") > 0).alias(f"active_{days}d") for days in windows]
    )
