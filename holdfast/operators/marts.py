"""Lists, dimensions and dashboard measures built on scored people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import labels
from holdfast.functions.numbers import MEAN, amount_mean, amount_total, money_mean
from holdfast.operators.facts import LOCATION, PERSON
from holdfast.operators.ranking import global_ntile, top_n

TOP_AT_RISK = 500
TOP_TARGETS = 10


def marketing_target_list(scores: DataFrame, rfm: DataFrame, tiles: int = 3) -> DataFrame:
    """Priority and recommended action per scored person, from risk and value tiles.

    Equal scores are told apart by the person key, so the list is reproducible.
    """
    people = scores.select(PERSON, "segment_name", "churn_risk").join(
        rfm.select(PERSON, "monetary", "frequency", "avg_order_value", "tenure_days"), PERSON
    )
    ranked = global_ntile(people, [("churn_risk", "desc")], PERSON, tiles, "_risk")
    ranked = global_ntile(ranked, [("monetary", "desc")], PERSON, tiles, "_value")
    risk, value = F.col("_risk"), F.col("_value")
    return ranked.select(
        PERSON,
        "segment_name",
        "churn_risk",
        "monetary",
        "frequency",
        "avg_order_value",
        "tenure_days",
        labels.by_tiles(risk, value, labels.LIST_LABELS, labels.LIST_DEFAULT).alias("priority_band"),
        labels.by_tiles(risk, value, labels.LIST_ACTIONS, labels.ACTION_DEFAULT).alias(
            "recommended_action"
        ),
    )


def dim_customer(master: DataFrame, segments: DataFrame, scores: DataFrame) -> DataFrame:
    """The customer dimension: master data, segment and scores, one row per person."""
    # The columns that the dimension takes from the scores.
    scored = [
        "churned",
        "churn_risk",
        "value_at_risk",
        "risk_decile",
        "priority_band",
        "frequency",
        "monetary",
        "avg_order_value",
        "avg_items_per_order",
        "avg_category_diversity",
        "avg_days_between_orders",
        "orders_30d",
        "orders_90d",
        "spend_30d",
        "spend_90d",
    ]
    return (
        master.select(
            PERSON,
            *LOCATION,
            "first_order_ts",
            "last_order_ts",
            "total_delivered_orders",
            "tenure_days",
        )
        .join(segments.select(PERSON, "segment", "segment_name"), PERSON, "left")
        .join(scores.select(PERSON, *scored), PERSON, "left")
    )


def value_at_risk_by(scores: DataFrame, by: Sequence[str] = ("priority_band",)) -> DataFrame:
    """People, total and mean value at risk per group."""
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("customers"),
        amount_total(F.col("value_at_risk")).alias("total_value_at_risk"),
        amount_mean(F.col("value_at_risk")).alias("avg_value_at_risk"),
    )


def top_value_at_risk(scores: DataFrame, n: int = TOP_AT_RISK, band: str = "HIGH") -> DataFrame:
    """The ``n`` people of a priority band with the most value at risk."""
    return top_n(
        scores, [("value_at_risk", "desc"), (PERSON, "asc")], n, F.col("priority_band") == band
    )


def top_priority_targets(
    targets: DataFrame, n: int = TOP_TARGETS, band: str = "HIGH PRIORITY"
) -> DataFrame:
    """The ``n`` riskiest, then most valuable, people of a target-list band."""
    order = [("churn_risk", "desc"), ("monetary", "desc"), (PERSON, "asc")]
    return top_n(targets, order, n, F.col("priority_band") == band)


def count_by(df: DataFrame, by: str, out: str = "customers") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(out))


def executive_overview(customers: DataFrame) -> DataFrame:
    """Total people, revenue, churn rate and value at risk in one row."""
    return customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        amount_total(F.col("monetary")).alias("total_revenue"),
        F.avg("churned").alias("churn_rate"),
        amount_total(F.col("value_at_risk")).alias("total_value_at_risk"),
    )


def risk_distribution(scores: DataFrame) -> DataFrame:
    """Value at risk per priority band with the bands' shares of people and value."""
    bands = value_at_risk_by(scores)
    whole = Window.partitionBy()
    value = F.col("total_value_at_risk").cast("double")
    return bands.select(
        "*",
        (F.col("customers") / F.sum("customers").over(whole)).alias("customer_share"),
        (value / F.sum("total_value_at_risk").over(whole).cast("double")).alias("value_share"),
    )


def churn_by_segment(scores: DataFrame) -> DataFrame:
    """Churn rate and mean modelled risk per segment."""
    return scores.groupBy("segment_name").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("churned").alias("churn_rate"),
        F.avg("churn_risk").alias("avg_churn_risk"),
    )


def value_at_risk_matrix(
    scores: DataFrame, bands: Sequence[str] = ("HIGH", "MEDIUM", "LOW")
) -> DataFrame:
    """Value at risk per segment with one column per priority band."""
    sums = scores.groupBy("segment_name").pivot("priority_band", list(bands))
    return sums.agg(amount_total(F.col("value_at_risk"))).select(
        "segment_name", *[F.col(band).alias(f"{band.lower()}_value_at_risk") for band in bands]
    )


def order_value_by_segment(enriched: DataFrame) -> DataFrame:
    """Orders and mean order value per segment."""
    return (
        enriched.where(F.col("segment_name").isNotNull())
        .groupBy("segment_name")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            money_mean(F.col("gross_order_value"), MEAN).alias("avg_order_value"),
        )
    )


def risk_concentration(scores: DataFrame, bin_col: str = "risk_decile") -> DataFrame:
    """Share of value at risk per decile, and added up from the highest decile down.

    The windows run over one row per decile.
    """
    deciles = scores.groupBy(bin_col).agg(
        F.count(F.lit(1)).alias("customers"),
        amount_total(F.col("value_at_risk")).alias("total_value_at_risk"),
    )
    whole = F.sum("total_value_at_risk").over(Window.partitionBy()).cast("double")
    down = F.sum("total_value_at_risk").over(Window.orderBy(F.col(bin_col).desc())).cast("double")
    return deciles.select(
        "*",
        (F.col("total_value_at_risk").cast("double") / whole).alias("value_share"),
        (down / whole).alias("cumulative_share"),
    )
