"""Full refresh of the analytics layer, in dependency order.

Each step is written beside the current table and read back before the next one uses
it, so later steps start from stored columns instead of a long lineage, several
readers share one computation, and a lost executor costs at most one step.  The
tables are published at the end: a step that fails, say on tied risk bands, leaves the
analytics layer as it was.  With the stores of ``sources.snapshots`` they are published in
one step, and the raw layer is read as of one moment.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators import calendar, churn, cohorts, facts, marts, quality, rfm, segments, windows
from holdfast.operators.facts import PERSON


def load_raw(raw: Mapping[str, DataFrame], store) -> dict[str, int]:
    """Replace the raw layer; returns the rows loaded per table."""
    counts = {table: store.stage(df, "raw", table)[1] for table, df in raw.items()}
    store.publish("raw", counts)
    return counts


def refresh(
    store,
    delivered_status: str = "delivered",
    clusters: int = segments.CLUSTERS,
    seed: int = segments.SEED,
    as_of: date | str | None = None,
    duplicates: str = "raise",
) -> dict[str, int]:
    """Rebuild every analytics table from the raw layer; returns row counts per table.

    ``duplicates`` says what equal edges of the risk and value bins do: "raise" or "drop".
    """
    counts: dict[str, int] = {}

    def keep(table: str, df: DataFrame, key: str | None = PERSON) -> DataFrame:
        stored, counts[table] = store.stage(df, "analytics", table, key)
        return stored

    source = store.snapshot("raw")
    raw = {
        name: source.read(name)
        for name in ("customers", "orders", "order_items", "order_payments", "products", "order_reviews")
    }
    delivered = facts.delivered_orders(raw["orders"], delivered_status)
    master = keep("customer_master", facts.customer_master(delivered, raw["customers"]))
    orders = keep(
        "customer_orders",
        facts.customer_orders(
            delivered,
            facts.customer_identity_map(raw["customers"]),
            raw["order_items"],
            raw["products"],
            raw["order_payments"],
            raw["order_reviews"],
        ),
    )
    people = keep("customer_rfm", rfm.customer_rfm(orders))
    recent = keep("customer_time_features", windows.time_features(orders))
    cohort = keep("customer_cohort", cohorts.customer_cohort(orders))
    retention = keep("cohort_retention", cohorts.cohort_retention(cohort), None)
    keep("retention_curve", cohorts.retention_curve(retention), None)
    keep("cohort_heatmap", cohorts.cohort_heatmap(retention), None)
    if source.has("category_translation"):
        lookup = source.read("category_translation")
        keep("products_translated", facts.translate_category(raw["products"], lookup), None)

    assigned, profile = segments.segment_customers(people, clusters, seed)
    labelled = keep("customer_segments", assigned)
    keep("segment_profile", profile, None)
    by_segment = keep(
        "cohort_retention_by_segment", cohorts.cohort_retention_by(cohort, labelled), None
    )
    keep("segment_retention_curve", cohorts.retention_curve(by_segment, ["segment_name"]), None)
    enriched = keep("customer_orders_enriched", facts.orders_enriched(orders, labelled))
    keep("segment_kpis", segments.segment_kpis(enriched, as_of), None)
    keep("segment_actions", segments.segment_actions(enriched.sparkSession), None)
    keep("order_value_by_segment", marts.order_value_by_segment(enriched), None)
    days = keep("dim_date", calendar.dim_date(enriched), None)
    keep("orders_calendar", facts.orders_calendar(enriched, days, cohort))

    frame = churn.label_churn(churn.impute_training(churn.training_frame(people, labelled, recent)))
    trainable = keep("churn_training", frame)
    keep("churn_class_balance", churn.class_balance(trainable), None)
    scored, auc, report, auc_without = churn.evaluate_churn(trainable)
    aucs = {"roc_auc": F.lit(auc), "roc_auc_without_recent": F.lit(auc_without)}
    keep("churn_model_report", report.withColumns(aucs), None)
    risky = keep("churn_risk", churn.value_at_risk(scored))
    deciled = churn.risk_decile(risky, duplicates=duplicates)
    banded = churn.priority_band(deciled, duplicates=duplicates)
    scores = keep("customer_churn_scores", churn.churn_scores(banded))
    keep("churn_decile_lift", churn.decile_lift(scores), None)
    keep("value_at_risk_by_band", marts.value_at_risk_by(scores), None)
    keep("value_at_risk_matrix", marts.value_at_risk_matrix(scores), None)
    keep("executive_overview", marts.executive_overview(scores), None)
    keep("risk_distribution", marts.risk_distribution(scores), None)
    keep("churn_by_segment", marts.churn_by_segment(scores), None)
    keep("risk_concentration", marts.risk_concentration(scores), None)
    keep("marketing_target_list", marts.marketing_target_list(scores, people))
    keep("dim_customer", marts.dim_customer(master, labelled, scores))
    store.publish("analytics", counts)
    return counts


def verify(store) -> DataFrame:
    """The standing checks on a refreshed analytics layer: ``table_name, rule, observed, passed``."""
    plans = {
        "customer_master": [quality.row_count("rows"), quality.unique(PERSON)],
        "customer_orders": [
            quality.row_count("rows"),
            quality.unique("order_id"),
            quality.no_nulls("order_purchase_timestamp"),
        ],
        "customer_rfm": [
            quality.row_count("rows"),
            quality.unique(PERSON),
            quality.within("recency_days", 0, 100_000),
        ],
        "cohort_retention": [quality.starts_at("month_index", "cohort_month")],
        "dim_date": [quality.row_count("rows"), quality.unique("date")],
    }
    current = store.snapshot("analytics")
    reports = [
        quality.check(current.read(table), *rules).select(
            F.lit(table).alias("table_name"), "*"
        )
        for table, rules in plans.items()
    ]
    return reduce(DataFrame.unionByName, reports)
