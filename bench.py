"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from checks.catalog import QUERIES
from holdfast.session import local_session

HEADLINES = [
    "delivered_orders",
    "customer_master",
    "order_basket_rollup",
    "customer_orders",
    "customer_rfm",
    "customer_rfm_accounts",
    "interpurchase_gaps_orders",
    "time_features",
    "time_features_customer_last",
    "orders_enriched",
    "orders_calendar",
    "customer_cohort",
    "cohort_retention",
    "cohort_retention_by_segment",
    "dim_date",
    "segment_kpis",
    "global_ntile",
    "quantile_bins",
    "prepare_rfm_features",
    "standardize",
    "profile_segments",
    "kmeans_segments",
    "training_frame",
    "impute_training",
    "stratified_split",
    "roc_auc",
    "risk_decile",
    "priority_band",
    "churn_scores",
    "churn_model_scores",
    "marketing_target_list",
    "value_at_risk_by_band",
    "dim_customer",
    "quality_check",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").count().write.format(
        "noop"
    ).mode("overwrite").save()
    seconds = {}
    for name in chosen:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
