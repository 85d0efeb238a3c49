"""Command line, for spark-submit or a local run.

    python -m holdfast load      RAW_DIR WAREHOUSE [--pattern "{table}.csv"]
    python -m holdfast refresh   WAREHOUSE [--status delivered] [--clusters 5] [--as-of 2018-12-31]
                                           [--duplicates raise|drop]
    python -m holdfast choose-k  WAREHOUSE
    python -m holdfast verify    WAREHOUSE

WAREHOUSE is a folder; with --catalog it is left out and tables are kept in the session
catalog, bucketed by person with --buckets N.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from holdfast.operators import segments
from holdfast.plans.refresh import load_raw, refresh, verify
from holdfast.sources.csv import read_raw
from holdfast.sources.snapshots import CatalogSnapshotStore, SnapshotStore

REPORTS = (
    "churn_class_balance",
    "churn_model_report",
    "churn_decile_lift",
    "value_at_risk_by_band",
    "executive_overview",
    "risk_distribution",
)


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="holdfast")
    commands = parser.add_subparsers(dest="command", required=True)
    parsers = {name: commands.add_parser(name) for name in ("load", "refresh", "choose-k", "verify")}
    parsers["load"].add_argument("raw")
    for command in parsers.values():
        command.add_argument("warehouse", nargs="?")
        command.add_argument("--catalog", action="store_true")
        command.add_argument("--buckets", type=int, default=0)
    parsers["load"].add_argument("--pattern", default="{table}.csv")
    build = parsers["refresh"]
    build.add_argument("--status", default="delivered")
    build.add_argument("--clusters", type=int, default=segments.CLUSTERS)
    build.add_argument("--seed", type=int, default=segments.SEED)
    build.add_argument("--as-of")
    build.add_argument("--duplicates", choices=("raise", "drop"), default="raise")
    args = parser.parse_args(argv)
    if bool(args.warehouse) == args.catalog:
        parser.error("give a WAREHOUSE folder or --catalog")
    return args


def main(argv: list[str]) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("holdfast").getOrCreate()
    store = CatalogSnapshotStore(spark, args.buckets) if args.catalog else SnapshotStore(spark, args.warehouse)
    if args.command == "load":
        counts = load_raw(read_raw(spark, args.raw, args.pattern), store)
    elif args.command == "refresh":
        counts = refresh(store, args.status, args.clusters, args.seed, args.as_of, args.duplicates)
        for table in REPORTS:
            print(table)
            store.read("analytics", table).show(50, truncate=False)
    elif args.command == "choose-k":
        people = store.read("analytics", "customer_rfm")
        scaled = segments.standardize(segments.prepare_rfm_features(people))
        scores = segments.choose_k(scaled, [f"{name}_z" for name in segments.FEATURES])
        counts = {f"k={k}": round(score, 4) for k, score in scores}
    else:
        report = verify(store).persist()
        try:
            report.show(100, truncate=False)
            return 0 if report.where("NOT passed").isEmpty() else 1
        finally:
            report.unpersist()
    for name, value in counts.items():
        print(f"{name}: {value}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
