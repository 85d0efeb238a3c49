"""Session settings for local runs; on a cluster the session comes from outside."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(
    cores: int | str = 8,
    partitions: int = 8,
    name: str = "holdfast",
    scratch: str | None = None,
) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for tables written between steps.

    The cluster names it in ``spark.checkpoint.dir``; a session without that setting
    uses its warehouse, which driver and executors share as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
