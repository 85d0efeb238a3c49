"""Versioned layers: whole versions for readers, whatever happens to a refresh."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from holdfast.sources.snapshots import CatalogSnapshotStore, SnapshotStore


@pytest.fixture(params=["path", "catalog"])
def store(request, spark, tmp_path):
    if request.param == "path":
        yield SnapshotStore(spark, str(tmp_path))
        return
    made = CatalogSnapshotStore(spark, buckets=2)
    yield made
    for row in spark.sql("SHOW TABLES IN analytics").collect():
        kind = "VIEW" if "__" not in row["tableName"] else "TABLE"
        spark.sql(f"DROP {kind} IF EXISTS analytics.{row['tableName']}")
    spark.sql("ALTER DATABASE analytics SET DBPROPERTIES ('holdfast.snapshot' = '0')")


def version(spark, n):
    return spark.range(n).withColumn("v", F.lit(n))


def rows(at, *tables):
    return [at.read(t).count() for t in tables]


def test_a_crash_between_two_tables_shows_the_version_before(spark, store):
    for table in ("snap_a", "snap_b"):
        store.stage(version(spark, 3), "analytics", table, "id")
    assert not store.has("analytics", "snap_a")
    store.publish("analytics", ["snap_a", "snap_b"])
    reader = store.snapshot("analytics")
    store.stage(version(spark, 5), "analytics", "snap_a", "id")
    assert rows(store.snapshot("analytics"), "snap_a", "snap_b") == [3, 3]
    store.stage(version(spark, 5), "analytics", "snap_b", "id")
    store.publish("analytics", ["snap_a", "snap_b"])
    assert rows(store.snapshot("analytics"), "snap_a", "snap_b") == [5, 5]
    assert rows(reader, "snap_a", "snap_b") == [3, 3]  # still reads what it began with
    with pytest.raises(KeyError, match="snap_c"):
        reader.read("snap_c")


def test_a_failed_write_publishes_nothing(spark, store):
    store.replace(version(spark, 4), "analytics", "snap_a")
    with pytest.raises(Exception, match="(?i)divi"):
        store.replace(spark.range(5).selectExpr("1 div (id - 3) AS id"), "analytics", "snap_a")
    assert store.read("analytics", "snap_a").count() == 4


def test_prune_keeps_what_is_named(spark, store):
    for n in (1, 2, 3):
        store.replace(version(spark, n), "analytics", "snap_a")
    store.stage(version(spark, 9), "analytics", "snap_b")
    if isinstance(store, SnapshotStore):
        assert store.prune("analytics") == []  # all are young
        before = store.snapshot("analytics")
        gone = store.prune("analytics", keep=2, hours=-1)
        assert len(gone) == 2 and any(g.startswith("snap_b__") for g in gone)
        assert rows(before, "snap_a") == [3]
    else:
        assert len(store.prune("analytics")) == 2
        store.publish("analytics", ["snap_b"])
        assert spark.sql("SELECT count(*) FROM analytics.snap_b").first()[0] == 9
        assert spark.sql("SELECT max(v) FROM analytics.snap_a").first()[0] == 3


def test_two_refreshes_at_once(spark, tmp_path):
    one, two = (SnapshotStore(spark, str(tmp_path)) for _ in range(2))
    one.stage(version(spark, 1), "analytics", "a")
    two.stage(version(spark, 2), "analytics", "a")
    record = two._record
    two._record = lambda layer, seen=record("analytics"): seen  # looked before the other published
    one.publish("analytics", ["a"])
    with pytest.raises(OSError, match="published first"):
        two.publish("analytics", ["a"])
    assert one.read("analytics", "a").count() == 1
