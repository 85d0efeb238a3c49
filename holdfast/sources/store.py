"""Table storage: two layers, full-replace writes, row counts.

``PathStore`` keeps Parquet under ``root/layer/table`` and needs no catalog;
``CatalogStore`` keeps managed tables ``layer.table`` and can bucket them by a
key, so that later joins and groupings on that key start without a shuffle.  Both replace
table by table; the stores of ``snapshots`` replace all tables of a refresh at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

LAYERS = ("raw", "analytics")


def create_layers(spark: SparkSession, layers: Sequence[str] = LAYERS) -> None:
    for layer in layers:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}")


def register_view(df: DataFrame, name: str) -> DataFrame:
    """A session view over a lazy DataFrame."""
    df.createOrReplaceTempView(name)
    return df


NEXT = "__next"


class Live:
    """A layer as it is at the moment of each read."""

    def __init__(self, store: PathStore | CatalogStore, layer: str) -> None:
        self.store, self.layer = store, layer

    def has(self, table: str) -> bool:
        return self.store.has(self.layer, table)

    def read(self, table: str) -> DataFrame:
        return self.store.read(self.layer, table)


class PathStore:
    """Parquet directories under one root shared by the cluster.

    A table is written beside the one it replaces and takes its place once it is
    complete, so a failed write leaves the old table as it was.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"

    def _file_system(self):
        base = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return base.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, layer: str, table: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path(layer, table))

    def has(self, layer: str, table: str) -> bool:
        return self._file_system().exists(self._path(layer, table))

    def stage(
        self, df: DataFrame, layer: str, table: str, key: str | None = None
    ) -> tuple[DataFrame, int]:
        """Write a table beside the current one; as stored, with its row count.

        Counting stored Parquet reads file footers only, no column data.
        """
        df.write.mode("overwrite").parquet(self.path(layer, table + NEXT))
        stored = self.read(layer, table + NEXT)
        return stored, stored.count()

    def promote(self, layer: str, table: str) -> None:
        """The staged table takes the place of the current one."""
        files = self._file_system()
        staged, current, old = (self._path(layer, table + end) for end in (NEXT, "", "__old"))
        files.delete(old, True)
        if files.exists(current):
            files.rename(current, old)
        if not files.rename(staged, current):
            files.rename(old, current)
            raise OSError(f"{table} could not be replaced")
        files.delete(old, True)

    def snapshot(self, layer: str) -> Live:
        return Live(self, layer)

    def publish(self, layer: str, tables: Iterable[str]) -> None:
        """Staged tables take their places one after the other."""
        for table in tables:
            self.promote(layer, table)

    def replace(
        self, df: DataFrame, layer: str, table: str, key: str | None = None
    ) -> tuple[DataFrame, int]:
        """Replace a table, and return it as stored with its row count."""
        _, rows = self.stage(df, layer, table, key)
        self.promote(layer, table)
        return self.read(layer, table), rows

    def read(self, layer: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(layer, table))


class CatalogStore:
    """Managed tables in the session catalog, bucketed by key on request."""

    def __init__(self, spark: SparkSession, buckets: int = 0) -> None:
        self.spark, self.buckets = spark, buckets
        create_layers(spark)

    def has(self, layer: str, table: str) -> bool:
        return self.spark.catalog.tableExists(f"{layer}.{table}")

    def stage(
        self, df: DataFrame, layer: str, table: str, key: str | None = None
    ) -> tuple[DataFrame, int]:
        writer = df.write.mode("overwrite")
        if key and self.buckets:
            writer = writer.bucketBy(self.buckets, key).sortBy(key)
        writer.format("parquet").saveAsTable(f"{layer}.{table}{NEXT}")
        stored = self.read(layer, table + NEXT)
        return stored, stored.count()

    def promote(self, layer: str, table: str) -> None:
        """The staged table takes the name; the one before is dropped once that is done."""
        name, old = f"{layer}.{table}", f"{layer}.{table}__old"
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        replaced = self.has(layer, table)
        if replaced:
            self.spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
        try:
            self.spark.sql(f"ALTER TABLE {name}{NEXT} RENAME TO {name}")
        except Exception:
            if replaced:
                self.spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
            raise
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")

    def snapshot(self, layer: str) -> Live:
        return Live(self, layer)

    def publish(self, layer: str, tables: Iterable[str]) -> None:
        """Staged tables take their names one after the other."""
        for table in tables:
            self.promote(layer, table)

    def replace(
        self, df: DataFrame, layer: str, table: str, key: str | None = None
    ) -> tuple[DataFrame, int]:
        _, rows = self.stage(df, layer, table, key)
        self.promote(layer, table)
        return self.read(layer, table), rows

    def read(self, layer: str, table: str) -> DataFrame:
        return self.spark.table(f"{layer}.{table}")

    def create_view(self, layer: str, name: str, query: str) -> DataFrame:
        """A view over stored tables, replaced if it is there."""
        self.spark.sql(f"CREATE OR REPLACE VIEW {layer}.{name} AS {query}")
        return self.read(layer, name)
