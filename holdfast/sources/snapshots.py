"""Stores whose readers always see one whole version of a layer.

Every write of a table goes to a place of its own.  What a layer consists of is one small
record that maps table names to their newest places; it is written last, in one step.  A
reader takes the record once and then reads only what it names, so during a refresh, or
after one that crashed between two tables, it sees the version before as a whole.  Older places
stay until ``prune`` removes them, so queries that are running are not cut off.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Mapping
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from holdfast.sources.store import create_layers

RECORDS = "_snapshots"
PROPERTY = "holdfast.snapshot"


class Snapshot:
    """The tables of a layer as one record names them."""

    def __init__(self, places: Mapping[str, str], reader) -> None:
        self.places, self._reader = dict(places), reader

    def has(self, table: str) -> bool:
        return table in self.places

    def read(self, table: str) -> DataFrame:
        if table not in self.places:
            raise KeyError(f"the layer has no table {table}")
        return self._reader(self.places[table])


class _Versioned:
    """What both stores share: staging, replacing and reading through the record."""

    def __init__(self) -> None:
        self._staged: dict[tuple[str, str], str] = {}

    def snapshot(self, layer: str) -> Snapshot:
        return Snapshot(self._record(layer)[1], self._read_place)

    def has(self, layer: str, table: str) -> bool:
        return self.snapshot(layer).has(table)

    def read(self, layer: str, table: str) -> DataFrame:
        return self.snapshot(layer).read(table)

    def stage(self, df: DataFrame, layer: str, table: str, key: str | None = None) -> tuple[DataFrame, int]:
        """Writes a table to a new place; as stored there, with its row count."""
        place = f"{table}__{uuid4().hex[:12]}"
        self._write(df, layer, place, key)
        self._staged[layer, table] = self._place(layer, place)
        stored = self._read_place(self._staged[layer, table])
        return stored, stored.count()

    def publish(self, layer: str, tables: Iterable[str]) -> None:
        """All staged tables become current together."""
        new = {table: self._staged[layer, table] for table in tables}
        number, places = self._record(layer)
        self._put(layer, number + 1, places | new)
        for table in new:
            del self._staged[layer, table]

    def promote(self, layer: str, table: str) -> None:
        self.publish(layer, [table])

    def replace(self, df: DataFrame, layer: str, table: str, key: str | None = None) -> tuple[DataFrame, int]:
        _, rows = self.stage(df, layer, table, key)
        self.publish(layer, [table])
        return self.read(layer, table), rows


class SnapshotStore(_Versioned):
    """Parquet directories ``root/layer/table__id`` and numbered records beside them.

    A record is written under a name of its own and renamed to its number; the rename fails
    if another refresh took that number first, and nothing of the later one is published.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__()
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _place(self, layer: str, place: str) -> str:
        return f"{self.root}/{layer}/{place}"

    def _write(self, df: DataFrame, layer: str, place: str, key: str | None) -> None:
        df.write.parquet(self._place(layer, place))

    def _read_place(self, place: str) -> DataFrame:
        return self.spark.read.parquet(place)

    def _numbers(self, layer: str) -> list[int]:
        files, folder = self._files(), self._path(layer, RECORDS)
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _load(self, layer: str, number: int) -> dict[str, str]:
        stream = self._files().open(self._path(layer, RECORDS, f"{number:012d}.json"))
        try:
            text = self.spark._jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A").next()
        finally:
            stream.close()
        return {table: self._place(layer, place) for table, place in json.loads(text).items()}

    def _record(self, layer: str) -> tuple[int, dict[str, str]]:
        numbers = self._numbers(layer)
        return (numbers[-1], self._load(layer, numbers[-1])) if numbers else (0, {})

    def _put(self, layer: str, number: int, places: Mapping[str, str]) -> None:
        text = json.dumps({table: place.rsplit("/", 1)[1] for table, place in sorted(places.items())})
        files = self._files()
        draft = self._path(layer, RECORDS, f"draft-{uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        final = self._path(layer, RECORDS, f"{number:012d}.json")
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise OSError(f"another refresh of {layer} was published first")

    def prune(self, layer: str, keep: int = 2, hours: float = 24.0) -> list[str]:
        """Removes places that none of the ``keep`` newest records names and that are older
        than ``hours`` (younger ones may belong to a refresh under way); their names."""
        files, numbers = self._files(), self._numbers(layer)
        named = {place for number in numbers[-keep:] for place in self._load(layer, number).values()}
        gone = []
        before = (time.time() - 3600 * hours) * 1000
        for status in files.listStatus(self._path(layer)):
            name = status.getPath().getName()
            if "__" in name and self._place(layer, name) not in named and status.getModificationTime() < before:
                files.delete(status.getPath(), True)
                gone.append(name)
        for number in numbers[:-keep]:
            files.delete(self._path(layer, RECORDS, f"{number:012d}.json"), False)
        return sorted(gone)


class CatalogSnapshotStore(_Versioned):
    """Managed tables ``layer.table__id``; the record is a property of the layer's database.

    ``layer.table`` is a view of the current place for SQL users; views follow the record one
    after the other, each replaced in one step.
    """

    def __init__(self, spark: SparkSession, buckets: int = 0) -> None:
        super().__init__()
        self.spark, self.buckets = spark, buckets
        create_layers(spark)

    def _place(self, layer: str, place: str) -> str:
        return f"{layer}.{place}"

    def _write(self, df: DataFrame, layer: str, place: str, key: str | None) -> None:
        writer = df.write
        if key and self.buckets:
            writer = writer.bucketBy(self.buckets, key).sortBy(key)
        writer.format("parquet").saveAsTable(f"{layer}.{place}")

    def _read_place(self, place: str) -> DataFrame:
        return self.spark.table(place)

    def _record(self, layer: str) -> tuple[int, dict[str, str]]:
        rows = self.spark.sql(f"DESCRIBE DATABASE EXTENDED {layer}").collect()
        text = next((r["info_value"] for r in rows if r["info_name"] == "Properties"), "")
        at = text.find(f"({PROPERTY},")
        if at < 0:
            return 0, {}
        number, *pairs = text[at + len(PROPERTY) + 2 : text.index(")", at)].split(";")
        return int(number), {t: f"{layer}.{t}__{v}" for t, v in (p.split(":") for p in pairs)}

    def _put(self, layer: str, number: int, places: Mapping[str, str]) -> None:
        pairs = [f"{table}:{place.rsplit('__', 1)[1]}" for table, place in sorted(places.items())]
        text = ";".join([str(number), *pairs])
        self.spark.sql(f"ALTER DATABASE {layer} SET DBPROPERTIES ('{PROPERTY}' = '{text}')")
        for table, place in places.items():
            self.spark.sql(f"CREATE OR REPLACE VIEW {layer}.{table} AS SELECT * FROM {place}")

    def prune(self, layer: str) -> list[str]:
        """Drops places of published tables that the record no longer names; their names."""
        _, places = self._record(layer)
        staged = {place.split(".", 1)[1] for place in self._staged.values()}
        gone = []
        for row in self.spark.sql(f"SHOW TABLES IN {layer}").collect():
            name = row["tableName"]
            table = name.rsplit("__", 1)[0]
            if "__" in name and table in places and f"{layer}.{name}" != places[table] and name not in staged:
                self.spark.sql(f"DROP TABLE {layer}.{name}")
                gone.append(name)
        return sorted(gone)
