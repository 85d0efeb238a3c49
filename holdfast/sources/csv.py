"""CSV ingest with fixed contracts."""

from __future__ import annotations

import csv
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from holdfast.sources.contracts import FREE_TEXT, RAW, schema_of
from holdfast.sources.records import records_and_heads

BYTE_ORDER_MARK = "\ufeff"


def read_csv(spark: SparkSession, table: str, path: str | list[str]) -> DataFrame:
    """A headered CSV file, or directory of files, as the named raw table.

    Columns go by the names in the header, in whatever order it has them; a missing,
    doubled or unknown name is an error.  Files of one directory share one order.
    Quotes are escaped by doubling.  Tables with free text may have line breaks inside
    quotes; their files are split at true record ends (see ``records``).  A value that does
    not fit its type is an error rather than a silent NULL.
    """
    contract = schema_of(table)
    reader = spark.read.option("header", True).option("escape", '"').option("mode", "FAILFAST")
    if table in FREE_TEXT:
        reader = reader.option("multiLine", True)
    header = reader.csv(path).columns  # reads the first line only, all columns as text
    names = [name.removeprefix(BYTE_ORDER_MARK).strip() for name in header]
    if sorted(names) != sorted(contract.names):
        missing, unknown = set(contract.names) - set(names), set(names) - set(contract.names)
        raise ValueError(f"{table}: header lacks {sorted(missing)}, has unknown {sorted(unknown)}: {header}")
    found = StructType([contract[name] for name in names])
    if table in FREE_TEXT:
        return _free_text(spark, path, found, header).select(*contract.names)
    if names == header:
        reader = reader.option("enforceSchema", False)  # every file's header is compared
    return reader.schema(found).csv(path).select(*contract.names)


def _free_text(spark: SparkSession, path: str | list[str], schema: StructType, header: list[str]) -> DataFrame:
    """The rows of files with line breaks inside quotes; every file's header is compared."""
    records, heads = records_and_heads(spark, path)
    names = [name.removeprefix(BYTE_ORDER_MARK).strip() for name in header]
    for head in heads:
        found = next(csv.reader([head.removeprefix(BYTE_ORDER_MARK).rstrip("\r")]), [])
        if [name.strip() for name in found] != names:
            raise ValueError(f"files have different headers: {found} and {names}")
    # where records end in CR LF, Spark reads that as one line break inside quotes too
    text = F.regexp_replace("record", "\r\n", "\n") if any(h.endswith("\r") for h in heads) else F.col("record")
    options = {"escape": '"', "mode": "FAILFAST"}
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parsed = F.from_csv(F.rtrim(text, F.lit("\r")), kinds, options)
    rows = records.where(~F.col("first") & ~F.col("record").isin("", "\r"))
    return rows.select(parsed.alias("row")).select("row.*")


def read_raw(
    spark: SparkSession,
    root: str,
    pattern: str = "{table}.csv",
    tables: Iterable[str] | None = None,
) -> dict[str, DataFrame]:
    """The raw tables under ``root``, all unless named; ``pattern`` names the file of a table."""
    names = list(tables) if tables is not None else list(RAW)
    return {
        table: read_csv(spark, table, f"{root.rstrip('/')}/{pattern.format(table=table)}")
        for table in names
    }
