"""Shared helpers: names that cannot clash, stored intermediate tables, bounded filters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BITS = 64
# Fixed size of the slot filter: 2**22 bits are 65,536 rows of one long, whatever the data.
FILTER_WORDS = 1 << 16
BATCH_BYTES = 4 << 20


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    Its parent is ``spark.checkpoint.dir``; where that is unset, as in tests, the
    warehouse, which every session has and which is shared too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/holdfast-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch, on both sides of the pipe
    to Python; by default only rows are limited well, and texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark.conf.get(name).removesuffix("b")
    if not limit.isdigit() or int(limit) > most:
        spark.conf.set(name, str(most))


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the frame to a shared folder and reads it back: later jobs start from the
    files, so a lost executor costs no earlier stage again."""
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slot_filter(df: DataFrame, keys: list[str], words: int = FILTER_WORDS) -> DataFrame:
    """Bits of the hashed keys that occur, as at most ``words`` rows (word, bits)."""
    return df.groupBy(F.expr(f"{slot_sql(keys, words)} div {WORD_BITS}").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({slot_sql(keys, words)} % {WORD_BITS} as int))")).alias("bits")
    )


def slot_sql(keys: list[str], words: int) -> str:
    quoted = ", ".join(f"`{k}`" for k in keys)
    return f"pmod(xxhash64({quoted}), {words * WORD_BITS}L)"


def with_slot_flag(
    df: DataFrame, flags: DataFrame, keys: list[str], flag: str, words: int = FILTER_WORDS
) -> DataFrame:
    """Adds ``flag``: false only for keys that are surely not in the filter.

    The broadcast side has at most ``words`` rows whatever the data; the more keys it
    holds, the more rows pass it, so callers still decide exactly afterwards.
    """
    word, bits = fresh(df, "slot_word"), fresh(df, "slot_bits")
    small = F.broadcast(flags.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    probe = F.expr(f"shiftright(`{bits}`, cast({slot_sql(keys, words)} % {WORD_BITS} as int)) & 1")
    return (
        df.withColumn(word, F.expr(f"{slot_sql(keys, words)} div {WORD_BITS}"))
        .join(small, word, "left")
        .withColumn(flag, F.coalesce(probe == 1, F.lit(False)))
        .drop(word, bits)
    )


def without_ids(docs: DataFrame, lost: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not in ``lost`` (one column), with all their columns.

    Only rows that pass the bit filter of the lost ids are shuffled; the others are
    passed on by the scan.  Rows with a null id always stay.
    """
    lost = stored(lost.select(F.col(id_col).alias("lost_id")).where("lost_id is not null").distinct())
    flag, gone = fresh(docs, "may_go"), fresh(docs, "lost_id")
    bits = slot_filter(lost, ["lost_id"])
    probed = with_slot_flag(docs, stored(bits), [id_col], flag)
    lost = lost.select(F.col("lost_id").alias(gone))
    rest = probed.where(F.col(flag)).join(lost, F.col(id_col) == F.col(gone), "left_anti")
    return probed.where(~F.col(flag)).unionByName(rest).select(*[F.col(f"`{c}`") for c in docs.columns])
