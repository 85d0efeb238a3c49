"""Exact copies by progressive refinement, in DataFrame functions only.

Rows are told apart by length first, then by a hash of their first characters, and
only rows that still share both are read in full and hashed.  Each step hands the next
one a bit filter of fixed size, so no text and no list of keys is shuffled or
broadcast: the filter lets false candidates through and the full hash decides.
Counts are combined before the shuffle, so a group that holds a third of the table
costs one row per task; joining the answer back is a sort-merge join that adaptive
execution splits.

Defined results: a null text equals the empty text; rows are compared after no change;
of equal texts the row with the largest id stays.  Rows that repeat both id and text
count in the size and stay or go together; a row without an id cannot be named, so it
always stays.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import fresh, slot_filter, stored, with_slot_flag

PREFIX_CHARS = 256


@dataclass
class _Refined:
    """The table with its refinement columns, and the groups of two or more equal texts."""

    rows: DataFrame
    groups: DataFrame
    flag: str
    size: str
    full: str


def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _refine(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> _Refined:
    size, head, flag, full = (
        fresh(docs, n) for n in ("text_bytes", "head_hash", "may_repeat", "full_hash")
    )
    sized = docs.withColumn(size, F.octet_length(_body(text_col))).withColumn(
        head, F.xxhash64(F.substring(_body(text_col), 1, prefix_chars))
    )
    keys = stored(sized.select(size, head))
    lengths = keys.groupBy(size).count().where("count > 1")
    same_length = stored(slot_filter(lengths, [size]))
    heads = (
        with_slot_flag(keys, same_length, [size], flag)
        .where(F.col(flag))
        .groupBy(size, head)
        .count()
        .where("count > 1")
    )
    same_head = stored(slot_filter(heads, [size, head]))
    rows = with_slot_flag(sized, same_head, [size, head], flag).drop(head)
    read = rows.where(F.col(flag)).withColumn(full, F.unhex(F.sha2(_body(text_col), 256)))
    groups = stored(
        read.groupBy(F.col(size), F.col(full))
        .agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    return _Refined(rows, groups, flag, size, full)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """One row per input row: the id, the carried columns, ``keep_id``, ``group_size``, ``kept``."""
    found = _refine(docs, id_col, text_col, prefix_chars)
    out = [id_col, *carry]
    alone = found.rows.where(~F.col(found.flag)).select(
        *out,
        F.col(id_col).alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
    )
    left = (
        found.rows.where(F.col(found.flag))
        .withColumn(found.full, F.unhex(F.sha2(_body(text_col), 256)))
        .select(*out, found.size, found.full)
        .alias("a")
    )
    joined = left.join(
        found.groups.alias("b"),
        (F.col(f"a.{found.size}") == F.col(f"b.{found.size}"))
        & (F.col(f"a.{found.full}") == F.col(f"b.{found.full}")),
        "left",
    )
    mine = F.col(f"a.{id_col}")
    several = F.col("b.group_size").isNotNull()
    keep = F.when(several, F.col("b.keep_id")).otherwise(mine)
    settled = joined.select(
        *[F.col(f"a.{c}") for c in out],
        keep.alias("keep_id"),
        F.coalesce(F.col("b.group_size"), F.lit(1).cast("long")).alias("group_size"),
        (mine.isNull() | (keep == mine)).alias("kept"),
    )
    return alone.unionByName(settled)


def drop_exact_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """The rows that stay, with all their columns.  An id names a row together with its text,
    so rows that share an id with a copy that goes, but not its text, stay."""
    found = _refine(docs, id_col, text_col, prefix_chars)
    mine, keep = fresh(found.rows, "group_hash"), fresh(found.rows, "group_keep")
    groups = found.groups.select(
        F.col(found.size).alias(f"{mine}_size"), F.col(found.full).alias(mine), F.col("keep_id").alias(keep)
    )
    rest = found.rows.where(F.col(found.flag)).withColumn(found.full, F.unhex(F.sha2(_body(text_col), 256)))
    same = (F.col(found.size) == F.col(f"{mine}_size")) & (F.col(found.full) == F.col(mine))
    goes = F.col(keep).isNotNull() & F.col(id_col).isNotNull() & (F.col(id_col) != F.col(keep))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    stay = rest.join(groups, same, "left").where(~goes).select(*columns)
    return found.rows.where(~F.col(found.flag)).select(*columns).unionByName(stay)
