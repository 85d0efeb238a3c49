"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# Keys under this share of the rows are left to the runtime's own skew handling, so that a sketch
# has a fixed size however many partitions there are.
MOST_SHARES = 2048
TRACKED_PER_SHARE, LEAST_TRACKED = 16, 128
SKETCH_GROUPS = 64
REMEMBERED = 64
_FOUND: OrderedDict[tuple, tuple[list[tuple], bool]] = OrderedDict()


def hot_keys(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Keys with more rows than an average partition, and into how many shares to cut them.

    A key is hot when it holds more than one ``partitions``-th of the rows, so
    there are fewer than ``partitions`` hot keys however many rows ``df`` has, and
    their shares add up to less than twice that.  Both are always small enough to
    broadcast.
    """
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    average = counted.agg((F.sum("_n") / partitions).alias("_average")).scalar()
    shares = F.ceil(F.col("_n") / average).cast("int")
    return counted.select(key, shares.alias("_shares")).where(F.col("_shares") > 1)


def heavy_keys(df: DataFrame, key: str, partitions: int) -> tuple[list[tuple], bool]:
    """(key, shares) of the hot keys as in ``hot_keys``, and whether rows without a key pile up.

    Tasks send frequent-item sketches of a fixed size instead of a count per key.  A sketch
    of 16 items a share is off by less than a quarter of a share, so every key with more
    than a share of the rows is among the items with three quarters of one; only those are
    counted exactly, in a second scan that is left out if there are none.  The answer is a
    short list of literals, so both sides of a join deal alike; it is remembered per plan and key.
    """
    spark = df.sparkSession
    name = (id(spark), df.semanticHash(), key, partitions)
    if name in _FOUND:
        _FOUND.move_to_end(name)
        return _FOUND[name]
    parts = min(partitions, MOST_SHARES)
    tracked = max(LEAST_TRACKED, TRACKED_PER_SHARE * parts)
    keys = df.select(F.col(key).alias("_key"))
    # one row without a key, so that there is a sketch even of an empty table
    keys = keys.unionAll(spark.range(1).select(F.lit(None).cast(keys.schema["_key"].dataType).alias("_key")))
    sketches = keys.groupBy((F.spark_partition_id() % SKETCH_GROUPS).alias("_group")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_key").alias("known"),
        F.expr(f"approx_top_k_accumulate(_key, {tracked}) FILTER (WHERE _key IS NOT NULL)").alias("sketch"),
    )
    row = sketches.agg(
        (F.sum("n") - 1).alias("n"),
        F.sum("known").alias("known"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {2 * parts})").alias("items"),
    ).first()
    often = [i["item"] for i in row["items"] or () if i["item"] is not None and 4 * parts * i["count"] >= 3 * row["known"]]
    hot: list[tuple] = []
    if often:
        counted = df.where(F.col(key).isin(often)).groupBy(key).count().collect()
        average = row["known"] / partitions
        hot = sorted((r[0], -int(-r["count"] // average)) for r in counted if r["count"] > max(average, row["known"] / parts))
    _FOUND[name] = hot, parts * (row["n"] - row["known"]) > row["n"]
    while len(_FOUND) > REMEMBERED:
        _FOUND.popitem(last=False)
    return _FOUND[name]


def skew_join(
    facts: DataFrame,
    other: DataFrame,
    key: str,
    how: str = "inner",
    spread: list[str] | None = None,
    counted_on: DataFrame | None = None,
) -> DataFrame:
    """Equi-join of a fact table that may have hot keys with a per-key table.

    Fact rows of a hot key are dealt over several shares by a hash of ``spread``
    (columns that tell the rows of one key apart, so the deal is the same when a
    task is run again), and the few rows of ``other`` with that key are repeated once
    per share.  All other keys keep share 0 and join as usual.  ``how`` is ``inner``
    or ``left``; rows without a key are dealt out as well, so a left join does not
    pile them up.

    Hot keys are looked for first, with sketches of ``key`` in ``facts``, or in
    ``counted_on`` where that is cheaper to read: a table with at least as many rows of
    each key.  Without any this is a plain join.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, keyless = heavy_keys(facts if counted_on is None else counted_on, key, partitions)
    if not found and not (keyless and how == "left"):
        return facts.join(other, key, how)
    schema = StructType([facts.schema[key], StructField("_shares", IntegerType())])
    hot = F.broadcast(facts.sparkSession.createDataFrame(found, schema))
    apart = ", ".join(f"`{name}`" for name in spread or facts.columns)
    dealt = facts.join(hot, key, "left").selectExpr(
        *[f"`{name}`" for name in facts.columns],
        f"CAST(pmod(xxhash64({apart}), coalesce(_shares, IF(`{key}` IS NULL, {partitions}, 1)))"
        " AS INT) AS _share",
    )
    repeated = other.join(hot, key, "left").selectExpr(
        *[f"`{name}`" for name in other.columns],
        "explode(sequence(0, coalesce(_shares, 1) - 1)) AS _share",
    )
    return dealt.join(repeated, [key, "_share"], how).drop("_share")
