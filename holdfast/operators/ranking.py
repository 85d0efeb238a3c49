"""Exact global ranks, tiles, quantiles and modes without a single-task window.

``ntile`` or ``percentile`` over a whole table puts every row into one task.
What these operators need are only a few rows of the sorted table (the first row
of each tile, the rows next to a quantile).

Quantiles of numbers are found by sketches that narrow each point to a short range of
values and one exact count around and inside these ranges (``quantiles``).

Tiles follow any columns and a unique key: histograms of one column after the other narrow
each cut to a few rows (``selection.rows_at``).  ``rows_at_ranks`` does the same for orders
without a key by Spark's range sort.

The result is a plain projection that compares each row with those few literal rows:
no second shuffle, no window, no join.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Sequence
from datetime import date, datetime
from functools import reduce
from itertools import accumulate
from operator import add, or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from holdfast.operators.selection import comparable, rows_at

Order = Sequence[tuple[str, str]]  # (column, "asc" | "desc")
# Points of a value sketch, its accuracy, and the rows a range may have to be read in full.
GRID, SKETCH, FEW_VALUES = 512, 10_000, 20_000


def sort_columns(order: Order) -> list[Column]:
    """Sort columns with NULLs last when ascending and first when descending."""
    return [
        F.col(name).desc_nulls_first() if way == "desc" else F.col(name).asc_nulls_last()
        for name, way in order
    ]


def rows_at_ranks(
    df: DataFrame,
    order: Order,
    ranks: Callable[[int], Iterable[int]],
    total_order: bool = False,
) -> tuple[int, dict[int, Row]]:
    """Row count, and the rows that stand at some ranks (0-based) of the sorted table.

    ``ranks`` is given the row count and returns the wanted ranks.  Only those
    rows and one count per partition reach the driver.  Equal rows are counted
    together before the sort, so a value held by a third of the table is one
    row in it; with ``total_order`` (the order ends in a unique key) that
    step is left out.
    """
    names = [name for name, _ in order]
    if total_order:
        keys = df.select(*names, F.lit(1).cast("long").alias("_n"))
    else:
        keys = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    laid = (
        keys.orderBy(*sort_columns(order))
        .select("*", F.spark_partition_id().alias("_part"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        sizes = sorted(
            (row["_part"], row["_size"])
            for row in laid.groupBy("_part").agg(F.sum("_n").alias("_size")).collect()
        )
        count = sum(size for _, size in sizes)
        wanted = sorted({rank for rank in ranks(count) if 0 <= rank < count})
        places, start = [], 0
        for part, size in sizes:
            places += [(part, rank - start, rank) for rank in wanted if start <= rank < start + size]
            start += size
        if not places:
            return count, {}
        running = Window.partitionBy("_part").orderBy(*sort_columns(order))
        upto = F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        inside = laid.where(F.col("_part").isin([part for part, _, _ in places]))
        hit = reduce(
            or_,
            [
                (F.col("_part") == part) & (F.col("_upto") - F.col("_n") <= at) & (F.col("_upto") > at)
                for part, at, _ in places
            ],
        )
        found: dict[int, Row] = {}
        for row in inside.withColumn("_upto", upto).where(hit).collect():
            for part, at, rank in places:
                if part == row["_part"] and row["_upto"] - row["_n"] <= at < row["_upto"]:
                    found[rank] = row
        return count, found
    finally:
        laid.unpersist()


def _literal(value: object, kind: str | None) -> Column:
    if isinstance(value, datetime):
        # a zoned time is an instant, whatever zone the session shows it in
        return F.lit(value) if kind == "timestamp" else F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(value, date):
        return F.lit(value.isoformat()).cast("date")
    return F.lit(value)


def not_before(order: Order, mark: Row | dict, types: dict[str, str] | None = None) -> Column:
    """True for rows that stand at or after ``mark`` in the order."""
    result = F.lit(True)
    for name, way in reversed(order):
        col, value = F.col(name), mark[name]
        if value is None:
            tied = col.isNull()
            beyond = col.isNotNull() if way == "desc" else F.lit(False)
        else:
            at = _literal(value, (types or {}).get(name))
            tied = col.eqNullSafe(at)
            beyond = (
                F.coalesce(col < at, F.lit(False))
                if way == "desc"
                else F.coalesce(col > at, F.lit(True))
            )
        result = beyond | (tied & result)
    return result


def tile_starts(count: int, tiles: int) -> list[int]:
    """First rank of tiles 2..n; the first ``count mod n`` tiles hold one row more."""
    base, extra = divmod(count, tiles)
    return [tile * base + min(tile, extra) for tile in range(1, tiles)]


def global_ntile(df: DataFrame, order: Order, key: str, tiles: int, out: str) -> DataFrame:
    """Tile number 1..n over the whole table; rows with equal order go by ``key``.

    The key has to tell all rows apart.  Where it does not, a tile could not be cut at its
    exact size, so a key that occurs twice at a cut is an error.  The rows at the cuts are
    found by histograms (``selection``), without a sort.
    """
    types = dict(df.dtypes)
    full = [*[(name, way) for name, way in order if name != key], (key, "asc")]
    plain = [(f"_order_{i}", way) for i, (_, way) in enumerate(full)]
    keys = {f"_order_{i}": comparable(F.col(name), types[name]) for i, (name, _) in enumerate(full)}
    _, found, again = rows_at(
        df.select(*[col.alias(name) for name, col in keys.items()]), plain, lambda n: tile_starts(n, tiles)
    )
    if again:
        raise ValueError(f"{key} does not tell the rows apart")
    marks = [dict(zip(keys, found[rank], strict=True)) for rank in sorted(found)]
    tile = reduce(add, [not_before(plain, mark).cast("int") for mark in marks], F.lit(1))
    return df.withColumns(keys).withColumn(out, tile).drop(*keys)


def _number(col: str) -> Column:
    return F.nullif(F.col(col).cast("double"), F.lit(float("nan")))


def _next_to(point: tuple[int, int], count: int) -> tuple[int, int]:
    """The two ranks next to a point; the same one twice if it falls on a rank."""
    num, den = point
    low, rest = divmod(num * (count - 1), den)
    return low, low + bool(rest)


def _narrowed(
    df: DataFrame, wanted: dict[str, list[tuple[int, int]]]
) -> tuple[dict[str, int], dict[str, list[tuple[float, float]]]]:
    """Value count per column, and per column ranges of values that hold the wanted ranks.

    Each step is one aggregation for all columns and ranges: exact counts and a sketch of
    the values inside, which cuts every range to a few thousandths.  It ends when a
    range has at most ``FEW_VALUES`` rows or a single value.
    """
    whole = (float("-inf"), float("inf"))
    found = {(name, point): whole for name, points in wanted.items() for point in points}
    counts: dict[str, int] = {}
    pending = set(found)
    while pending:
        spans = sorted({(name, found[name, point]) for name, point in pending})
        grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
        measures = []
        for i, (name, (low, high)) in enumerate(spans):
            value = _number(name)
            inside = F.when(value.between(F.lit(low), F.lit(high)), value)
            measures += [
                F.count(F.when(value < F.lit(low), value)).alias(f"before_{i}"),
                F.count(inside).alias(f"count_{i}"),
                F.percentile_approx(inside, grid, SKETCH).alias(f"grid_{i}"),
            ]
        row = df.agg(*measures).first()
        at = {span: (row[f"before_{i}"], row[f"count_{i}"], row[f"grid_{i}"]) for i, span in enumerate(spans)}
        for name, point in list(pending):
            before, count, values = at[name, found[name, point]]
            counts.setdefault(name, count)
            if not count:
                pending.discard((name, point))
                continue
            low, high = _next_to(point, counts[name])
            margin = 2 + -(-2 * GRID // count)
            first = max(0, (low - before) * GRID // count - margin)
            last = min(GRID, -(-(high + 1 - before) * GRID // count) + margin)
            narrowed = (values[first], values[last])
            rows = (last - first) * count // GRID
            if rows <= FEW_VALUES or narrowed[0] == narrowed[1] or narrowed == found[name, point]:
                pending.discard((name, point))
            found[name, point] = narrowed
    ranges: dict[str, list[tuple[float, float]]] = {name: [] for name in wanted}
    for name, _ in found:
        if counts[name] and not ranges[name]:
            for low, high in sorted(found[name, p] for p in wanted[name]):
                if ranges[name] and low <= ranges[name][-1][1]:
                    ranges[name][-1] = (ranges[name][-1][0], max(high, ranges[name][-1][1]))
                else:
                    ranges[name].append((low, high))
    return counts, ranges


def quantiles(
    df: DataFrame, wanted: dict[str, list[tuple[int, int]]]
) -> dict[str, list[float] | None]:
    """Exact quantiles of several columns at the fractions ``(numerator, denominator)``.

    Linear interpolation between the two rows next to each point; positions are
    whole-number arithmetic, so a point that falls on a row is that row's value.
    NULL and NaN are no values; None for a column without any.

    Sketches narrow each point to a short range of values, then one aggregation counts
    the rows between the ranges and the distinct values inside them: no sort, no
    cached copy, and a value held by a third of the table is one row of the counts.
    """
    counts, ranges = _narrowed(df, wanted)
    names = [name for name in wanted if counts[name]]
    if not names:
        return dict.fromkeys(wanted)
    value, place = F.col("_v"), F.lit(None).cast("int")
    for i, name in enumerate(names):
        steps = [
            (value >= F.lit(low)).cast("int") + (value > F.lit(high)).cast("int")
            for low, high in ranges[name]
        ]
        place = F.when(F.col("_c") == i, reduce(add, steps)).otherwise(place)
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), _number(n).alias("_v")) for i, n in enumerate(names)])
    counted = (
        df.select(F.inline(cells))
        .where(value.isNotNull())
        .withColumn("_place", place)
        .groupBy("_c", "_place", F.when(F.col("_place") % 2 == 1, value).alias("_v"))
        .count()
        .collect()
    )
    out: dict[str, list[float] | None] = dict.fromkeys(wanted)
    for i, name in enumerate(names):
        # ranges stand at odd places, what lies between them at even ones
        own = sorted(
            (r["_place"], float("-inf") if r["_v"] is None else r["_v"], r["_v"], r["count"])
            for r in counted
            if r["_c"] == i
        )
        upto = list(accumulate(r[3] for r in own))

        def at(rank: int, own=own, upto=upto) -> float:
            return own[bisect_right(upto, rank)][2]

        edges = []
        for num, den in wanted[name]:
            low, high = _next_to((num, den), counts[name])
            rest = num * (counts[name] - 1) % den
            below = at(low)
            edges.append(below + (at(high) - below) * (rest / den) if rest else below)
        out[name] = edges
    return out


def quantile_edges(df: DataFrame, col: str, points: Sequence[tuple[int, int]]) -> list[float] | None:
    """Exact quantiles of one column (see ``quantiles``)."""
    return quantiles(df, {col: list(points)})[col]


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of several columns, read together."""
    found = quantiles(df, {name: [(1, 2)] for name in cols}) if cols else {}
    return {name: edges[0] if edges else None for name, edges in found.items()}


def exact_median(df: DataFrame, col: str) -> float | None:
    return exact_medians(df, [col])[col]


def quantile_bins(
    df: DataFrame, col: str, q: int, out: str, duplicates: str = "raise"
) -> DataFrame:
    """Bin number 0..q-1 by value quantiles; bins are closed on the right.

    The lowest value belongs to bin 0 and missing values get no bin.  Equal edges
    are an error unless ``duplicates="drop"`` merges the bins between them.
    """
    if duplicates not in ("raise", "drop"):
        raise ValueError("duplicates must be 'raise' or 'drop'")
    edges = quantile_edges(df, col, [(k, q) for k in range(q + 1)])
    if edges is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    if len(set(edges)) < len(edges):
        if duplicates == "raise":
            raise ValueError(f"bin edges of {col} are not unique: {edges}")
        edges = sorted(set(edges))
    value = _number(col)
    above = reduce(add, [(value > F.lit(edge)).cast("int") for edge in edges[1:-1]], F.lit(0))
    return df.withColumn(out, F.when(value.isNotNull(), above))


def mode_row(
    df: DataFrame, key: Sequence[str], payload: Sequence[str], ties: Sequence[str] | None = None
) -> DataFrame:
    """Most frequent payload per key; equal counts go to the smallest ``ties`` (NULLs last).

    Two aggregations with partial results on the map side; no sort within a key.
    ``ties`` defaults to the whole payload, which makes the pick unique.
    """
    wanted = [*(ties or []), *[name for name in payload if name not in (ties or [])]]
    counted = df.groupBy(*key, *wanted).agg(F.count(F.lit(1)).alias("_n"))
    ordered = [-F.col("_n").alias("_n")]
    for name in wanted:
        ordered += [F.col(name).isNull().alias(f"_no_{name}"), F.col(name).alias(name)]
    best = counted.groupBy(*key).agg(F.min(F.struct(*ordered)).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{name}").alias(name) for name in payload])


def top_n(df: DataFrame, order: Order, n: int, where: Column | None = None) -> DataFrame:
    """First ``n`` rows in the order; end it with a unique key for a stable pick."""
    kept = df if where is None else df.where(where)
    return kept.orderBy(*sort_columns(order)).limit(n)
