"""Rows at given ranks of a table's order, found by histograms instead of a sort.

All order columns of a rank's row are looked for one after the other.  A pass is one aggregation
for all ranks: it cuts the range a rank lies in to ``BINS`` ranges by a monotone number of the
column and counts their rows, with the least and largest value that occur in each.  A range that
has become one value fixes the column, and the next one is looked at among its rows, so a value
that a third of the table holds costs one pass.  Ranges with at most ``FEW_ROWS`` rows are read
at the end.  There is no shuffle of rows and no cached copy; what reaches the driver are at
most ``BINS`` counts per rank and pass, and the few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import date, datetime
from decimal import Decimal
from functools import cmp_to_key, reduce
from math import inf, isfinite, nan
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Order = Sequence[tuple[str, str]]  # (column, "asc" | "desc")
BINS, FEW_ROWS = 1024, 1000
TEXT_BYTES = 6


class Span(NamedTuple):
    """Rows with fixed values in the leading columns and a range of values in the next."""

    fixed: tuple
    low: object
    high: object
    nulls: bool

    def holds(self, names: Sequence[str]) -> Column:
        parts = [F.col(name).eqNullSafe(literal(v)) for name, v in zip(names, self.fixed)]
        if len(self.fixed) < len(names):
            col = F.col(names[len(self.fixed)])
            inside = F.lit(False) if self.low is None else col.between(literal(self.low), literal(self.high))
            parts.append(F.coalesce(inside, F.lit(False)) | (F.lit(self.nulls) & col.isNull()))
        return reduce(and_, parts)


def literal(value: object) -> Column:
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(value, date):
        return F.lit(value.isoformat()).cast("date")
    return F.lit(value)


def comparable(col: Column, kind: str) -> Column:
    """The column in a type whose values the driver can hold without loss."""
    if kind == "timestamp":
        return F.unix_micros(col)
    if kind == "boolean":
        return col.cast("int")
    if kind.startswith(("char", "varchar")):
        return col.cast("string")
    if kind not in ("string", "date", "timestamp_ntz", "float", "double", "tinyint", "smallint", "int", "bigint"):
        if not kind.startswith("decimal"):
            raise TypeError(f"rows cannot be ranked by a column of type {kind}")
    return col


def _value(value: object) -> object:
    """One object stands for NaN, so that equal spans are equal."""
    return nan if value != value else value


def _same(a: object, b: object) -> bool:
    return a == b or (a != a and b != b)


def _share(name: str, low: object, high: object) -> Column:
    """A number from 0 at ``low`` to 1 at ``high`` that never falls as the value grows."""
    col = F.col(name)
    last = F.when(col == literal(high), F.lit(1.0)).otherwise(F.lit(0.0))
    if isinstance(low, float):
        if high != high or high == inf:
            return last
        if low == -inf:
            return F.when(col == literal(low), F.lit(0.0)).otherwise(F.lit(1.0))
        if not isfinite(high - low):
            return (col / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
        return (col - F.lit(low)) / F.lit(high - low)
    if isinstance(low, str):
        a, b = low.encode(), high.encode()
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        number = lambda x: int.from_bytes(x[same : same + TEXT_BYTES].ljust(TEXT_BYTES, b"\0"), "big")
        if number(a) == number(b):
            return last
        part = F.hex(F.substring(F.encode(col, "UTF-8"), same + 1, TEXT_BYTES))
        value = F.conv(F.rpad(part, 2 * TEXT_BYTES, "0"), 16, 10).cast("double")
        return (value - F.lit(float(number(a)))) / F.lit(float(number(b) - number(a)))
    if isinstance(low, datetime):
        seconds = (col - literal(low)).cast("interval second").cast("decimal(18,6)").cast("double")
        return seconds / F.lit((high - low).total_seconds())
    if isinstance(low, date):
        return F.datediff(col, literal(low)).cast("double") / F.lit(float((high - low).days))
    if isinstance(low, Decimal):
        return (col - F.lit(low)).cast("double") / F.lit(float(high - low))
    return (col.cast("decimal(20,0)") - F.lit(Decimal(low))).cast("double") / F.lit(float(high - low))


def _bin(name: str, span: Span) -> Column:
    """The bin of a row in a span; NULL rows have a bin of their own."""
    if span.low is None or _same(span.low, span.high):
        place = F.lit(0)
    else:
        place = F.least(F.floor(_share(name, span.low, span.high) * BINS), F.lit(BINS - 1)).cast("int")
    return F.when(F.col(name).isNull(), F.lit(BINS)).otherwise(place)


def _before(order: Order) -> Callable:
    """A driver-side comparison of rows in the order: NULL is the largest value, then NaN."""

    def one(a: object, b: object) -> int:
        if isinstance(a, str) and isinstance(b, str):
            a, b = a.encode(), b.encode()
        big = lambda v: 2 if v is None else 1 if v != v else 0
        if big(a) or big(b):
            return big(a) - big(b)
        return (a > b) - (a < b)

    def compare(a: Sequence, b: Sequence) -> int:
        for i, (_, way) in enumerate(order):
            sign = one(a[i], b[i])
            if sign:
                return -sign if way == "desc" else sign
        return 0

    return compare


def rows_at(df: DataFrame, order: Order, ranks: Callable[[int], Iterable[int]]) -> tuple[int, dict[int, tuple], bool]:
    """Row count, the order values at some ranks (0-based), and whether one of these rows occurs
    more than once.  The columns are ``comparable``."""
    names = [name for name, _ in order]
    whole = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(name).alias(f"{kind}_{i}") for i, name in enumerate(names) for kind, f in (("low", F.min), ("high", F.max), ("known", F.count))],
    ).first()
    count = whole["n"]
    wanted = sorted({r for r in ranks(count) if 0 <= r < count})

    def start(fixed: tuple) -> Span:
        i = len(fixed)
        if i == len(names):
            return Span(fixed, None, None, False)
        return Span(fixed, _value(whole[f"low_{i}"]), _value(whole[f"high_{i}"]), whole[f"known_{i}"] < count)

    place = {rank: (start(()), rank, count) for rank in wanted}  # span, rank inside, its rows
    while True:
        spans = sorted({s for s, _, n in place.values() if n > FEW_ROWS and len(s.fixed) < len(names)}, key=repr)
        if not spans:
            break
        index, bins = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, span in enumerate(spans):
            index = F.when(span.holds(names), F.lit(i)).otherwise(index)
        for i, span in enumerate(spans):
            bins = F.when(F.col("_span") == i, _bin(names[len(span.fixed)], span)).otherwise(bins)
        used = sorted({len(s.fixed) for s in spans})
        rows = (
            df.select(*names, index.alias("_span"))
            .where(F.col("_span").isNotNull())
            .withColumn("_bin", bins)
            .groupBy("_span", "_bin")
            .agg(
                F.count(F.lit(1)).alias("n"),
                *[f(names[c]).alias(f"{kind}_{c}") for c in used for kind, f in (("low", F.min), ("high", F.max))],
            )
            .collect()
        )
        for rank, (span, inside, n) in list(place.items()):
            if span not in spans or n <= FEW_ROWS:
                continue
            at = len(span.fixed)
            down = order[at][1] == "desc"
            for row in sorted((r for r in rows if r["_span"] == spans.index(span)), key=lambda r: r["_bin"], reverse=down):
                if inside < row["n"]:
                    break
                inside -= row["n"]
            low, high = _value(row[f"low_{at}"]), _value(row[f"high_{at}"])
            if row["_bin"] == BINS:
                found = start((*span.fixed, None))
            elif _same(low, high):
                found = start((*span.fixed, low))
            else:
                found = Span(span.fixed, low, high, False)
            place[rank] = (found, inside, row["n"])
    found = {rank: span.fixed for rank, (span, _, _) in place.items() if len(span.fixed) == len(names)}
    again = any(n > 1 for s, _, n in place.values() if len(s.fixed) == len(names))
    spans = sorted({s for s, _, _ in place.values() if len(s.fixed) < len(names)}, key=repr)
    if spans:
        index = F.lit(None).cast("int")
        for i, span in enumerate(spans):
            index = F.when(span.holds(names), F.lit(i)).otherwise(index)
        hit = reduce(or_, [span.holds(names) for span in spans])
        held: dict[int, list] = {i: [] for i in range(len(spans))}
        for row in df.where(hit).select(*names, index.alias("_span")).collect():
            held[row["_span"]].append(tuple(row)[:-1])
        compare = _before(order)
        for part in held.values():
            part.sort(key=cmp_to_key(compare))
        for rank, (span, inside, _) in place.items():
            if rank not in found:
                part = held[spans.index(span)]
                found[rank] = part[inside]
                again |= any(0 <= j < len(part) and compare(part[j], part[inside]) == 0 for j in (inside - 1, inside + 1))
    return count, found, again
