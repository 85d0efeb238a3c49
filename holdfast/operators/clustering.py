"""K-Means and its silhouette as a few sums per step, the same on every run and engine.

Standardised columns are put on a grid of millionths, so that sums over rows are exact
whatever their order; a distance is a fixed sequence of double operations.  Seeds are drawn as
in k-means++, as a race over hashed keys: the next centre is the row with the largest squared
distance to the centres so far, divided by an exponential variate that a hash of (seed, round,
key) yields.  One aggregation finds it.  A step of Lloyd's algorithm is one aggregation too:
tasks label their rows and send a count and a sum per cluster.  All cluster counts that are
asked for take part in the same passes, since the seeds of k are the first k seeds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = 1_000_000
STEPS = 100
# Steps end when the squared movements of all centres add up to this share of a unit variance.
TOLERANCE = 1e-4
HASH_DIGITS = 13  # hexadecimal, so 52 bits
BATCH_ROWS = 8192
# With at most so many tasks their counts and sums go to the driver as they are.
DIRECT_PARTITIONS = 64
# The passes join small neighbouring partitions of the kept rows to tasks of about so many rows.
TASK_ROWS = 32_768


@dataclass(frozen=True)
class Centres:
    """Cluster centres in grid units, in the order of their numbers."""

    features: tuple[str, ...]
    values: tuple[tuple[float, ...], ...]


def on_grid(name: str) -> Column:
    """A standardised column in whole grid units; a missing value counts as the mean."""
    return F.floor(F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * F.lit(float(GRID)) + F.lit(0.5)).cast("double")


def _squares(columns: Sequence[Column], centre: Sequence[float]) -> Column:
    return reduce(add, [(x - F.lit(c)) * (x - F.lit(c)) for x, c in zip(columns, centre, strict=True)])


def nearest(df: DataFrame, centres: Centres, out: str = "segment") -> DataFrame:
    """Adds the number of the nearest centre; of equally near ones the lowest."""
    if not centres.values:
        return df.withColumn(out, F.lit(None).cast("int"))
    columns = [on_grid(name) for name in centres.features]
    distances = F.array(*[_squares(columns, c) for c in centres.values])
    return df.withColumn(out, (F.array_position(distances, F.array_min(distances)) - 1).cast("int"))


def race(key: str, seed: int, turn: int) -> Column:
    """An exponential variate per key, from the MD5 of ``seed:turn:key``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{turn}:"), F.col(key).cast("string")))
    bits = F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 4 * HASH_DIGITS)))


def seeds(points: DataFrame, features: Sequence[str], k: int, seed: int, key: str) -> list[tuple[float, ...]]:
    """Up to k different rows; fewer if the table has no more."""
    found: list[tuple[float, ...]] = []
    columns = [F.col(name) for name in features]
    for turn in range(k):
        far = F.lit(1.0)
        if found:
            distances = [_squares(columns, c) for c in found]
            far = F.least(*distances) if len(distances) > 1 else distances[0]
        winner = points.agg(F.max(F.struct((far / race(key, seed, turn)).alias("r"), key, *features)).alias("w")).first()["w"]
        if winner is None or winner["r"] <= 0:
            break
        found.append(tuple(float(winner[name]) for name in features))
    return found


def _labels(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Numbers of the nearest centres; the additions are in column order, as in ``nearest``."""
    total = np.zeros((len(rows), len(centres)))
    for j in range(rows.shape[1]):
        step = rows[:, j, None] - centres[None, :, j]
        total = step * step if j == 0 else total + step * step
    return total.argmin(axis=1)


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            yield np.stack([part.column(j).to_numpy(zero_copy_only=False) for j in range(width)], axis=1)


def tallies(
    points: DataFrame, features: Sequence[str], centres: dict[int, np.ndarray], direct: bool = False
) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per cluster count: rows, sums and summed squares of each cluster under ``centres``.

    ``direct`` sends the rows of each task to the driver without adding them up first.
    """
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {k: np.zeros(len(c), np.int64) for k, c in centres.items()}
        sums = {k: np.zeros((len(c), width), np.int64) for k, c in centres.items()}
        squares = {k: np.zeros(len(c)) for k, c in centres.items()}
        for rows in _matrices(batches, width):
            whole, norms = rows.astype(np.int64), ((rows / GRID) ** 2).sum(axis=1)
            for k, c in centres.items():
                label = _labels(rows, c)
                n[k] += np.bincount(label, minlength=len(c))
                squares[k] += np.bincount(label, norms, minlength=len(c))
                np.add.at(sums[k], label, whole)
        for k, c in centres.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(c), k)), pa.array(np.arange(len(c))), pa.array(n[k]), pa.array(squares[k])]
                + [pa.array(sums[k][:, j]) for j in range(width)],
                names=["k", "label", "n", "squares", *(f"s{j}" for j in range(width))],
            )

    schema = "k bigint, label bigint, n bigint, squares double, " + ", ".join(f"s{j} bigint" for j in range(width))
    parts = points.select(*features).mapInArrow(run, schema)
    if not direct:
        parts = parts.groupBy("k", "label").agg(
            F.sum("n").alias("n"), F.sum("squares").alias("squares"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)]
        )
    found = {
        k: (np.zeros(len(c), np.int64), np.zeros((len(c), width)), np.zeros(len(c))) for k, c in centres.items()
    }
    for row in parts.collect():  # a row per cluster, and per task where there are few tasks
        n, sums, squares = found[row["k"]]
        n[row["label"]] += row["n"]
        squares[row["label"]] += row["squares"]
        sums[row["label"]] += [row[f"s{j}"] for j in range(width)]
    return found


def lloyd(
    points: DataFrame, features: Sequence[str], starts: dict[int, np.ndarray], steps: int = STEPS, direct: bool = False
) -> dict[int, np.ndarray]:
    """Steps until the centres hardly move, ``steps`` at most; a cluster without rows stays put."""
    done: dict[int, np.ndarray] = {}
    moving = dict(starts)
    for _ in range(steps):
        if not moving:
            break
        for k, (n, sums, _) in tallies(points, features, moving, direct).items():
            held = n > 0
            after = moving[k].copy()
            after[held] = sums[held] / n[held, None].astype(float)
            moved = sum(((a - b) * (a - b) for a, b in zip(after.ravel().tolist(), moving[k].ravel().tolist(), strict=True)), 0.0)
            moving[k] = after
            if moved <= TOLERANCE * GRID * GRID:
                done[k] = moving.pop(k)
    return done | moving


def silhouettes(
    points: DataFrame, features: Sequence[str], centres: dict[int, np.ndarray], direct: bool = False
) -> dict[int, float]:
    """Mean silhouette (squared distances) per cluster count, from cluster moments.

    The mean squared distance of a row to a cluster follows from the cluster's count, sum and
    sum of squares, so no pair of rows is ever met.  Rows that are alone in a cluster count 0.
    """
    moments = tallies(points, features, centres, direct)
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(centres, 0.0)
        for rows in _matrices(batches, width):
            scaled = rows / GRID
            norms, each = (scaled**2).sum(axis=1), np.arange(len(rows))
            for k, c in centres.items():
                n, sums, squares = moments[k]
                size = np.maximum(n, 1)
                mean = norms[:, None] + (squares / size)[None, :] - 2 * scaled @ (sums / GRID / size[:, None]).T
                label = _labels(rows, c)
                mine = n[label]
                own = mean[each, label] * mine / np.maximum(mine - 1, 1)
                mean[:, n == 0] = np.inf
                mean[each, label] = np.inf
                other = mean.min(axis=1)
                best = np.maximum(own, other)
                valid = (mine > 1) & np.isfinite(other) & (best > 0)
                total[k] += float(((other - own)[valid] / best[valid]).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()))], names=["k", "s"])

    sums = points.select(*features).mapInArrow(run, "k bigint, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    rows = {k: int(n.sum()) for k, (n, _, _) in moments.items()}
    return {row["k"]: row["s"] / rows[row["k"]] for row in sums if rows[row["k"]]}


def fit(
    df: DataFrame, features: Sequence[str], ks: Iterable[int], seed: int, key: str, steps: int = STEPS, scores: bool = False
) -> tuple[dict[int, Centres], dict[int, float]]:
    """Centres per cluster count, and their silhouettes if asked for.

    The grid points are kept, on disk where memory is short, while the steps read them.  A step
    has as many tasks as its rows are worth, however many partitions the table came in.
    """
    ks = sorted(set(ks))
    kept = df.select(key, *[on_grid(name).alias(name) for name in features]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        points = kept.coalesce(max(1, -(-kept.count() // TASK_ROWS)))
        direct = points.rdd.getNumPartitions() <= DIRECT_PARTITIONS
        found = seeds(points, features, ks[-1], seed, key)
        starts = {k: np.array(found[:k]) for k in ks if found}
        centres = lloyd(points, features, starts, steps, direct)
        measured = silhouettes(points, features, centres, direct) if scores and centres else {}
    finally:
        kept.unpersist()
    made = {k: Centres(tuple(features), tuple(map(tuple, centres[k].tolist())) if k in centres else ()) for k in ks}
    return made, measured
