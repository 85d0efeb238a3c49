"""Document quality: ridge regression on random Fourier features, then isotonic calibration.

Every text gives a fixed number of statistics, taken from whole texts in numpy (shares of
character classes, word and line repetition, lengths).  Standardised, they are mapped
to cosines of random projections, which approximate a Gaussian kernel.  Each task adds
up its part of the normal equations; the parts are summed by Spark row by row of the
matrix, so what reaches the driver is one (FEATURES + 1)-square matrix whatever the data.
Calibration uses labelled rows that the regression has not seen: their raw scores are
counted in ``BINS`` fixed bins, and pool-adjacent-violators runs over those.

Defined results: null and empty texts have all-zero statistics and get the score of such
a text; equal texts score alike; null labels are not used; with no labels, or labels of
one kind only, the score is that kind's share (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import stored
from holdfast.llm.words import WHITE, find_words, run_hashes, separators, slices, span_hash, utf8

FEATURES, SEED, RIDGE, BINS = 256, 7, 1e-2, 1000
WIDTH = 2.0  # kernel width in units of the square root of the number of statistics
CALIBRATION_FOLDS = 5
THRESHOLD = 0.7
LINE_BREAK = tuple(b"\n")


def _classes() -> list[np.ndarray]:
    """Membership tables of byte classes."""
    table = np.zeros((6, 256), bool)
    table[0, 0x41:0x5B] = True  # upper case
    table[1, 0x30:0x3A] = True  # digits
    table[2, list(b".,;:'\"()-?!")] = True  # prose marks
    table[3, list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True  # symbols
    table[4, list(WHITE)] = True
    table[5, 0x80:] = True  # beyond ASCII
    return list(table)


def _distinct(owner: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Number of distinct hashes of each owner (ascending)."""
    order = np.lexsort((hashes, owner))
    a, b = owner[order], hashes[order]
    lead = np.ones(len(a), bool)
    lead[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.bincount(a[lead], minlength=rows)


def text_statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics per text."""
    data, rows = utf8(column)
    n = len(column)
    size = np.diff(rows)
    words = find_words(column, separators(WHITE), lower=False)
    lines = find_words(column, separators(LINE_BREAK), lower=False)
    owner = np.repeat(np.arange(n), np.diff(words.first))
    line_owner = np.repeat(np.arange(n), np.diff(lines.first))
    n_words, n_lines = np.diff(words.first), np.diff(lines.first)
    spans = span_hash(words.data)
    hashes = spans.of(words.start, words.end)
    triples = run_hashes(hashes, 3)
    inside = np.flatnonzero(owner[: len(triples)] == owner[2:]) if len(triples) else np.zeros(0, np.int64)
    length = words.end - words.start
    last = words.data[np.maximum(words.end - 1, 0)]
    letter_end = ((last | 0x20) >= 0x61) & ((last | 0x20) <= 0x7A) | (last >= 0x80)

    def per_row(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, n)

    some, some_words = np.maximum(size, 1), np.maximum(n_words, 1)
    out = [np.log1p(size), np.log1p(n_words), np.log1p(n_lines)]
    for table in _classes():
        sums = np.concatenate([[0], np.cumsum(table[data])])
        out.append((sums[rows[1:]] - sums[rows[:-1]]) / some)
    mean = per_row(length) / some_words
    out.append(np.log1p(mean))
    out.append(np.sqrt(np.maximum(per_row(length.astype(float) ** 2) / some_words - mean**2, 0)) / (1 + mean))
    out.append(per_row(letter_end) / some_words)
    out.append(per_row(length == 1) / some_words)
    out.append(_distinct(owner, hashes, n) / some_words)
    of_triples = np.maximum(n_words - 2, 0)
    out.append((_distinct(owner[inside], triples[inside], n) + (of_triples == 0)) / np.maximum(of_triples, 1))
    line_hashes = span_hash(lines.data).of(lines.start, lines.end)
    out.append((_distinct(line_owner, line_hashes, n) + (n_lines == 0)) / np.maximum(n_lines, 1))
    repeats = np.zeros(len(owner), bool)
    repeats[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out.append(per_row(repeats) / some_words)
    return np.nan_to_num(np.stack(out, axis=1).astype(np.float64)) * (size > 0)[:, None]


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, stats), one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                values = text_statistics(batch.column("text"))
                stats = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]),
                    pa.array(values.ravel()),
                )
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), stats], names=["doc_id", "stats"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # raw scores and the calibrated score at each, both ascending
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = (stats - self.mean) / self.scale
        waves = np.cos(z @ self.project + self.phase) * np.sqrt(2 / self.project.shape[1])
        return np.concatenate([waves, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0, 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list())


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of Z'Z and Z'y over (stats, label)."""
    width = len(model.phase) + 1

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width + 1))
        for frame in frames:
            if len(frame):
                z = model.features(_matrix(frame["stats"]))
                total[:, :width] += z.T @ z
                total[:, width] += z.T @ frame["label"].to_numpy(float)
        yield pd.DataFrame({"row": np.arange(width), "sums": list(total)})

    def add(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [key[0]], "sums": [np.sum(_matrix(frames["sums"]), axis=0)]})

    kind = "row int, sums array<double>"
    sums = rows.select("stats", "label").mapInPandas(part, kind)
    # tasks are summed in groups first, so no group grows with the number of tasks
    sums = sums.withColumn("lot", F.spark_partition_id() % 64)
    partial = sums.groupBy("row", "lot").applyInPandas(lambda k, f: add(k, f[["sums"]]), kind)
    total = partial.groupBy("row").applyInPandas(add, kind).toPandas().sort_values("row")
    whole = _matrix(total["sums"]) if len(total) else np.zeros((width, width + 1))
    return whole[:, :width], whole[:, width]


def pool_adjacent(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of the shares ones / n at ascending places: places and levels."""
    blocks: list[list[float]] = []
    for x, m, k in zip(at, n, ones, strict=True):
        blocks.append([x * m, m, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            x2, m2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + x2, blocks[-1][1] + m2, blocks[-1][2] + k2]
    return (
        np.array([b[0] / b[1] for b in blocks]),
        np.array([b[2] / b[1] for b in blocks]),
    )


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fits on all given labels; ``stats`` comes from ``with_statistics``."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
    rows = stored(
        stats.join(known.where("label is not null"), F.col("doc_id") == F.col("id")).select(
            "stats",
            "label",
            (F.pmod(F.xxhash64("id"), F.lit(CALIBRATION_FOLDS)) == 0).alias("calibrates"),
        )
    )
    learned = rows.where("not calibrates")
    d = text_statistics(pa.array([""])).shape[1]
    sums = learned.select(F.col("label"), F.posexplode("stats").alias("k", "v")).groupBy("k").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation")
    )
    mean, scale = np.zeros(d), np.ones(d)
    for row in sums.collect():
        mean[row["k"]] = row["mean"]
        scale[row["k"]] = row["deviation"] if row["deviation"] > 1e-9 else 1.0
    dice = np.random.default_rng(SEED)
    model = Model(
        mean,
        scale,
        dice.normal(size=(d, FEATURES)) / (WIDTH * np.sqrt(d)) * 2,
        dice.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + 1),
        np.array([0.0]),
        np.array([0.5]),
    )
    gram, target = _normal_equations(learned, model)
    count = max(gram[-1, -1], 1.0)
    penalty = np.full(FEATURES + 1, RIDGE * np.sqrt(count) / FEATURES * 2)
    penalty[-1] = 1e-9
    model.weights = np.linalg.solve(gram + np.diag(penalty), target)

    def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                bins = np.clip(np.floor((model.raw(_matrix(frame["stats"])) + 0.5) * BINS / 2), 0, BINS - 1)
                yield pd.DataFrame({"bin": bins.astype(int), "label": frame["label"]})

    binned = (
        rows.where("calibrates")
        .select("stats", "label")
        .mapInPandas(raw, "bin int, label double")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"))
        .orderBy("bin")
        .toPandas()
    )
    if len(binned):
        places = (binned["bin"].to_numpy() + 0.5) * 2 / BINS - 0.5
        model.edges, model.levels = pool_adjacent(places, binned["n"].to_numpy(float), binned["ones"].to_numpy(float))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = stats.sparkSession.sparkContext.broadcast(vars(model))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(**shared.value)
        for frame in frames:
            if len(frame):
                yield pd.DataFrame(
                    {"doc_id": frame["doc_id"].astype("Int64"), "score": model.score(_matrix(frame["stats"]))}
                )

    return stats.mapInPandas(run, "doc_id bigint, score double")
