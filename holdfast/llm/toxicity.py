"""Toxic documents by multiple-instance learning.

A document is a bag of sentences.  A sentence has the probability sigmoid(b + sum of the
weights of its features), a document that of a noisy-or: one minus the product of its
sentences' complements.  Only documents are labelled; the gradient of the noisy-or
hands the label on to the sentences that explain it, and the sentence scores then say
where the offence is.  Features are lower-cased words and their first 4, 5 and 6 bytes,
so inflected forms share what they have in common.  In a score, sentences under ``WEAK``
(those without any known feature are) give ``MOST_WEAK`` together at most, so there is one
bounded leak per document, and length alone does not make a text toxic.

Fitting uses a bounded sample of labelled rows (per class ``SAMPLE_ROWS`` and, in total,
``SAMPLE_CHARS`` characters, by a hash of the id), which is what reaches the driver.  Texts
of any length take part; of a clean one the first ``LONGEST`` characters, while a toxic one
over that is left out, for its offence may stand behind the cut.  Features that speak for
the positive class are kept, ``MOST_FEATURES`` at most, and that bounded table goes to
the tasks.  Scoring covers every row and whole texts in one pass without a shuffle.

Defined results: null and empty texts have no sentence and score 0; equal texts score
alike; labels that are null are not used; with no positive label in the sample all
scores are near 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import fresh
from holdfast.llm.words import find_words, separators, slices, span_hash

SAMPLE_ROWS, SAMPLE_CHARS, LONGEST = 2500, 10_000_000, 2_500_000
MOST_FEATURES, PREFIXES = 20_000, (4, 5, 6)
# z-value of the log odds ratio from which a feature is kept.
LEAST_Z = 3.0
# Upper bound of a sentence's probability without any known feature (the leak).
LEAK = 5e-5
# Probability from which sentences add up without bound, and what all below give at most.
WEAK, MOST_WEAK = 0.01, 0.05
THRESHOLD, OFFENDING = 0.7, 0.5
LETTERS = tuple(set(range(0x80)) - set(range(0x41, 0x5B)) - set(range(0x61, 0x7B)))
STOPS = tuple(b".!?\n")


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentence of each feature, the features, row of each sentence, sentence starts in bytes."""
    words = find_words(column, separators(LETTERS), lower=True)
    row = np.repeat(np.arange(len(column)), np.diff(words.first))
    stops = np.flatnonzero(separators(STOPS)[words.data])
    block = np.searchsorted(stops, words.start)
    new = np.ones(len(row), bool)
    new[1:] = (block[1:] != block[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(new) - 1
    spans = span_hash(words.data)
    found = [spans.of(words.start, words.end)]
    owners = [sentence]
    for k in PREFIXES:
        long = np.flatnonzero(words.end - words.start > k)
        # a prefix is not the same feature as the word that is spelled like it
        found.append(spans.of(words.start[long], words.start[long] + k) ^ np.uint64(k))
        owners.append(sentence[long])
    heads = np.flatnonzero(new)
    return np.concatenate(owners), np.concatenate(found), row[heads], words.start[heads]


def _distinct(owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """First positions of the distinct (owner, feature) pairs."""
    order = np.lexsort((feature, owner))
    a, b = owner[order], feature[order]
    lead = np.ones(len(a), bool)
    lead[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[lead]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, chars: int
) -> DataFrame:
    """(label, text) of at most ``rows`` documents and ``chars`` characters per class, those
    first by a hash of the id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    picks = [
        known.where(F.col("label") == y).distinct().orderBy(F.xxhash64("id"), "id").limit(rows)
        for y in (0, 1)
    ]
    chosen = F.broadcast(picks[0].unionByName(picks[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    most = min(LONGEST, chars)
    fits = (F.length("text") >= 1) & ((F.length("text") <= most) | (F.col("label") == 0))
    sizes = texts.join(chosen, "id").where(fits).select("id", "label", F.least(F.length("text"), F.lit(most)).alias("n"))
    sizes = sizes.groupBy("id", "label").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    within = sizes.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") <= chars).select("id", "label")
    return texts.join(F.broadcast(within), "id").where(fits).select("label", F.substring("text", 1, most).alias("text"))


def fit(sample: DataFrame, steps: int = 400, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Noisy-or regression on the sample by Adam over all rows."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                owner, feature, row, _ = _features(batch.column("text"))
                picks = _distinct(owner, feature)
                owner, feature = owner[picks], feature[picks]
                bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
                ends = np.searchsorted(owner, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label"),
                        pa.array(np.diff(bounds)),
                        pa.array(
                            [(owner[a:b] - c).astype(np.int32).tobytes() for a, b, c in zip(ends, ends[1:], bounds)],
                            pa.binary(),
                        ),
                        pa.array([feature[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                    ],
                    names=["label", "n", "owner", "feature"],
                )

    rows = sample.mapInArrow(extract, "label int, n bigint, owner binary, feature binary").toArrow()
    label = rows.column("label").to_numpy().astype(np.int64)
    n = rows.column("n").to_numpy()
    base = np.repeat(
        np.concatenate([[0], np.cumsum(n)])[:-1], pc.binary_length(rows.column("owner")).to_numpy() // 4
    )
    owner = np.frombuffer(_joined(rows, "owner"), np.int32) + base
    feature = np.frombuffer(_joined(rows, "feature"), np.uint64)
    del rows
    bag = np.repeat(np.arange(len(n)), n)
    known = _select(bag[owner], feature, label)
    at = np.searchsorted(known, feature)
    at = np.minimum(at, max(len(known) - 1, 0))
    hit = known[at] == feature if len(known) else np.zeros(len(feature), bool)
    owner, at = owner[hit], at[hit]
    return _descend(known, owner, at, bag, label, len(n), steps, rate, decay)


def _joined(rows: pa.Table, name: str) -> bytes:
    return b"".join(x.as_buffer() for chunk in rows.column(name).chunks for x in chunk)


def _select(bag: np.ndarray, feature: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Features whose documents are toxic more often than chance allows."""
    picks = _distinct(bag, feature)
    values, inverse = np.unique(feature[picks], return_inverse=True)
    of_bag = label[bag[picks]]
    ones = np.bincount(inverse, of_bag, len(values)) + 0.5
    zeros = np.bincount(inverse, 1 - of_bag, len(values)) + 0.5
    all_ones, all_zeros = label.sum() + 1.0, (1 - label).sum() + 1.0
    odds = np.log(ones * (all_zeros - zeros)) - np.log(zeros * (all_ones - ones))
    z = odds / np.sqrt(1 / ones + 1 / zeros + 1 / (all_ones - ones) + 1 / (all_zeros - zeros))
    good = np.flatnonzero(z >= LEAST_Z)
    best = good[np.argsort(-z[good], kind="stable")[:MOST_FEATURES]]
    return np.sort(values[best])


def _descend(known, owner, at, bag, label, n_bags, steps, rate, decay) -> Model:
    ceiling = float(np.log(LEAK / (1 - LEAK)))
    theta = np.append(np.zeros(len(known)), ceiling)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(owner, theta[at], len(bag))
        p = 1 / (1 + np.exp(-z))
        log_rest = -np.logaddexp(0, z)
        total = np.bincount(bag, log_rest, n_bags)
        pull = np.where(label == 1, np.exp(total) / np.maximum(-np.expm1(total), 1e-12), -1.0)
        grad_z = -p * pull[bag]
        grad = np.append(np.bincount(at, grad_z[owner], len(known)), grad_z.sum()) / max(n_bags, 1)
        grad[:-1] += decay * theta[:-1] / max(n_bags, 1)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        theta[-1] = min(theta[-1], ceiling)
    return Model(known, theta[:-1], float(theta[-1]))


def _sentence_scores(model: Model, column: pa.Array):
    """Row and log odds of each sentence, sentence starts in the slice's bytes."""
    owner, feature, row, start = _features(column)
    z = np.full(len(row), model.bias)
    if len(model.features) and len(feature):
        mask = np.zeros(1 << 20, bool)
        low = np.uint64((1 << 20) - 1)
        mask[(model.features & low).astype(np.int64)] = True
        maybe = np.flatnonzero(mask[(feature & low).astype(np.int64)])
        at = np.minimum(np.searchsorted(model.features, feature[maybe]), len(model.features) - 1)
        sure = model.features[at] == feature[maybe]
        owner, at = owner[maybe[sure]], at[sure]
        picks = _distinct(owner, at)
        z += np.bincount(owner[picks], model.weights[at[picks]], len(row))
    return row, z, start


def _log_rest(row: np.ndarray, z: np.ndarray, n: int) -> np.ndarray:
    """Of each row, the logarithm of the probability that no sentence is toxic."""
    rest = -np.logaddexp(0, z)
    weak = z < np.log(WEAK / (1 - WEAK))
    quiet = np.bincount(row, np.where(weak, rest, 0), n)
    return np.bincount(row, np.where(weak, 0, rest), n) + np.maximum(quiet, np.log1p(-MOST_WEAK))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with ``score`` and ``offending`` (sentences at 0.5 or more: code point
    offset of the first word, the sentence's score).  A name that is taken already gets
    a trailing underscore."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    names = [fresh(docs, "score"), fresh(docs, "offending")]
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kinds = f"`{names[0]}` double, `{names[1]}` array<struct<start:bigint,score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        item = pa.list_(pa.struct([("start", pa.int64()), ("score", pa.float64())]))
        for whole in batches:
            for batch in slices(whole, text_col):
                column = batch.column(text_col)
                row, z, start = _sentence_scores(model, column)
                rest = _log_rest(row, z, batch.num_rows)
                loud = np.flatnonzero(z >= np.log(OFFENDING / (1 - OFFENDING)))
                found: list[list] = [[] for _ in range(batch.num_rows)]
                if len(loud):
                    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
                    base = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                    for at in loud.tolist():
                        r = int(row[at])
                        before = column[r].as_py().encode()[: start[at] - base[r]].decode("utf-8", "ignore")
                        found[r].append({"start": len(before), "score": float(1 / (1 + np.exp(-z[at])))})
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(-np.expm1(rest)), pa.array(found, item)],
                    names=[*batch.schema.names, *names],
                )

    return docs.mapInArrow(run, f"{plain}, {kinds}")


def held_out(id_col: str, folds: int, fold: int):
    """True for the rows whose label is never learned from; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on labels outside the held-out fold (crc32 of the id mod 3 is 1)."""
    learned = labels.where(~held_out(id_col, 3, 1))
    return fit(labelled_sample(docs, learned, id_col, text_col, label_col, SAMPLE_ROWS, SAMPLE_CHARS))


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that score under the threshold, with all their columns."""
    kept = fresh(docs, "score")
    return score(docs, model, id_col, text_col).where(F.col(kept) < THRESHOLD).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
