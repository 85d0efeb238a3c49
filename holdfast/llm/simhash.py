"""Near-duplicate documents by SimHash fingerprints, joined on a grid of segment popcounts.

A bit of a document's fingerprint is set if it is set in over half of the XXH64 hashes
(seed 42) of its 3-word shingles, repeats included.  Documents link when their fingerprints
differ in at most two bits.

1. Equal fingerprints form a class; only classes go on, so copies cost one class.
2. A fingerprint is embedded as the bit counts of its 16 segments of four bits.  The
   Manhattan distance of two embeddings is a lower bound of the bits that differ.
3. Grid range join: a class stands in its own cell and in all cells at distance one (33 at
   most).  Embeddings at distance two or less have a cell in common, half way between them,
   so no link is missed.  Inside a cell the fingerprints are compared exactly.
4. Cells near an embedding that over ``HOT`` classes share are not compared: their classes
   go to the finest grid instead, with segments of one bit, where a cell has 65 classes at
   most.  What a task holds is thus bounded whatever the data, and no pair is left out.
5. A cell hands on a forest of its links, never all pairs; components follow from that.

Defined results: A-Z are lower-cased, words are runs without white space; fewer than three
words are one shingle; null, empty and white texts have fingerprint zero and link like any
other; a component's id is its smallest document id (rows without an id take part, and get
a null id only if no row of their component has one); rows with one id and several texts
are judged by text; repeated rows are repeated in the result; an empty table gives none.
Long texts are read in pieces of ``PIECE_BYTES``.  Only the id and text columns are read, so
other columns of any name do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import bounded_batches, slot_filter, stored, with_slot_flag
from holdfast.llm.jaccard import components

SHINGLE, SEED, BITS = 3, 42, 64
PIECE_BYTES = 1 << 20
SEGMENT_BITS = 4  # of the coarse grid; the fine one has segments of one bit
HOT = 64
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def token_pieces(text: bytes, most: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The lower-cased words in runs of about ``most`` bytes; each run but the first starts
    with the last two words of the run before, so that every shingle is in one run."""
    at, kept = 0, []
    while at < len(text):
        gap = WHITE.search(text, at + most)
        to = gap.start() if gap else len(text)
        found = kept + text[at:to].lower().split()
        at = to
        if len(found) >= SHINGLE or at >= len(text):
            yield found
            kept = found[1 - SHINGLE :]
        else:
            kept = found


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of every three consecutive words joined by a space; of all if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - SHINGLE + 1)


def fingerprint(text: bytes | None) -> int:
    ones, n = np.zeros(BITS, np.int64), 0
    for words in token_pieces(text or b""):
        hashes = shingle_hashes(words)
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 15):
            part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node): the 64 bits of each row's fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(made, pa.int64())], names=["doc_id", "node"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, node bigint")


def embedding(bits: np.ndarray, width: int) -> np.ndarray:
    """The bit counts of the segments, each in its own ``width`` bits of one number."""
    if width == 1:
        return bits.copy()
    twos, fours = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333)
    with np.errstate(over="ignore"):
        pairs = bits - ((bits >> np.uint64(1)) & twos)
        return (pairs & fours) + ((pairs >> np.uint64(2)) & fours)


def ball(home: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells at Manhattan distance 0 or 1 of each embedding, and whose they are."""
    n = len(home)
    cells, whose = [home], [np.arange(n)]
    for shift in range(0, BITS, width):
        step = np.uint64(1 << shift)
        count = (home >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        up, down = np.flatnonzero(count < width), np.flatnonzero(count > 0)
        cells += [home[up] + step, home[down] - step]
        whose += [up, down]
    return np.concatenate(cells), np.concatenate(whose)


def grid(classes: DataFrame, width: int, embedded: bool = False) -> DataFrame:
    """(cell, node): the cells of each class; ``embedded`` rows are embeddings already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                node = whole.column("node").slice(at, 4096).to_numpy(zero_copy_only=False)
                bits = node.view(np.uint64)
                cells, whose = ball(bits if embedded else embedding(bits, width), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.view(np.int64)), pa.array(node[whose])], names=["cell", "node"]
                )

    return classes.select("node").mapInArrow(run, "cell bigint, node bigint")


def homes(classes: DataFrame) -> DataFrame:
    """The coarse embedding of each class, as column ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            found = embedding(bits, SEGMENT_BITS).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["node"])

    return classes.select("node").mapInArrow(run, "node bigint")


def forest(group: np.ndarray, bits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that join what links inside each run of equal ``group`` values."""
    label = np.arange(len(bits))
    near = np.arange(len(bits))
    for shift in range(1, len(bits)):
        near = near[: np.searchsorted(near, len(bits) - shift)]
        near = near[group[near] == group[near + shift]]
        if not len(near):
            break
        i = near[np.bitwise_count(bits[near] ^ bits[near + shift]) <= most]
        a, b = label[i], label[i + shift]
        while len(i) and (a != b).any():
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = label[label]
            a, b = label[i], label[i + shift]
    leaf = np.flatnonzero(label != np.arange(len(bits)))
    return label[leaf], leaf


def links(cells: DataFrame, most: int) -> DataFrame:
    """Edges (a, b) that join the classes of each (fine, cell) that differ in ``most`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _linked(batches, most)

    rows = cells.repartition("fine", "cell").sortWithinPartitions("fine", "cell", "node")
    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _linked(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Streams sorted cells; only the cell that a batch ends in is held for the next."""
    names = ("fine", "cell", "node")
    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        fresh = [batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in names]
        fine, cell, node = (np.concatenate(x) for x in zip(held, fresh, strict=True))
        if not len(node):
            continue
        new = np.append(True, (fine[1:] != fine[:-1]) | (cell[1:] != cell[:-1]))
        last = np.flatnonzero(new)[-1]
        held = [fine[last:], cell[last:], node[last:]]
        yield _edges(np.cumsum(new)[:last], node[:last], most)
    yield _edges(np.zeros(len(held[2]), np.int64), held[2], most)


def _edges(group: np.ndarray, node: np.ndarray, most: int) -> pa.RecordBatch:
    a, b = forest(group, node.view(np.uint64), most)
    return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])


def linked_classes(classes: DataFrame, most: int = 2, hot: int = HOT) -> DataFrame:
    """(node, comp): components of the classes that differ in at most ``most`` (2 or less) bits."""
    if not 0 <= most <= 2:
        raise ValueError("cells of radius one meet up to two differing bits")
    heavy = homes(classes).groupBy("node").count().where(F.col("count") > hot).select("node")
    flags = stored(slot_filter(grid(heavy, SEGMENT_BITS, embedded=True).select("cell").distinct(), ["cell"]))
    cells = grid(classes, SEGMENT_BITS)
    cells = with_slot_flag(cells, flags, ["cell"], "crowded")
    coarse = cells.where("not crowded").select(F.lit(0).alias("fine"), "cell", "node")
    if flags.isEmpty():
        return components(links(coarse, most))
    crowded = stored(cells.where("crowded").select("node").distinct())
    fine = grid(crowded, 1).select(F.lit(1).alias("fine"), "cell", "node")
    return components(links(coarse.unionByName(fine), most))


def simhash_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2, hot: int = HOT
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of the table."""
    bounded_batches(docs.sparkSession)
    named = stored(fingerprints(docs, id_col, text_col))
    classes = stored(named.groupBy("node").agg(F.min("doc_id").alias("first_id")))
    labels = linked_classes(classes, most, hot)
    linked = classes.join(labels, "node")
    smallest = linked.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_class = classes.join(linked.select("node", "comp").join(smallest, "comp").drop("comp"), "node", "left")
    ids = of_class.select("node", F.coalesce("component_id", "first_id").alias("component_id"))
    return named.join(stored(ids), "node", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"
    )
