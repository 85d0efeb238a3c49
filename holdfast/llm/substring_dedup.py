"""Repeated passages by super-k-mers.

A window is 13 consecutive words of one document.  Its minimiser is the first of its runs
of ``MINIMISER_WORDS`` words by the order of longer words first, then hash, so equal
windows have equal minimisers and common short words rarely are one.
Consecutive windows with the same minimiser travel as one packed string to the bucket
of that minimiser.  There the strings come sorted by minimiser and document, their
windows are sorted by a 128-bit hash of the word sequence, and the first document of
each run of equal windows is the one that keeps it.  A bucket is read as a stream: what
is held is one batch and the distinct windows of the minimiser that is being read, so
copies of one passage do not add up in memory.  Documents without a repeated window
are finished where they are read; only the others meet their repeated ranges in a join.

Defined results: words are runs without white space, compared unchanged; null, empty
and short texts (under 13 words) lose nothing; windows are judged on the input; equal
windows inside one document, or in rows with the same id, do not count against each
other; a row without an id keeps all words and costs no other row any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import slot_filter, stored, with_slot_flag
from holdfast.llm.words import WHITE, Powers, find_words, run_hashes, separators, slices, word_hashes

WINDOW = 13
MINIMISER_WORDS = 2
SLICE_BYTES, ZSTD_LEVEL = 1 << 18, 5
BLOCK_BYTES = 16 << 20
# Of a bucket's hash so many bits travel; buckets that share them are judged together.
BUCKET_BITS = 24
KMERS = "bucket int, doc_id bigint, text_hash int, first int, packed binary"


def super_kmers(
    docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER_WORDS, deals: int | None = None
) -> DataFrame:
    """Rows (bucket, doc_id, text_hash, first, packed) from (doc_id, text_hash, text).

    ``packed`` is the document's bytes from the first word of the first window to the
    last word of the last one; ``first`` is the index of that first word.  A task sends
    its strings in compressed blocks, one for each of the ``deals`` the buckets are dealt
    into (by default as many as shuffle partitions), and they are unpacked on arrival.
    """
    spark = docs.sparkSession
    deals = deals or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaks, powers = separators(WHITE), Powers()
        waiting, size = [], 0
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                found = _cut_slice(batch, breaks, powers, window, minimiser, deals)
                if found is not None:
                    waiting.append(found)
                    size += found.nbytes
                if size >= BLOCK_BYTES:
                    yield _blocks(waiting)
                    waiting, size = [], 0
        if waiting:
            yield _blocks(waiting)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                for rows in pa.ipc.open_stream(block.as_buffer()):
                    yield from slices(rows, "packed", SLICE_BYTES)

    blocks = docs.select("doc_id", "text_hash", "text").mapInArrow(cut, "deal int, block binary")
    return blocks.repartitionById(deals, F.col("deal")).mapInArrow(unpack, KMERS)


def _cut_slice(
    batch: pa.RecordBatch, breaks: np.ndarray, powers: Powers, window: int, minimiser: int, deals: int
) -> pa.RecordBatch | None:
    words = find_words(batch.column("text"), breaks, lower=False)
    n = len(words.start) - window + 1
    if n <= 0:
        return None
    sub = run_hashes(word_hashes(words, powers), minimiser, powers)
    ends = np.cumsum(words.end - words.start)
    length = ends[minimiser - 1 :].copy()
    length[1:] -= ends[: len(length) - 1]
    rank = (sub >> np.uint64(12)) | ((4095 - np.minimum(length, 4095)).astype(np.uint64) << np.uint64(52))
    views = np.lib.stride_tricks.sliding_window_view(rank, window - minimiser + 1)
    place = np.arange(n) + views.argmin(axis=1)
    row = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
    valid = row[:n] == row[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:n] != row[: n - 1])
    head = np.flatnonzero(new & valid)
    if not len(head):
        return None
    stops = np.append(np.flatnonzero(new | ~valid), n)
    tail = stops[np.searchsorted(stops, head, side="right")] - 1 + window - 1
    data = words.data.tobytes()
    packed = [data[a:b] for a, b in zip(words.start[head].tolist(), words.end[tail].tolist(), strict=True)]
    owner = pa.array(row[head])
    least = sub[place[head]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(((least >> np.uint64(32)) % np.uint64(deals)).astype(np.int32)),
            pa.array((least & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int32)),
            batch.column("doc_id").take(owner),
            batch.column("text_hash").take(owner),
            pa.array((head - words.first[row[head]]).astype(np.int32)),
            pa.array(packed, pa.binary()),
        ],
        names=["deal", "bucket", "doc_id", "text_hash", "first", "packed"],
    )


def _blocks(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One compressed block per deal from the strings found so far."""
    rows = pa.Table.from_batches(waiting).combine_chunks()
    deal = rows.column("deal").to_numpy()
    order = np.argsort(deal, kind="stable")
    rows = rows.drop_columns("deal").take(pa.array(order))
    names, heads = np.unique(deal[order], return_index=True)
    ends = np.append(heads[1:], len(order))
    blocks = []
    for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
        sink = pa.BufferOutputStream()
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZSTD_LEVEL))
        with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
            out.write_table(rows.slice(a, b - a).combine_chunks())
        blocks.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(names.astype(np.int32)), pa.array(blocks, pa.binary())], names=["deal", "block"]
    )


def repeated_runs(kmers: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, text_hash, first, n): n windows from word ``first`` on that also
    start in a document with a smaller id.  All rows of a bucket are in one partition."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaks, powers, others = separators(WHITE), Powers(), Powers(1)
        held_key, held = None, np.zeros((3, 0), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("bucket").to_numpy()
            doc = batch.column("doc_id").to_numpy()
            words = find_words(batch.column("packed"), breaks, lower=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
            n = len(words.start) - window + 1
            at = np.flatnonzero(row[:n] == row[window - 1 :])
            hashes = word_hashes(words, powers)
            one = run_hashes(hashes, window, powers)[at]
            two = run_hashes(hashes, window, others)[at]
            owner = doc[row[at]].astype(np.int64)
            if held_key is None or key[0] != held_key:
                held = np.zeros((3, 0), np.uint64)
            seen = held.shape[1]
            a = np.concatenate([held[0], one])
            b = np.concatenate([held[1], two])
            d = np.concatenate([held[2].view(np.int64), owner])
            order = np.lexsort((d, b, a))
            a, b, d = a[order], b[order], d[order]
            lead = np.ones(len(a), bool)
            lead[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            smallest = d[np.flatnonzero(lead)][np.cumsum(lead) - 1]
            late = np.zeros(len(a), bool)
            late[order] = d > smallest
            late = late[seen:]
            held_key = key[-1]
            of_last = np.zeros(len(order), bool)
            of_last[:seen] = key[0] == held_key
            of_last[seen:] = key[row[at]] == held_key
            keep = lead & of_last[order]
            held = np.stack([a[keep], b[keep], d[keep].view(np.uint64)])
            # consecutive late windows of one string become one run
            start = late.copy()
            start[1:] &= ~(late[:-1] & (row[at][1:] == row[at][:-1]))
            stop = late.copy()
            stop[:-1] &= ~(late[1:] & (row[at][1:] == row[at][:-1]))
            i, j = np.flatnonzero(start), np.flatnonzero(stop)
            if len(i):
                whose = row[at][i]
                first = batch.column("first").to_numpy()[whose] + at[i] - words.first[whose]
                owners = pa.array(whose)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(owners),
                        batch.column("text_hash").take(owners),
                        pa.array(first.astype(np.int32)),
                        pa.array((j - i + 1).astype(np.int32)),
                    ],
                    names=["doc_id", "text_hash", "first", "n"],
                )

    return (
        kmers.sortWithinPartitions("bucket", "doc_id")
        .mapInArrow(judge, "doc_id bigint, text_hash int, first int, n int")
    )


def _removed(n_words: int, runs: list[dict] | None, window: int) -> np.ndarray:
    steps = np.zeros(n_words + 1, np.int64)
    for run in runs or ():
        steps[run["first"]] += 1
        steps[min(n_words, run["first"] + run["n"] + window - 1)] -= 1
    return np.cumsum(steps[:-1]) > 0


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    minimiser: int = MINIMISER_WORDS,
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (kept words joined by one
    space), kept_sha256."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        # tells rows apart that share an id but not the text
        F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 16)).cast("int").alias("text_hash"),
        F.col(text_col).cast("string").alias("text"),
    )
    kmers = super_kmers(rows.where("doc_id is not null"), window, minimiser)
    runs = stored(repeated_runs(kmers, window))
    flags = stored(slot_filter(runs, ["doc_id", "text_hash"]))
    probed = with_slot_flag(rows, flags, ["doc_id", "text_hash"], "may_lose")
    per_row = runs.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("first", "n")).alias("runs")
    )
    kind = "array<struct<first:int,n:int>>"
    alone = probed.where("not may_lose").select("doc_id", "text", F.lit(None).cast(kind).alias("runs"))
    joined = (
        probed.where("may_lose")
        .join(per_row, ["doc_id", "text_hash"], "left")
        .select("doc_id", "text", "runs")
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                out: list[tuple[int, int, str, str]] = []
                for text, found in zip(
                    batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True
                ):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    gone = 0
                    kept = words
                    if found:
                        marks = _removed(len(words), found, window)
                        gone = int(marks.sum())
                        kept = [w for w, m in zip(words, marks.tolist(), strict=True) if not m]
                    line = b" ".join(kept)
                    digest = hashlib.sha256(line).hexdigest()
                    out.append((len(words), gone, line.decode("utf-8", "replace"), digest))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([x[0] for x in out], pa.int64()),
                        pa.array([x[1] for x in out], pa.int64()),
                        pa.array([x[2] for x in out], pa.string()),
                        pa.array([x[3] for x in out], pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
                )

    return (
        alone.unionByName(joined)
        .mapInArrow(
            keep, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string"
        )
        .withColumnRenamed("doc_id", id_col)
    )
