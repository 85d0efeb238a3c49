"""Benchmark passages in documents, by one Aho-Corasick automaton over the benchmark.

Texts are lower-cased (A-Z) and cut into words of digits, letters and all characters
beyond ASCII.  A benchmark item gives its windows of 13 consecutive words, or itself as
one window if it has fewer.  The automaton holds the windows as word strings with a
space on either side, so it reads a normalised document once and finds whole words
only.  Hits are given as word ranges and as character offsets of the original text.

The windows are broadcast in blocks of at most ``block_chars`` characters; a larger
benchmark takes one pass per block, and passes add to each other's hits.

Defined results: null and empty texts have no words and no hits; an item without words
has no window; equal windows of several items count for each of them; windows of items
without an id mark words but name no item; repeated rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import fresh, stored
from holdfast.llm.words import MARKS, slices

WINDOW = 13
BLOCK_CHARS = 4_000_000
# Share of hit words from which a document counts as contaminated (5 in 100).
RATIO = 20
HITS = "array<struct<first_word:bigint,last_word:bigint,start:bigint,end:bigint>>"
FOUND = f"n_words bigint, n_hit bigint, items array<bigint>, hits {HITS}"


def _table() -> bytes:
    lower = bytearray(range(256))
    for value in range(0x41, 0x5B):
        lower[value] += 0x20
    for value in MARKS:
        lower[value] = 0x20
    return bytes(lower)


def _words(text: str | None, table: bytes) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(table).split()


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows with the items that have them."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _table()
        for frame in frames:
            rows = set()
            for item, text in zip(frame["item"], frame["text"], strict=True):
                words = _words(text, table)
                for at in range(max(1, len(words) - window + 1) if words else 0):
                    rows.add((b" ".join(words[at : at + window]).decode("utf-8"), item))
            yield pd.DataFrame(sorted(rows, key=str), columns=["words", "item"]).astype({"item": "Int64"})

    cuts = benchmark.select(
        F.col(id_col).cast("long").cast("string").alias("item"), F.col(text_col).cast("string").alias("text")
    ).mapInPandas(cut, "words string, item bigint")
    return cuts.groupBy("words").agg(F.collect_set("item").alias("items"))


def _scan(batch: pa.RecordBatch, text_col: str, automaton, sizes, items, window_table: bytes):
    """Per row: its words, the hit mark of each, the items."""
    for text in batch.column(text_col).to_pylist():
        words = _words(text, window_table)
        marks, found = None, []
        if words and len(automaton):
            line = b" " + b" ".join(words) + b" "
            ends, which = [], []
            for end, value in automaton.iter(line.decode("latin-1")):
                ends.append(end)
                which.append(value)
            if ends:
                gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
                last = np.searchsorted(gaps, np.array(ends))
                first = np.searchsorted(gaps, np.array(ends) - sizes[which] + 1)
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, first, 1)
                np.add.at(steps, last, -1)
                marks = np.cumsum(steps)[:-1] > 0
                found = sorted({item for value in set(which) for item in items[value]})
        yield text, len(words), marks, found


def _spans(text: str, marks: np.ndarray) -> list[dict]:
    """Runs of hit words with their offsets in the original text."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    at = [m.span() for m in word.finditer(text)]
    return [
        {"first_word": int(a), "last_word": int(b) - 1, "start": at[a][0], "end": at[b - 1][1]}
        for a, b in zip(edges[::2], edges[1::2], strict=True)
    ]


def _automaton(windows: list[tuple[str, list[int]]]):
    machine = ahocorasick.Automaton()
    sizes, items = [], []
    for at, (words, owners) in enumerate(windows):
        line = f" {words} ".encode().decode("latin-1")
        machine.add_word(line, at)
        sizes.append(len(line))
        items.append(list(owners))
    if len(machine):
        machine.make_automaton()
    return machine, np.array(sizes, np.int64), items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_chars: int):
    windows = stored(benchmark_windows(benchmark, id_col, text_col, window))
    size = F.length("words") + 2 + 8 * F.size("items")
    total = windows.agg(F.sum(size)).first()[0] or 0
    n = -(-total // block_chars) or 1
    spark = benchmark.sparkSession
    for k in range(n):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k).collect()
        yield spark.sparkContext.broadcast([(r["words"], r["items"]) for r in rows])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document: its columns, n_words, n_hit, items, hits (runs of hit words);
    a name that is taken already gets a trailing underscore."""
    names = {n: fresh(docs, n) for n in ("n_words", "n_hit", "items", "hits")}
    kinds = dict(zip(names, FOUND.split(", "), strict=True))
    added = ", ".join(f"`{names[n]}` {kinds[n].partition(' ')[2]}" for n in names)
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    passes = docs
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, window, block_chars)):
        if k:
            passes = stored(passes)
        passes = passes.mapInArrow(_pass(block, text_col, names, k > 0), f"{plain}, {added}")
    return passes


def _pass(block, text_col: str, names: dict[str, str], again: bool):
    """Adds the block's hits to each batch; ``again``: to those of earlier blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, sizes, items = _automaton(block.value)
        table = _table()
        hit = pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "start", "end")])
        for whole in batches:
            for batch in slices(whole, text_col):
                before = batch.select(list(names.values())).to_pylist() if again else None
                rows: dict[str, list] = {n: [] for n in names}
                for at, (text, n, marks, found) in enumerate(
                    _scan(batch, text_col, machine, sizes, items, table)
                ):
                    if before:
                        old = before[at]
                        marks = np.zeros(n, bool) if marks is None else marks
                        for run_ in old[names["hits"]]:
                            marks[run_["first_word"] : run_["last_word"] + 1] = True
                        found = sorted({*found, *old[names["items"]]})
                    some = marks is not None and marks.any()
                    rows["n_words"].append(n)
                    rows["n_hit"].append(int(marks.sum()) if some else 0)
                    rows["items"].append(found)
                    rows["hits"].append(_spans(text, marks) if some else [])
                plain = batch.drop_columns(list(names.values())) if again else batch
                yield pa.RecordBatch.from_arrays(
                    [
                        *plain.columns,
                        pa.array(rows["n_words"], pa.int64()),
                        pa.array(rows["n_hit"], pa.int64()),
                        pa.array(rows["items"], pa.list_(pa.int64())),
                        pa.array(rows["hits"], pa.list_(hit)),
                    ],
                    names=[*plain.schema.names, *names.values()],
                )

    return run


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (RATIO * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    kept = [fresh(docs, n) for n in ("n_words", "n_hit")]
    found = find_contamination(docs, benchmark, **options)
    return found.where(~contaminated(F.col(kept[1]), F.col(kept[0]))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
