"""Phrases of two to four words that stand together, counted with burst tries.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words at
blanks and tabs.  A word's id is a 64-bit hash of its language and bytes; a phrase is the path
of its word ids, and its key a hash of that path.

1. Phrases are counted length by length, words first.  A phrase of k words is counted only
   where both phrases of k - 1 words inside it are frequent; that is looked up in a bit filter
   of bounded size, whose false hits cost a count and change no result.
2. A task counts in a ``BurstTrie``: hash containers (keys with their counts, pending ones
   merged in whenever they are as many) under inner nodes that branch by four bits of one
   word's id a level.  A container with over ``BURST`` phrases bursts into 16 by the next word.
   When the trie holds over ``BUDGET`` phrases, whole subtrees leave it, largest first, as
   runs sorted by prefix partition and key, one compressed block per partition.
3. A prefix partition is named by all words but the last and four bits of the last, so the
   phrases after one hot prefix are in 16.  Its runs are merged as they arrive; what a task holds
   are the distinct phrases of one partition.  Phrases under ``least`` are dropped there.
4. Cuts, covering phrases and ranks are joins and windows over the frequent phrases; a language
   is ranked in ``SHARES`` shares first, so its last task reads at most that many lists.

Defined results: a null language is ``und``, a null text empty; rows count whatever their id,
repeated rows repeatedly; equal scores are ordered by a, then by phrase in UTF-8 byte order; a
language without a frequent phrase, and an empty table, have no rows; only the language and
text columns are read, others of any name do not matter.  Texts over ``PIECE_BYTES`` are
cut at piece ends, so a very long text is never held as words at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import bounded_batches, stored
from holdfast.llm.words import Powers, find_words, mix, separators, slices, utf8, word_hashes

LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
PIECE_ENDS = tuple(b".,;:!?") + tuple(range(0x0A, 0x0E))
BLANKS = (0x09, 0x20)
PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
PIECE_BYTES = 1 << 20
BURST, BUDGET = 1 << 18, 1 << 22
SHARES = 64  # of a language's phrases, ranked on their own first
SLACK = 4096  # pending phrases of a small container
DIGIT_BITS = 4
PARTS_PER_TASK = 8
LEAST_FILTER, MOST_FILTER = 20, 26  # powers of two, in bits; 8 MB at most
STEP = np.uint64(0x9E3779B97F4A7C15)


def path_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The key of each path of word ids; of one word, its id."""
    key = ids[0]
    with np.errstate(over="ignore"):
        for more in ids[1:]:
            key = mix(key * STEP + more)
    return key


class BurstTrie:
    """Counts of phrases.  Rows are record batches of (key, n, w1, w2, ...)."""

    def __init__(self, burst: int = BURST):
        self.burst, self.root, self.size = burst, Container(min(burst, SLACK)), 0

    def add(self, rows: pa.RecordBatch) -> None:
        self.root, grown = self._into(self.root, rows)
        self.size += grown

    def _into(self, node: Container | list, rows: pa.RecordBatch, depth: int = 0) -> tuple:
        if isinstance(node, list):
            grown = 0
            for digit, part in by_digit(rows, depth):
                node[digit], more = self._into(node[digit], part, depth + 1)
                grown += more
            return node, grown
        grown = node.add(rows)
        if node.merged_size <= self.burst or depth >= rows.num_columns - 2:
            return node, grown
        children: list = [Container(node.slack) for _ in range(1 << DIGIT_BITS)]
        held = node.merged()
        before = node.size - grown
        now = 0
        for digit, part in by_digit(held, depth):
            children[digit], more = self._into(children[digit], part, depth + 1)
            now += more
        return children, now - before

    def spill(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Takes out whole subtrees, largest first, until at most ``keep`` phrases are left."""
        trees = self.root if isinstance(self.root, list) else [self.root]
        for k in sorted(range(len(trees)), key=lambda k: -_size(trees[k])):
            if self.size <= keep:
                return
            self.size -= _size(trees[k])
            yield from _contents(trees[k])
            trees[k] = Container(min(self.burst, SLACK))
        if not isinstance(self.root, list):
            self.root = trees[0]


class Container:
    """Phrases with counts: one merged batch and pending ones."""

    def __init__(self, slack: int = SLACK):
        self.slack, self.batches, self.size, self.merged_size = slack, [], 0, 0

    def add(self, rows: pa.RecordBatch) -> int:
        before = self.size
        self.batches.append(rows)
        self.size += rows.num_rows
        if self.size > 2 * self.merged_size + self.slack:
            self.merged()
        return self.size - before

    def merged(self) -> pa.RecordBatch | None:
        if len(self.batches) > 1 or self.size != self.merged_size:
            self.batches = [summed(self.batches)]
        self.merged_size = self.size = sum(b.num_rows for b in self.batches)
        return self.batches[0] if self.batches else None


def _size(node: Container | list) -> int:
    return sum(map(_size, node)) if isinstance(node, list) else node.size


def _contents(node: Container | list) -> Iterator[pa.RecordBatch]:
    if isinstance(node, list):
        for child in node:
            yield from _contents(child)
    elif node.size:
        yield node.merged()


def as_uint(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def by_digit(rows: pa.RecordBatch, depth: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows parted by the leading bits of word ``depth`` of their paths."""
    digit = (as_uint(rows.column(2 + depth)) >> np.uint64(64 - DIGIT_BITS)).astype(np.uint8)
    order = np.argsort(digit, kind="stable")
    bounds = np.searchsorted(digit[order], np.arange((1 << DIGIT_BITS) + 1))
    rows = rows.take(pa.array(order))
    for k in range(1 << DIGIT_BITS):
        if bounds[k] < bounds[k + 1]:
            yield k, rows.slice(bounds[k], bounds[k + 1] - bounds[k])


def summed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row per key, sorted, with added counts.  A stable sort merges sorted runs."""
    rows = pa.concat_batches(batches)
    key = as_uint(rows.column("key"))
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order
    n = rows.column("n").to_numpy()[order]
    found = rows.take(pa.array(order[heads]))
    total = np.add.reduceat(n, heads) if len(heads) else n
    return found.set_column(1, "n", pa.array(total, pa.int64()))


def text_pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """(lang, text) in slices of about ``most`` bytes; longer texts are cut at piece ends."""
    for rows in slices(batch, "text", most):
        if rows.num_rows > 1 or rows.column("text").null_count or rows.column("text").nbytes <= 2 * most:
            yield rows
            continue
        data, at = utf8(rows.column("text"))[0].tobytes(), 0
        while at < len(data):
            gap = PIECE_END.search(data, at + most)
            to = gap.end() if gap else len(data)
            text = pa.array([data[at:to]], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([rows.column("lang"), text], names=["lang", "text"])
            at = to


class Reader:
    """Word ids of a slice, and where words follow each other inside a piece."""

    def __init__(self) -> None:
        self.breaks, self.ends = separators(PIECE_ENDS + BLANKS), separators(PIECE_ENDS)
        self.powers, self.salts = Powers(), {}

    def read(self, rows: pa.RecordBatch) -> tuple:
        words = find_words(rows.column("text"), self.breaks, lower=True)
        row = np.repeat(np.arange(rows.num_rows), np.diff(words.first))
        salt = np.array([self._salt(x) for x in rows.column("lang").to_pylist()], np.uint64)
        ids = mix(word_hashes(words, self.powers) ^ salt[row])
        piece = np.cumsum(self.ends[words.data], dtype=np.int64)[words.start]
        follows = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        return words, row, ids, follows

    def _salt(self, lang: str) -> int:
        if lang not in self.salts:
            digest = hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            self.salts[lang] = int.from_bytes(digest, "little")
        return self.salts[lang]


class Filter:
    """Bits of the frequent keys: what it misses is surely not frequent."""

    def __init__(self, frequent: DataFrame):
        n = frequent.count()
        self.power = min(MOST_FILTER, max(LEAST_FILTER, (16 * n).bit_length()))
        slot = F.expr(f"key & {(1 << self.power) - 1}L")
        rows = (
            frequent.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63L as int))").alias("bit"))
            .groupBy("word")
            .agg(F.bit_or("bit").alias("bits"))
            .toArrow()
        )
        table = np.zeros(1 << self.power - 6, np.int64)
        table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
        self.value = frequent.sparkSession.sparkContext.broadcast(table)

    def lookup(self):
        """A function from keys to booleans that holds plain data only."""
        held, mask = self.value, np.uint64((1 << self.power) - 1)

        def known(keys: np.ndarray) -> np.ndarray:
            slot = keys & mask
            bits = held.value.view(np.uint64)[(slot >> np.uint64(6)).astype(np.int64)]
            return (bits >> (slot & np.uint64(63))) & np.uint64(1) == 1

        return known


def _word_rows(reader: Reader, rows: pa.RecordBatch) -> pa.RecordBatch | None:
    """(key, n, w1, lang, word): the distinct words of a slice."""
    words, row, ids, _ = reader.read(rows)
    key, head, n = np.unique(ids, return_index=True, return_counts=True)
    if not len(key):
        return None
    data = words.data.tobytes()
    spans = zip(words.start[head].tolist(), words.end[head].tolist(), strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key.view(np.int64)),
            pa.array(n.astype(np.int64)),
            pa.array(key.view(np.int64)),
            rows.column("lang").take(pa.array(row[head])),
            pa.array([data[a:b] for a, b in spans], pa.binary()),
        ],
        names=["key", "n", "w1", "lang", "word"],
    )


def _phrase_rows(reader: Reader, rows: pa.RecordBatch, k: int, known) -> pa.RecordBatch | None:
    """(key, n, w1, ..., wk): the distinct phrases of k words whose parts may be frequent."""
    _, _, ids, follows = reader.read(rows)
    m = len(ids) - k + 1
    if m <= 0:
        return None
    inside = np.lib.stride_tricks.sliding_window_view(follows, k - 1).all(axis=1)
    part = path_keys([ids[j : m + 1 + j] for j in range(k - 1)])
    seen = known(part)
    at = np.flatnonzero(inside & seen[:-1] & seen[1:])
    if not len(at):
        return None
    keys = path_keys([part[at], ids[at + k - 1]])
    key, head, n = np.unique(keys, return_index=True, return_counts=True)
    first = at[head]
    columns = [key.view(np.int64), n.astype(np.int64), *(ids[first + j].view(np.int64) for j in range(k))]
    return pa.RecordBatch.from_arrays(
        [pa.array(c) for c in columns], names=["key", "n", *(f"w{j + 1}" for j in range(k))]
    )


def prefix_parts(rows: pa.RecordBatch, k: int, parts: int) -> np.ndarray:
    """The prefix partition of each phrase: of all words but the last and bits of the last."""
    ids = [as_uint(rows.column(2 + j)) for j in range(k)]
    if k == 1:
        return (mix(ids[0]) % np.uint64(parts)).astype(np.int64)
    prefix = path_keys(ids[:-1])
    with np.errstate(over="ignore"):
        return (mix(prefix + (ids[-1] >> np.uint64(64 - DIGIT_BITS)) * STEP) % np.uint64(parts)).astype(np.int64)


def sorted_run(held: list[pa.RecordBatch], k: int, parts: int) -> pa.RecordBatch:
    """One block per prefix partition, its phrases sorted by key."""
    rows = pa.concat_batches(held)
    part = prefix_parts(rows, k, parts)
    order = np.lexsort((as_uint(rows.column("key")), part))
    # the key of a path follows from its words
    rows = rows.drop_columns(["key"]).take(pa.array(order))
    names, heads = np.unique(part[order], return_index=True)
    ends = np.append(heads[1:], len(order))
    blocks = []
    for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
        cut = rows.slice(a, b - a)
        packed = [c if j == 0 else c.dictionary_encode() for j, c in enumerate(cut.columns[: k + 1])] + cut.columns[k + 1 :]
        cut = pa.RecordBatch.from_arrays(packed, names=cut.schema.names)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, cut.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(cut)
        blocks.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(names.astype(np.int32)), pa.array(blocks, pa.binary())], names=["part", "block"]
    )


def unpacked(block: bytes, k: int) -> pa.RecordBatch:
    rows = pa.ipc.open_stream(block).read_next_batch()
    columns = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in rows.columns]
    key = path_keys([as_uint(c) for c in columns[1 : k + 1]])
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *columns], names=["key", *rows.schema.names])


def counted(texts: DataFrame, k: int, least: int, before: Filter | None, budget: int, burst: int) -> DataFrame:
    """The frequent phrases of k words.  Words come as (key, n, w1, lang, word), with one row
    per language and partition that has no key but the count of all its words; phrases as
    (key, n, w1..wk, lefts, rights, inside)."""
    spark = texts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = tasks * PARTS_PER_TASK
    known = before.lookup() if before else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, trie = Reader(), BurstTrie(burst)
        for batch in batches:
            for rows in text_pieces(batch):
                found = _word_rows(reader, rows) if k == 1 else _phrase_rows(reader, rows, k, known)
                if found is not None:
                    trie.add(found)
                if trie.size > budget:
                    yield sorted_run(list(trie.spill(budget // 2)), k, parts)
        rest = list(trie.spill(0))
        if rest:
            yield sorted_run(rest, k, parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, Container()
        for batch in batches:
            for name, block in zip(batch.column("part").to_pylist(), batch.column("block"), strict=True):
                if name != part and held.size:
                    yield from _frequent(held, k, least)
                    held = Container()
                part = name
                held.add(unpacked(block.as_py(), k))
        if held.size:
            yield from _frequent(held, k, least)

    ids = ", ".join(f"w{j + 1} bigint" for j in range(k))
    more = "lang string, word binary" if k == 1 else ", ".join(f"{c} array<bigint>" for c in ("lefts", "rights", "inside"))
    return (
        texts.mapInArrow(count, "part int, block binary")
        .repartitionById(tasks, F.expr(f"part % {tasks}"))
        .sortWithinPartitions("part")
        .mapInArrow(merge, f"key bigint, n bigint, {ids}, {more}")
    )


def _frequent(held: Container, k: int, least: int) -> Iterator[pa.RecordBatch]:
    rows = held.merged()
    often = rows.filter(pc.greater_equal(rows.column("n"), least))
    if k == 1:
        sums = pa.TableGroupBy(pa.Table.from_batches([rows]), ["lang"]).aggregate([("n", "sum")])
        none = pa.nulls(len(sums), pa.int64())
        total = pa.RecordBatch.from_arrays(
            [none, sums.column("n_sum").combine_chunks(), none, sums.column("lang").combine_chunks(),
             pa.nulls(len(sums), pa.binary())],
            names=rows.schema.names,
        )
        yield pa.concat_batches([often, total])
    elif often.num_rows:
        ids = [as_uint(often.column(2 + j)) for j in range(k)]
        lefts = [path_keys(ids[:c]) for c in range(1, k)]
        rights = [path_keys(ids[c:]) for c in range(1, k)]
        inside = [path_keys(ids[a : a + m]) for m in range(2, k) for a in range(k - m + 1)]
        lists = [_lists(x, often.num_rows) for x in (lefts, rights, inside)]
        yield pa.RecordBatch.from_arrays([*often.columns, *lists], names=[*often.schema.names, "lefts", "rights", "inside"])


def _lists(columns: list[np.ndarray], n: int) -> pa.Array:
    flat = np.stack(columns, axis=1).reshape(-1) if columns else np.zeros(0, np.uint64)
    where = np.arange(n + 1, dtype=np.int32) * len(columns)
    return pa.ListArray.from_arrays(pa.array(where), pa.array(flat.view(np.int64)))


def mine_phrases(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = LEAST,
    top: int = TOP,
    budget: int = BUDGET,
    burst: int = BURST,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    a, l and r count the phrase and the two parts of its lowest-scoring cut, n all words of
    the language; the score is floor(2000000 * a / (l + r)) in exact decimals.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.col(text_col).cast("string").alias("text"),
    )
    found = stored(counted(texts, 1, least, None, budget, burst))
    words = found.where("key is not null").select("key", "n", "lang", F.decode("word", "UTF-8").alias("word"))
    totals = found.where("key is null").groupBy("lang").agg(F.sum("n").alias("n"))
    counts = words.select("key", "n", "lang")
    frequent, phrases = words, None
    for k in range(2, LONGEST + 1):
        frequent = stored(counted(texts, k, least, Filter(frequent), budget, burst))
        ids = F.array(*(f"w{j + 1}" for j in range(k))).alias("ids")
        level = frequent.select("key", F.col("n").alias("a"), ids, "lefts", "rights", "inside")
        phrases = level if phrases is None else phrases.unionByName(level)
        counts = counts.unionByName(frequent.select("key", "n", F.lit(None).cast("string").alias("lang")))
    return ranked(phrases, counts, words, totals, top)


def ranked(phrases: DataFrame, counts: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Drops covered phrases, scores cuts and ranks what is left."""
    longer = phrases.select(F.explode("inside").alias("key"), "a").groupBy("key").agg(F.max("a").alias("longest"))
    kept = (
        phrases.join(longer, "key", "left")
        .where(f"longest is null or cast(100 as decimal(20,0)) * longest < cast({COVER} as decimal(20,0)) * a")
    )
    cuts = kept.select("key", "a", "ids", F.posexplode(F.arrays_zip("lefts", "rights")).alias("cut", "part"))
    left = counts.select(F.col("key").alias("left"), F.col("n").alias("l"), "lang")
    right = counts.select(F.col("key").alias("right"), F.col("n").alias("r"))
    score = F.expr("cast((2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r) as bigint)")
    best = (
        cuts.select("key", "a", "ids", "cut", F.col("part.lefts").alias("left"), F.col("part.rights").alias("right"))
        .join(left, "left")
        .join(right, "right")
        .groupBy("key")
        .agg(
            F.first("a").alias("a"),
            F.first("ids").alias("ids"),
            F.max("lang").alias("lang"),  # the first part of the first cut is a word
            F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"),
        )
        .select("key", "a", "ids", "lang", "best.score", "best.l", "best.r")
    )
    # ranks with ties first, so that only phrases that may be listed are spelled out; within
    # shares of a language before the whole, so that no task reads all of a language
    order = [F.desc("score"), F.desc("a")]
    shares = Window.partitionBy("lang", F.pmod("key", F.lit(SHARES))).orderBy(*order)
    near = best.withColumn("place", F.rank().over(shares)).where(f"place <= {top}")
    near = near.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order)))
    near = stored(near.where(f"place <= {top}"))
    spelled = (
        near.select("key", F.posexplode("ids").alias("at", "id"))
        .join(words.select(F.col("key").alias("id"), "word"), "id")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
        .select("key", F.concat_ws(" ", F.col("words.word")).alias("phrase"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return (
        near.join(spelled, "key")
        .withColumn("rank", place.cast("long"))
        .where(f"rank <= {top}")
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
