"""Near-duplicate documents: an exact Jaccard join on word shingles, size-aware.

A document's set has its distinct 5-word shingles (64-bit hashes).  Two documents link
when their sets' Jaccard similarity is 0.8 or more; components of links are the result.

1. Documents with equal sets form a class; only classes go on, so groups of exact copies
   of any size cost one class.
2. A class that links to another shares at least 0.8 of its own shingles with it.  Tasks
   send each shingle once per batch, those that occur twice in the batch as one mark, in
   compressed blocks dealt by shingle; classes with too few repeated shingles end here.
3. Light classes (few shingles) enumerate subsets of fixed size: for classes of sizes a
   and b, every subset with as many shingles as a link between them needs.  Classes that
   share such a subset link without a further check, so a star of edges joins each group.
4. Heavy classes are found in inverted lists of the shingles in their prefixes, rarest
   shingle first; two linked classes share a prefix shingle, and of lists with the same
   members one is kept.  A list is scanned with parity bitmaps, whose differing bits are
   a lower bound of the shingles that differ, so no link is missed; it hands on a forest
   at first and ``PAIRS_PER_MEMBER`` pairs a member later, never all pairs.  They are
   checked on the whole sets; lists are scanned again, without the pairs that failed and
   across components only, until nothing is left to check.  Lists of more than
   ``BLOCK`` members are scanned block against block, each in a task of its own.
5. The boundary between light and heavy minimises the estimated cost of both sides, from
   the counts of small sizes and the mean length of the lists.
6. Where links are asked for, the classes of each component meet again, block against
   block, and each pair's shared shingles are counted; a document's links are the copies
   of its own class and of the classes that link to it.

Defined results: null, empty and white texts have no set, link with nothing and are their
own component; texts of one to four words have one shingle, all their words; equal sets
link, whatever their texts; a component's id is its smallest document id (rows without an
id take part, and get a null id only if no row of their component has one); repeated rows
are repeated in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, pairwise
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import bounded_batches, slot_filter, stored, with_slot_flag
from holdfast.llm.words import WHITE, Powers, RunHash, find_words, mix, separators, slices, word_hashes

SHINGLE = 5
SLICE_BYTES = 1 << 18
FLUSH_SHINGLES, DEAL_SHINGLES = 600_000, 2_000_000
SHORT_BYTES = 5  # of a shingle's hash that travel; the deal is taken from the others
MOST_LIGHT = 16  # largest size for which subsets may be enumerated
BLOCK, BITMAP_WORDS, PAIRS_PER_MEMBER = 4096, 32, 8
LINK_BLOCK, LINK_SHINGLES = 1024, 500_000  # classes and shingles of a block when links are counted


def needed(a: int, b: int) -> int:
    """Shared shingles that sets of a and b shingles need for 100 * shared >= 80 * union."""
    return -(-4 * (a + b) // 9)


def prefix(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def _sets(batch: pa.RecordBatch, breaks: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending, end to end; and each row's bounds."""
    words = find_words(batch.column("text"), breaks, lower=True)
    runs = RunHash(word_hashes(words, powers), powers)
    count = np.diff(words.first)
    row = np.repeat(np.arange(len(count)), count)
    total = len(row)
    start = np.flatnonzero(row[: max(0, total - SHINGLE + 1)] == row[SHINGLE - 1 :])
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    owner = np.concatenate([row[start], few])
    shingles = np.concatenate([runs.of(start, start + SHINGLE), runs.of(words.first[few], words.first[few + 1])])
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    lead = np.ones(len(owner), bool)
    lead[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    owner = owner[lead]
    return shingles[lead], np.searchsorted(owner, np.arange(len(count) + 1))


def _signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set."""
    with np.errstate(over="ignore"):
        out = np.zeros((len(bounds) - 1, 2), np.uint64)
        for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            sums = np.zeros(len(shingles) + 1, np.uint64)
            np.cumsum(mix(shingles ^ np.uint64(salt)), dtype=np.uint64, out=sums[1:])
            out[:, k] = sums[bounds[1:]] - sums[bounds[:-1]]
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node, check): set size and the two halves of the set's signature.

    Classes are told apart by both; ``node`` alone names a class in the steps between.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaks, powers = separators(WHITE), Powers()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                shingles, bounds = _sets(batch, breaks, powers)
                marks = _signatures(shingles, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(np.ascontiguousarray(marks[:, 0]).view(np.int64)),
                        pa.array(np.ascontiguousarray(marks[:, 1]).view(np.int64)),
                    ],
                    names=["doc_id", "n", "node", "check"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, node bigint, check bigint")


def repeated_counts(docs: DataFrame, deals: int) -> DataFrame:
    """(node, repeats): at least the shingles of a class that occur in another class
    (copies of a class may add to it), for the classes that have any.

    The counts of each deal are packed again, dealt by class, and added up there.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaks, powers = separators(WHITE), Powers()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = turn = 0
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                shingles, bounds = _sets(batch, breaks, powers)
                held.append((shingles, np.diff(bounds), _signatures(shingles, bounds)[:, 0]))
                size += len(shingles)
                if size >= FLUSH_SHINGLES:
                    yield _flush(held, deals, turn)
                    held, size, turn = [], 0, turn + 1
        if size:
            yield _flush(held, deals, turn)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(b.as_buffer()) for batch in batches for b in batch.column("block")]
        if not parts:
            return
        shingle = np.concatenate([p[0] for p in parts])
        owner = np.concatenate([p[1] for p in parts])
        order = np.lexsort((owner, shingle))
        shingle, owner = shingle[order], owner[order]
        lead = np.ones(len(order), bool)
        lead[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
        shingle, owner = shingle[lead], owner[lead]
        again = np.zeros(len(shingle), bool)
        same = shingle[1:] == shingle[:-1]
        again[1:] |= same
        again[:-1] |= same
        again &= owner != 0
        found, count = np.unique(owner[again], return_counts=True)
        names, counts = _added([(found, count), *((p[2], p[3]) for p in parts)])
        if not len(names):
            return
        deal = (names % np.uint64(deals)).astype(np.int64)
        order = np.argsort(deal, kind="stable")
        to, heads = np.unique(deal[order], return_index=True)
        ends = np.append(heads[1:], len(order))
        blocks = [
            names[order[a:b]].tobytes() + counts[order[a:b]].astype(np.uint32).tobytes()
            for a, b in zip(heads.tolist(), ends.tolist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(to.astype(np.int32)), pa.array(blocks, pa.binary())], names=["deal", "block"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for block in batch.column("block").to_pylist():
                n = len(block) // 12
                parts.append((np.frombuffer(block, np.uint64, n), np.frombuffer(block, np.uint32, n, 8 * n)))
        if parts:
            names, counts = _added(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.view(np.int64)), pa.array(counts)], names=["node", "repeats"]
            )

    packed = "deal int, block binary"
    met = docs.mapInArrow(cut, packed).repartitionById(deals, F.col("deal")).mapInArrow(meet, packed)
    return met.repartitionById(deals, F.col("deal")).mapInArrow(add, "node bigint, repeats bigint")


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names and the sums of their counts."""
    names, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([p[1] for p in parts]), len(names))
    return names, counts.astype(np.int64)


def _flush(held: list, deals: int, turn: int) -> pa.RecordBatch:
    """Blocks of one batch of documents, one per deal.

    A block has the classes it names, the number of shingles of each (first those that
    several classes of the batch have, which name no class), and the shingles; one block
    also has what the batch knows by itself: repeated shingles per class.
    """
    shingle = np.concatenate([h[0] for h in held])
    sizes = np.concatenate([h[1] for h in held])
    short = np.concatenate([h[2] for h in held])
    _, first = np.unique(short, return_index=True)
    fresh_set = np.zeros(len(short), bool)
    fresh_set[first] = True
    owner = np.repeat(np.arange(1, len(short) + 1), sizes)
    keep = fresh_set[owner - 1]
    shingle, owner = shingle[keep], owner[keep]
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    lead = np.ones(len(order), bool)
    lead[1:] = shingle[1:] != shingle[:-1]
    group = np.cumsum(lead) - 1
    several = np.bincount(group) > 1
    local = np.bincount(owner[several[group]], minlength=len(short) + 1)
    shingle, owner = shingle[lead], np.where(several, 0, owner[lead])
    short = np.concatenate([np.zeros(1, np.uint64), short])

    low = np.uint64(8 * SHORT_BYTES)
    deal = ((shingle >> low) % np.uint64(deals)).astype(np.int64)
    order = np.lexsort((owner, deal))
    shingle, owner, deal = shingle[order], owner[order], deal[order]
    names, heads = np.unique(deal, return_index=True)
    ends = np.append(heads[1:], len(deal))
    codec = pa.Codec("zstd", compression_level=1)
    blocks = []
    for k, (a, b) in enumerate(zip(heads.tolist(), ends.tolist(), strict=True)):
        who, counts = np.unique(owner[a:b], return_counts=True)
        known = np.flatnonzero(local) if k == turn % len(names) else np.zeros(0, np.int64)
        tail = np.ascontiguousarray(shingle[a:b]).view(np.uint8).reshape(-1, 8)[:, :SHORT_BYTES]
        body = b"".join(
            (
                np.array([len(who), b - a, len(known)], np.uint32).tobytes(),
                short[who].tobytes(),
                counts.astype(np.uint32).tobytes(),
                short[known].tobytes(),
                local[known].astype(np.uint32).tobytes(),
                tail.tobytes(),
            )
        )
        blocks.append(np.uint32(len(body)).tobytes() + codec.compress(body, asbytes=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(names.astype(np.int32)), pa.array(blocks, pa.binary())], names=["deal", "block"]
    )


def _unpack(block: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = memoryview(block)
    size = int(np.frombuffer(raw[:4], np.uint32)[0])
    body = memoryview(pa.Codec("zstd").decompress(raw[4:], decompressed_size=size))
    k, m, known = np.frombuffer(body[:12], np.uint32).tolist()
    at = 12

    def take(n: int, kind: type) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body[at : at + n * np.dtype(kind).itemsize], kind)
        at += n * np.dtype(kind).itemsize
        return out

    who, counts = take(k, np.uint64), take(k, np.uint32)
    names, local = take(known, np.uint64), take(known, np.uint32)
    wide = np.zeros((m, 8), np.uint8)
    wide[:, :SHORT_BYTES] = np.frombuffer(body[at:], np.uint8).reshape(m, SHORT_BYTES)
    return wide.view(np.uint64).ravel(), np.repeat(who, counts), names, local


def _bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each bit."""
    bits = np.bincount((mix(shingles) % np.uint64(64 * BITMAP_WORDS)).astype(np.int64), minlength=64 * BITMAP_WORDS)
    return np.packbits((bits & 1).astype(bool)).tobytes()


def class_sets(docs: DataFrame, survivors: DataFrame) -> DataFrame:
    """(node, n, shingles, bitmap) of the surviving classes, from their first documents' texts."""
    flags = stored(slot_filter(survivors, ["first_id"]))
    probed = with_slot_flag(docs, flags, ["doc_id"], "is_first").where("is_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaks, powers = separators(WHITE), Powers()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                shingles, bounds = _sets(batch, breaks, powers)
                marks = _signatures(shingles, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ascontiguousarray(marks[:, 0]).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(shingles.view(np.int64))),
                        pa.array([_bitmap(shingles[a:b]) for a, b in pairwise(bounds)], pa.binary()),
                    ],
                    names=["node", "shingles", "bitmap"],
                )

    found = probed.select("text").mapInArrow(run, "node bigint, shingles array<bigint>, bitmap binary")
    return found.join(survivors.select("node", "n"), "node").dropDuplicates(["node"])


def light_edges(sets: DataFrame, boundary: int) -> DataFrame:
    """Star edges (a, b) of the groups of light classes that share a fixed-size subset."""

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << 64) - 1
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.to_pylist():
                values = mix(np.array(row["shingles"], np.int64).view(np.uint64)).tolist()
                n, total = len(values), sum(values)
                for other in range(-(-4 * n // 5), min(5 * n // 4, boundary - 1) + 1):
                    small, large = min(n, other), max(n, other)
                    for gone in combinations(values, n - needed(n, other)):
                        rows.append(((total - sum(gone)) & mask, small, large, row["node"], n))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64)),
                    *(pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2)),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([r[4] for r in rows], pa.int32()),
                ],
                names=["subset", "small", "large", "node", "n"],
            )

    key = ["subset", "small", "large"]
    light = sets.where(F.col("n") < boundary).select("node", "shingles")
    rows = stored(light.mapInArrow(subsets, "subset bigint, small int, large int, node bigint, n int"))
    groups = (
        rows.groupBy(*key)
        .agg(
            F.min("node").alias("hub"),
            F.max("node").alias("last"),
            F.min("n").alias("least"),
            F.max("n").alias("most"),
        )
        .where("hub < last and least = small and most = large")
    )
    return (
        rows.join(groups, key)
        .where("node <> hub")
        .select(F.col("hub").alias("a"), F.col("node").alias("b"))
        .distinct()
    )


def prefix_lists(sets: DataFrame) -> DataFrame:
    """(shingle, node, n): prefix shingles that two or more classes have, rarest first."""
    rows = sets.select("node", "n", F.explode("shingles").alias("shingle"))
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by_node = (
        rows.join(shared, "shingle")
        .groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("found"))
    )
    # shingles of one class only come first in the order and take up prefix places
    places = F.expr("n - ceil(4 * n / 5) + 1 - (n - size(found))").cast("int")
    return by_node.where(places > 0).select(
        F.explode(F.slice("found", F.lit(1), places)).alias("f"), "node", "n"
    ).select("f.shingle", "node", "n")


def choose_boundary(sets: DataFrame, lists: DataFrame) -> int:
    """The least size whose classes are heavy, by the estimated rows of both ways."""
    sizes = {r["n"]: r["count"] for r in sets.where(F.col("n") <= MOST_LIGHT).groupBy("n").count().collect()}
    total = lists.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("shingle").alias("lists")).first()
    mean = total["rows"] / max(1, total["lists"])

    def light(n: int) -> int:
        return sum(comb(n, needed(n, m)) for m in range(-(-4 * n // 5), 5 * n // 4 + 1))

    best, chosen, cost = None, 1, 0.0
    for boundary in range(1, MOST_LIGHT + 2):
        rest = sum(c * prefix(n) * (1 + mean) for n, c in sizes.items() if n >= boundary)
        if best is None or cost + rest < best:
            best, chosen = cost + rest, boundary
        cost += sizes.get(boundary, 0) * light(boundary)
    return chosen


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that edges reach, for nodes that have edges.

    Each step takes the smallest label among neighbours and then the label of that label.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")))
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("comp").alias("near"))
        )
        lower = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")
        )
        lower = stored(lower)
        jump = lower.select(F.col("node").alias("via"), F.col("comp").alias("further"))
        moved = lower.join(jump, lower["comp"] == jump["via"], "left").select(
            "node", F.least("comp", "further").alias("comp"), "old"
        )
        moved = stored(moved)
        labels = moved.select("node", "comp")
        if moved.where("comp <> old").isEmpty():
            return labels


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(9 * F.size(F.array_intersect("s_a", "s_b")) >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def scanned_lists(sets: DataFrame, lists: DataFrame, boundary: int) -> DataFrame:
    """(shingle, lo, hi, node, n, bitmap): the members of each list to scan, by pair of blocks."""
    lists = lists.where(F.col("n") >= -(-4 * boundary // 5))
    members = lists.groupBy("shingle").agg(
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"),
        F.count(F.lit(1)).alias("m"),
        F.max("n").alias("largest"),
    )
    kept = (
        members.where(f"m > 1 and largest >= {boundary}")
        .groupBy("members", "m")
        .agg(F.min("shingle").alias("shingle"))
        .select("shingle", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    )
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least(x, mine).alias("lo"), F.greatest(x, mine).alias("hi")),
    )
    rows = lists.join(kept, "shingle").join(sets.select("node", "bitmap"), "node")
    return rows.select("shingle", F.explode(meets).alias("at"), "node", "n", "bitmap").select(
        "shingle", "at.lo", "at.hi", "node", "n", "bitmap"
    )


def forest(
    nodes: np.ndarray,
    sizes: np.ndarray,
    bitmaps: np.ndarray,
    comps: np.ndarray,
    failed: list,
    boundary: int,
    most: int = 1,
) -> list[tuple[int, int]]:
    """Pairs of one list that may link across components.

    With ``most`` 1, a forest that joins all that may link; with more, circles too, until
    there are ``most`` pairs for each member.
    """
    place = {int(v): k for k, v in enumerate(nodes)}
    _, group = np.unique(comps, return_inverse=True)
    group = group.astype(np.int64)
    out = []
    for i in range(len(nodes) - 1):
        js = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        small, large = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
        js = js[(5 * small >= 4 * large) & (large >= boundary)]
        both = sizes[js] + sizes[i]
        differ = np.bitwise_count(bitmaps[js] ^ bitmaps[i]).sum(axis=1, dtype=np.int64)
        js = js[differ <= both - 2 * (-(-4 * both // 9))]
        known = {place.get(v) for v in failed[i] or ()}
        for j in js.tolist():
            if j not in known and group[j] != group[i] and nodes[i] != nodes[j]:
                out.append((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))))
                if most == 1:
                    group[group == group[j]] = group[i]
                elif len(out) >= most * len(nodes):
                    return out
    return out


def heavy_edges(sets: DataFrame, lists: DataFrame, edges: DataFrame, boundary: int) -> DataFrame:
    """Adds the edges that the lists give, until no list has a pair left to check."""
    members = stored(scanned_lists(sets, lists, boundary))
    key = ["shingle", "lo", "hi"]
    failed = None

    def scan(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in pairwise(cuts):
                if held and names[a] != last:
                    yield _edges(held, boundary, most)
                    held = []
                held.append(batch.slice(a, b - a))
                last = names[a]
        if held:
            yield _edges(held, boundary, most)

    while True:
        rows = members.join(components(edges), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        if failed is None:
            rows = rows.withColumn("failed", F.lit(None).cast("array<bigint>"))
        else:
            both = failed.unionByName(failed.select(F.col("b").alias("a"), F.col("a").alias("b")))
            of_node = both.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("failed"))
            rows = rows.join(of_node, "node", "left")
        # a forest first; what is left then mostly fails, so it is checked several at a time
        most = 1 if failed is None else PAIRS_PER_MEMBER
        pairs = stored(
            rows.select(*key, "node", "n", "bitmap", "comp", "failed")
            .repartition(*key)
            .sortWithinPartitions(*key, "node")
            .mapInArrow(partial(scan, most=most), "a bigint, b bigint")
            .distinct()
        )
        if pairs.isEmpty():
            return edges
        good = stored(_verified(pairs, sets))
        bad = pairs.join(good, ["a", "b"], "left_anti")
        failed = stored(bad if failed is None else failed.unionByName(bad))
        edges = stored(edges.unionByName(good))


def _edges(held: list[pa.RecordBatch], boundary: int, most: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    column = lambda name: rows.column(name).to_numpy()
    bitmaps = np.frombuffer(b"".join(rows.column("bitmap").to_pylist()), np.uint64).reshape(-1, BITMAP_WORDS)
    found = forest(
        column("node"), column("n"), bitmaps, column("comp"), rows.column("failed").to_pylist(), boundary, most
    )
    return pa.RecordBatch.from_arrays(
        [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"]
    )


def class_links(sets: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, n_links): documents in the other classes that each class links to.

    All links of a class lie inside its component, so the classes of a component meet once,
    those of large components block against block, and the shared shingles of every pair
    are counted.  Only sums per class leave a task.  ``sizes`` has (node, copies).
    """
    members = stored(
        sets.select("node", "n", "shingles").join(labels, "node").join(sizes, "node")
    )
    blocks = members.groupBy("comp").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / LINK_BLOCK), F.ceil(F.sum("n") / LINK_SHINGLES)).cast("int").alias("blocks")
    )
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least(x, mine).alias("lo"), F.greatest(x, mine).alias("hi")),
    )
    key = ["comp", "lo", "hi"]
    rows = members.join(blocks, "comp").withColumn("mine", mine).select(
        "comp", F.explode(meets).alias("at"), "mine", "node", "n", "copies", "shingles"
    ).select("comp", "at.lo", "at.hi", "mine", "node", "n", "copies", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in pairwise(cuts):
                if held and names[a] != last:
                    yield _links(held, last)
                    held = []
                held.append(batch.slice(a, b - a))
                last = names[a]
        if held:
            yield _links(held, last)

    found = (
        rows.repartition(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(run, "node bigint, n_links bigint")
    )
    return found.groupBy("node").agg(F.sum("n_links").alias("n_links"))


def _links(held: list[pa.RecordBatch], at: tuple) -> pa.RecordBatch:
    """Links between two blocks, or inside one: linked documents per class."""
    rows = pa.Table.from_batches(held).combine_chunks()
    column = lambda name: rows.column(name).to_numpy()
    nodes, n, copies, mine = column("node"), column("n"), column("copies"), column("mine")
    sets = rows.column("shingles").combine_chunks()
    if isinstance(sets, pa.ChunkedArray):
        sets = pa.concat_arrays(sets.chunks)
    total = linked(sets.flatten().to_numpy().view(np.uint64), n, copies, mine if at[1] != at[2] else None)
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(total)], names=["node", "n_links"])


def linked(shingles: np.ndarray, n: np.ndarray, copies: np.ndarray, sides: np.ndarray | None = None) -> np.ndarray:
    """Of each set (distinct shingles, end to end, n of each), the copies of the sets that it
    links to; with ``sides``, of sets of the other side only."""
    owner = np.repeat(np.arange(len(n)), n)
    values, of = np.unique(shingles, return_inverse=True)
    order = np.argsort(of, kind="stable")
    posting = owner[order]
    heads = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(values)))])
    ends = np.concatenate([[0], np.cumsum(n)])
    total = np.zeros(len(n), np.int64)
    for i in range(len(n)):
        mine = of[ends[i] : ends[i + 1]]
        sizes = heads[mine + 1] - heads[mine]
        shift = np.cumsum(sizes) - sizes
        places = np.arange(sizes.sum()) + np.repeat(heads[mine] - shift, sizes)
        shared = np.bincount(posting[places], minlength=len(n))
        links = 9 * shared >= 4 * (n + n[i])
        links[i] = False
        if sides is not None:
            links &= sides != sides[i]
        total[i] = copies[links].sum()
    return total


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), one row per row of the table: also the
    other rows whose sets have a Jaccard similarity of 0.8 or more with the row's set."""
    return _found(docs, id_col, text_col, links=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of the table."""
    return _found(docs, id_col, text_col, links=False)


def _found(docs: DataFrame, id_col: str, text_col: str, links: bool) -> DataFrame:
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = stored(signatures(texts))
    classes = stored(
        named.where("n > 0")
        .groupBy("node", "check", "n")
        .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    )
    total = named.agg(F.sum("n")).first()[0] or 0
    spark = docs.sparkSession
    deals = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // DEAL_SHINGLES))
    counts = repeated_counts(texts, deals)
    survivors = stored(classes.join(counts, "node").where("5 * repeats >= 4 * n").select("node", "n", "first_id"))
    sets = stored(class_sets(texts, survivors))
    lists = stored(prefix_lists(sets))
    boundary = choose_boundary(sets, lists)
    edges = stored(light_edges(sets, boundary))
    edges = heavy_edges(sets, lists, edges, boundary)
    labels = components(edges)
    linked = classes.join(labels, "node")
    smallest = linked.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_class = classes.select("node", "first_id").join(
        linked.select("node", "comp").join(smallest, "comp").select("node", "component_id"), "node", "left"
    ).select("node", F.coalesce("component_id", "first_id").alias("class_component"))
    alone = named.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    names = ["doc_id", F.col("n").alias("n_shingles"), F.col("class_component").alias("component_id")]
    if links:
        found = class_links(sets, labels, classes.select("node", "copies"))
        of_class = of_class.join(classes.select("node", "copies"), "node").join(found, "node", "left").select(
            "node", "class_component", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links")
        )
        alone, names = alone.withColumn("n_links", F.lit(0).cast("long")), [*names, "n_links"]
    rest = named.where("n > 0").join(stored(of_class), "node", "left").select(*names)
    return rest.unionByName(alone)
