"""Collocations, conversation repair and SimHash against brute force, with edge cases."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.llm import collocations, repair, simhash
from holdfast.llm.queries import QUERIES
from tests.llm.brute import LOWER, WHITE_WORD

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CLASHES = "key n w1 lefts rights inside part block word rank score a l r cut seen said often copies node cell fine comp".split()


def clashing(df):
    taken = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in taken})


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    words = WHITE_WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """(doc_id, fingerprint, component_id) of (doc_id, bits) rows."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
            parent[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, f"{bits:016x}", least.get(find(i))) for i, (doc, bits) in enumerate(rows)]


def bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_simhash_query_equals_brute_force(spark):
    docs = [(r["doc_id"], plain_fingerprint(r["text"])) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert bag(QUERIES["op13_simhash_dedup"](spark, SMALL).collect()) == bag(plain_components(docs))


def test_simhash_edges(spark):
    long = " ".join(random.Random(5).choice("abcdefgh") * 3 for _ in range(150_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "a b c d"), (7, "a b c d"),
        (7, "another text of this id"), (8, "A\tB\nC\x0bD"), (None, "a b c d"), (None, "alone here it is"), (9, "\x00 ä ö Ü"),
        (10, long), (11, long + " "),
    ]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = simhash.simhash_near_duplicates(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert bag(found.collect()) == bag(plain_components([(d, plain_fingerprint(t)) for d, t in rows]))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_near_duplicates(none).count() == 0


def test_fingerprint_does_not_depend_on_pieces():
    text = " ".join(random.Random(6).choice(["Ab", "c", "ddd", "é"]) for _ in range(3000)).encode()
    for most in (1, 7, 100, 1 << 20):
        words = [w for k, p in enumerate(simhash.token_pieces(text, most)) for w in (p[2:] if k else p)]
        assert words == text.lower().split()
        hashes = np.concatenate([simhash.shingle_hashes(p) for p in simhash.token_pieces(text, most)])
        assert hashes.tolist() == simhash.shingle_hashes(text.lower().split()).tolist()


def test_engine_hash_is_the_same(spark):
    row = spark.sql("select xxhash64('a bc é') h").first()
    assert int(simhash.shingle_hashes("a bc é".encode().split())[0]) == row["h"] % (1 << 64)


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2), st.sampled_from([1, 4]))
@settings(max_examples=200, deadline=None)
def test_near_fingerprints_share_a_cell(bits, flips, width):
    other = bits
    for b in flips:
        other ^= 1 << b
    balls = [set(simhash.ball(simhash.embedding(np.array([x], np.uint64), width), width)[0].tolist()) for x in (bits, other)]
    assert balls[0] & balls[1] and len(balls[0]) <= 65


def _dense(seed):
    """Clusters and chains of fingerprints around a few centres."""
    rng = random.Random(seed)
    out = []
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(60):
            for _ in range(rng.choice([0, 1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    centre = rng.getrandbits(64)
    out += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)]
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("hot", [0, 3, 64])
def test_crowded_cells_lose_no_link(spark, hot):
    bits = _dense(hot)
    signed = [(b - (1 << 64) if b >> 63 else b,) for b in bits]
    labels = simhash.linked_classes(spark.createDataFrame(signed, "node long"), hot=hot).collect()
    comp = {r["node"] % (1 << 64): r["comp"] for r in labels}
    groups = defaultdict(set)
    for b in bits:
        groups[comp.get(b, ("alone", b))].add(b)
    expected = defaultdict(set)
    for doc, _, c in plain_components(list(enumerate(bits))):
        expected[c].add(bits[doc])
    assert bag(map(sorted, groups.values())) == bag(map(sorted, expected.values()))


# ------------------------------------------------- conversation structure repair

SPACE = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """Contract by search: (gaps, ..., audit, hash) of the damaged rows of one conversation."""
    key = lambda v: (v is not None, v)
    rows = sorted(rows, key=lambda r: (key(r[0]), r[1].encode(), r[2].encode()))
    kinds, seen = [], set()
    for _, role, text in rows:
        body = text.strip(SPACE)
        kinds.append("blank" if not body else "dup" if (role, text) in seen else "cut" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = {("", ()): (0, "")}  # (initials, repaired) -> (cost, audit), kept by initials' last state
    layer = {0: (0, "", ())}

    def grow(layer):
        """Adds inserts wherever they lead."""
        out = {}
        for s, v in layer.items():
            for k in range(4):
                if s not in out or (v[0], v[1]) < out[s][:2]:
                    out[s] = v
                name, to = ("assistant", 3) if s == 2 else ("user", 2)
                s, v = to, (v[0] + 3, v[1] + "I", (*v[2], name + ":"))
        return out

    del best
    for (_, role, text), kind in zip(rows, kinds):
        after = {}

        def put(state, value):
            if state not in after or value[:2] < after[state][:2]:
                after[state] = value

        for s, (cost, audit, made) in grow(layer).items():
            put(s, (cost + 4, audit + "D", made))
            if kind in ("blank", "dup"):
                continue
            more = 3 if kind == "cut" else 0
            needs, to = ("a", 3) if s == 2 else ("u", 2)
            if role[:1] == needs:
                put(to, (cost + more, audit + "K", (*made, f"{role}:{text}")))
            put(to, (cost + 3 + more, audit + "R", (*made, {"a": "assistant", "u": "user"}[needs] + ":" + text)))
            if s == 0 and role[:1] == "s":
                put(1, (cost + more, audit + "K", (*made, f"{role}:{text}")))
        layer = after
    cost, audit, made = min(v for s, v in grow(layer).items() if s in (0, 3))
    digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
    return (gaps, kinds.count("blank"), kinds.count("dup"), kinds.count("cut"), illegal, cost, audit, digest)


def plain_damage(rows):
    """Rows of (turn, role, text) per conversation, from (conv_id, turn, role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(name.encode()) % 20
        made = [(turn, "user" if fault == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text))]
        out[conv] += made * {0: 0, 3: 2}.get(fault, 1)
    return {conv: plain_repair(made) for conv, made in out.items()}


def test_repair_edges(spark):
    rng = random.Random(9)
    texts = ["Yes.", "no", "", " \n", None, "Why?", "end\t", "a.", "b!"]
    roles = ["user", "assistant", "system", "tool", None, "", "usher", "User"]
    rows = [(c, rng.choice([None, t, t, t + 3]), rng.choice(roles[: 3 + c % 6]), rng.choice(texts)) for c in range(120) for t in range(c % 9)]
    rows += [(None, 0, "user", "x."), (None, 1, "assistant", "y."), (None, 1, "assistant", "y.")]
    rows += [(1000, t, "user", "same.") for t in range(60)] + [(-(2**62) - 1, 2**62 + t, "system", f"s{t}.") for t in range(40)]
    talks = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for spill in (1, 7, 1 << 20):
        found = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_conversations(talks, spill).collect()}
        assert found == plain_damage(rows)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_conversations(none).count() == 0


LINE = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "u"]), st.sampled_from(["a.", "b.", "c", "d!", "", " ", "e"]))


@given(st.lists(LINE, max_size=9), st.sampled_from([1, 2, 100]))
@settings(max_examples=400, deadline=None)
def test_repair_is_the_cheapest_and_least(lines, spill):
    rows = [(t, *line) for t, line in enumerate(lines)]
    talk = repair.Talk(1, spill)
    said = set()
    for turn, role, text in rows:
        talk.read(turn, role, text, (role, text) in said)
        said.add((role, text))
    assert talk.result()[1:] == plain_repair(rows)


def test_giant_conversation_is_read_in_bounded_state():
    talk = repair.Talk(1, 1000)
    for turn in range(30_000):  # two ways to go on stay open throughout
        talk.read(turn, "system", f"{turn}.", False)
    assert talk.pointers.blocks == 30 and len(talk.pointers.block) == 0
    rows = [(t, "system", f"{t}.") for t in range(30_000)]
    assert talk.result()[1:] == plain_repair(rows)


# ------------------------------------------------------------------ collocations


def plain_phrases(rows, least=30, top=2000):
    """Contract rows from (lang, text)."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        covered = set()
        for p, c in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if 100 * c >= 80 * f[p[i : i + m]]:
                        covered.add(p[i : i + m])
        found = []
        for p, a in often.items():
            if p not in covered:
                score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return out


def phrase_rows(seed, n, words=12):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["Ä", "Zz", " ", "x\x00y"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", ";", "\x0b"]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    return rows


@pytest.mark.parametrize(("budget", "burst"), [(1 << 22, 1 << 18), (300, 50)])
def test_phrases_equal_brute_force(spark, budget, burst):
    rows = phrase_rows(1, 400) + [("en", None), ("en", ""), (None, " . ,"), ("fr", "new york " * 40), ("fr", "new york is big. " * 35)]
    docs = clashing(spark.createDataFrame(rows, "lang string, text string"))
    found = collocations.mine_phrases(docs, least=5, top=40, budget=budget, burst=burst)
    assert bag(found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == bag(plain_phrases(rows, 5, 40))


def test_phrases_of_an_empty_table_and_of_rare_words(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine_phrases(none).count() == 0
    few = spark.createDataFrame([("en", "one two three")], "lang string, text string")
    assert collocations.mine_phrases(few).count() == 0


def test_long_text_is_cut_at_piece_ends():
    text = ", ".join("alpha beta gamma" for _ in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "a b"])], names=["lang", "text"])
    parts = list(collocations.text_pieces(batch, 1000))
    assert len(parts) > 20 and "".join(x.column("text")[0].as_py() for x in parts[:-1]) == text
    reader = collocations.Reader()
    pairs = sum(int(reader.read(p)[3].sum()) for p in parts)
    assert pairs == 2 * 2000 + 1


def test_trie_bursts_spills_whole_subtrees_and_keeps_counts():
    rng = np.random.default_rng(3)
    trie, expected, taken = collocations.BurstTrie(burst=64), Counter(), Counter()
    for _ in range(60):
        ids = [collocations.mix(rng.integers(0, 40, 200).astype(np.uint64) + np.uint64(1)) for _ in range(3)]
        key = collocations.path_keys(ids)
        expected.update(key.tolist())
        columns = [key, np.ones(200, np.int64), *ids]
        trie.add(pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["key", "n", "w1", "w2", "w3"]))
        assert trie.size == collocations._size(trie.root)
        if trie.size > 6000:
            for rows in trie.spill(3000):
                taken.update(dict(zip(collocations.as_uint(rows.column("key")).tolist(), rows.column("n").to_pylist())) )
            assert trie.size <= 3000
    assert isinstance(trie.root, list) and any(isinstance(c, list) for c in trie.root)
    for rows in trie.spill(0):
        for key, n in zip(collocations.as_uint(rows.column("key")).tolist(), rows.column("n").to_pylist()):
            taken[key] += n
    assert trie.size == 0 and taken == expected
