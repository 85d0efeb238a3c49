"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import io
import random
import time
import zipfile
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.llm import chat, decontaminate, exact_dedup, html, jaccard, quality, substring_dedup, toxicity, warc
from holdfast.llm import sentencepiece as pieces
from holdfast.llm import words as w
from holdfast.llm.common import stored, without_ids
from tests.llm import brute

DOCS = "doc_id long, text string"
CLASHES = (
    "n_words n_hit items hits score offending keep_id kept group_size ids round_trip decoded n_tokens "
    "text_hash word bits slot_word slot_bits may_go lost_id node label id full_hash text_bytes head_hash "
    "may_repeat first_id stats page host shard"
).split()
random.seed(11)
VOCABULARY = [f"w{k}" for k in range(400)]
LONG = " ".join(random.choice(VOCABULARY) for _ in range(60_000))


def sentence(n: int, seed: int) -> str:
    return " ".join(random.Random(seed).choice(VOCABULARY) for _ in range(n))


def edited(text: str, *places: int) -> str:
    parts = text.split(" ")
    for p in places:
        parts[p] = f"x{p}"
    return " ".join(parts)


BASE, OTHER = sentence(120, 1), sentence(90, 2)
ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one two"),
    (5, "One  TWO"),
    (6, BASE),
    (7, BASE),
    (8, edited(BASE, 60)),
    (9, edited(BASE, 3, 117)),
    (10, OTHER),
    (10, OTHER),
    (11, OTHER + " " + sentence(30, 3)),
    (None, BASE),
    (None, "lone"),
    (12, LONG),
    (13, edited(LONG, 100, 30_000)),
    (14, "a b c d e"),
    (15, "a b c d f"),
    (16, "ä ö ü ﬀ 日本 ▁   x"),
    (17, " ".join(OTHER.split()[20:60])),
    (18, "  spaces   and▁marks  "),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def bag(rows) -> list:
    return sorted((tuple(r) for r in rows), key=repr)


def test_exact_dedup(docs, none):
    found = exact_dedup.exact_dedup(docs, carry=("text",)).collect()
    assert len(found) == len(ROWS)
    for r in found:
        same = [d for d, t in ROWS if (t or "") == (r["text"] or "")]
        ids = [d for d in same if d is not None]
        assert r["group_size"] == len(same)
        if len(same) > 1:
            assert r["keep_id"] == max(ids)
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["keep_id"])
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(x for x in ids if x) == [2, 3, 4, 5, 7, 8, 9, 10, 10, *range(11, 19)] and ids.count(None) == 2
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.drop_exact_copies(none).count() == 0


def test_exact_dedup_refines_equal_prefixes(spark):
    """Same length and same first characters, different ends."""
    head = "h" * 300
    rows = [(1, head + "a"), (2, head + "b"), (3, head + "a")]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert bag(found) == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)]


def test_without_ids(spark, docs):
    lost = spark.createDataFrame([(7,), (10,), (7,), (None,)], "doc_id long")
    ids = [r["doc_id"] for r in without_ids(docs, lost).collect()]
    assert sorted(x for x in ids if x) == [1, 2, 3, 4, 5, 6, 8, 9, *range(11, 19)] and ids.count(None) == 2


def test_near_duplicates(docs, none):
    found = jaccard.near_duplicates(docs).collect()
    assert bag(found) == bag(brute.near(ROWS))
    assert jaccard.near_duplicates(none).count() == 0


@pytest.mark.parametrize("boundary", [1, 8, 17])
def test_near_duplicates_with_any_boundary(spark, monkeypatch, boundary):
    """Small sets in chains of edits; the same components whichever side finds them."""
    monkeypatch.setattr(jaccard, "choose_boundary", lambda sets, lists: boundary)
    dice, rows = random.Random(boundary), []
    for k in range(160):
        if rows and dice.random() < 0.7:
            parts = dice.choice(rows)[1].split()
            for _ in range(dice.randint(0, 2)):
                at = dice.randrange(len(parts))
                dice.choice([lambda: parts.insert(at, "z"), lambda: parts.append(dice.choice("pq")), lambda: None])()
        else:
            parts = [dice.choice("abcdefghijkl") for _ in range(dice.randint(1, 26))]
        rows.append((k, " ".join(parts)))
    found = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert bag(found) == bag(brute.near(rows))


def test_a_large_group_of_near_copies_is_one_component(spark):
    """Every copy has its own edit, so no two sets are equal and lists are long."""
    rows = [(k, edited(BASE, k % 120, (7 * k) % 120) + (" end" if k % 2 else "")) for k in range(300)]
    rows += [(1000 + k, sentence(100, 50 + k) + " " + " ".join(BASE.split()[:20])) for k in range(40)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert bag(found) == bag(brute.near(rows))


def test_long_lists_are_scanned_block_against_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "choose_boundary", lambda sets, lists: 1)
    rows = [(k, edited(BASE, (11 * k) % 120)) for k in range(30)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert bag(found) == bag(brute.near(rows))


@pytest.mark.parametrize("block", [4, 1024])
def test_link_counts_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "LINK_BLOCK", block)
    rows = [*ROWS, *((100 + k, edited(LONG[:900], k % 60, (7 * k) % 110)) for k in range(40))]
    rows += [(200 + k, " ".join(f"c{j}" for j in range(k, k + 40))) for k in range(30)]
    rows += [(300 + k, " ".join("abcdefghij"[: 5 + k % 6])) for k in range(12)]
    sets = [brute.shingles(t) for _, t in rows]

    def links(i: int) -> int:
        one = sets[i]
        return sum(100 * len(one & s) >= 80 * len(one | s) for j, s in enumerate(sets) if j != i and one and s)

    want = [(*found, links(i)) for i, found in enumerate(brute.near(rows))]
    found = jaccard.link_counts(spark.createDataFrame(rows, DOCS)).collect()
    assert bag(found) == bag(want) and max(r["n_links"] for r in found) > 4


def test_a_forest_has_no_circles_and_skips_what_failed():
    sets = [np.arange(100, dtype=np.uint64), np.arange(2, 102, dtype=np.uint64), np.arange(4, 104, dtype=np.uint64)]
    bitmaps = np.frombuffer(b"".join(jaccard._bitmap(s) for s in sets), np.uint64).reshape(3, -1)
    nodes, sizes = np.array([7, 8, 9]), np.array([100, 100, 100])
    assert len(jaccard.forest(nodes, sizes, bitmaps, nodes, [None] * 3, 1)) == 2
    assert jaccard.forest(nodes, sizes, bitmaps, nodes, [[8, 9], [7, 9], [7, 8]], 1) == []
    assert jaccard.forest(nodes, sizes, bitmaps, np.array([1, 1, 1]), [None] * 3, 1) == []
    assert jaccard.forest(nodes, sizes, bitmaps, nodes, [None] * 3, 101) == []


def test_substring_dedup(docs, none):
    found = substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert bag(found) == bag(brute.passages(ROWS))
    digests = substring_dedup.substring_dedup(docs).select("kept_text", "kept_sha256").collect()
    assert all(hashlib.sha256(t.encode()).hexdigest() == d for t, d in digests)
    assert substring_dedup.substring_dedup(none).count() == 0


def test_substring_dedup_over_many_batches_of_one_bucket(spark):
    """One passage in many documents, white space varied: the bucket spans Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, f"{sentence(k % 9, k)} {BASE.replace(' ', ' ' * (1 + k % 3))} t{k}") for k in range(60)]
        found = substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS))
        assert bag(found.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == bag(brute.passages(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


ITEMS = [(1, " ".join(OTHER.split()[10:40])), (2, "One-TWO"), (3, None), (4, "!?"), (5, "one two"), (None, "a b c")]


@pytest.mark.parametrize("block_chars", [4_000_000, 300])
def test_decontamination(spark, docs, none, block_chars):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    narrow = docs.select("doc_id", "text")
    found = decontaminate.find_contamination(narrow, bench, block_chars=block_chars).collect()
    mine = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found]
    assert bag(mine) == bag(brute.contamination(ROWS, ITEMS))
    for r in found:
        covered = 0
        for hit in r["hits"]:
            piece = r["text"][hit["start"] : hit["end"]].translate(brute.LOWER)
            n = hit["last_word"] - hit["first_word"] + 1
            assert len(brute.PLAIN_WORD.findall(piece)) == n
            covered += n
        assert covered == r["n_hit"]
    kept = decontaminate.drop_contaminated(docs, bench, block_chars=block_chars)
    assert kept.columns == docs.columns
    want = [d for d, n, hit, _ in brute.contamination(ROWS, ITEMS) if not (hit and 20 * hit >= n)]
    assert bag([(r["doc_id"],) for r in kept.collect()]) == bag([(d,) for d in want])
    assert decontaminate.find_contamination(none, bench).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, empty).where("array_size(items_) > 0").count() == 0


def test_toxicity(spark, docs, none):
    model = toxicity.train(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["s"] for r in toxicity.score(docs, model).select(F.max("score_").alias("s")).collect()][0] < 0.7
    bad = [(k, f"{sentence(20, k)}. You are a blorgh{k % 7}! {sentence(20, 99 + k)}") for k in range(100, 160)]
    fine = [(k, f"{sentence(20, k)}. {sentence(20, 99 + k)}.") for k in range(200, 320)]
    labels = [(k, 1) for k, _ in bad] + [(k, 0) for k, _ in fine] + [(5, None), (777, 1)]
    texts = spark.createDataFrame(bad + fine, DOCS).unionByName(docs.select("doc_id", "text"))
    model = toxicity.train(texts, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = {r["doc_id"]: r for r in toxicity.score(texts, model).collect()}
    assert all(rows[k]["score"] >= 0.7 for k, _ in bad) and all(rows[k]["score"] < 0.3 for k, _ in fine)
    for k, text in bad:
        spots = [text[o["start"] :] for o in rows[k]["offending"]]
        assert any(s.startswith("You are a blorgh") for s in spots)
    assert rows[1]["score"] == rows[2]["score"] == 0 and rows[12]["score"] < 0.7
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert toxicity.score(none, model).count() == 0


def test_toxicity_of_long_clean_texts(spark):
    """Neither plain nor weakly positive sentences make a text toxic by their number."""
    weak = [f"weak{'abcdefghijklmnop'[k]}" for k in range(16)]
    _, found, _, _ = toxicity._features(pa.array([" ".join([*weak, "vile"])]))
    features, weights = found[:17], np.array([1.5] * 16 + [12.0])
    order = np.argsort(features)
    bias = float(np.log(toxicity.LEAK / (1 - toxicity.LEAK)))
    model = toxicity.Model(features[order], weights[order], bias)
    dice = random.Random(5)
    plain = [f"line{k} is fine" for k in range(50_000)]
    weakly = [f"line{k} {dice.choice(weak)} {dice.choice(weak)}" for k in range(50_000)]
    rows = [(1, "\n".join(plain)), (2, "\n".join(weakly)), (3, "\n".join([*weakly, "so vile!", *plain]))]
    score = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, DOCS), model).collect()}
    assert score[1] < 0.1 and score[2] < 0.1 and score[3] >= 0.7


def test_toxicity_sample_has_long_texts(spark):
    rows = [(k, "word " * (4000 if k % 10 == 0 else 20)) for k in range(40)]
    texts = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(99, 1)], "doc_id long, toxic int")
    found = toxicity.labelled_sample(
        texts, labels, "doc_id", "text", "toxic", toxicity.SAMPLE_ROWS, toxicity.SAMPLE_CHARS
    ).collect()
    assert sorted((r["label"], r["text"]) for r in found) == sorted((k % 2, t) for k, t in rows)
    few = toxicity.labelled_sample(texts, labels, "doc_id", "text", "toxic", 2500, 50_000).collect()
    for y in (0, 1):
        assert 0 < sum(len(r["text"]) for r in few if r["label"] == y) <= 50_000


def test_quality(spark, docs, none):
    rows = [(k, sentence(60, k) if k % 2 else (sentence(6, k) + "!! ").upper() * 10) for k in range(100, 400)]
    labels = [(k, k % 2) for k, _ in rows] + [(2, None)]
    frame = spark.createDataFrame(rows, DOCS)
    stats = stored(quality.with_statistics(frame.unionByName(docs.select("doc_id", "text")), "doc_id", "text"))
    model = quality.fit(stats, spark.createDataFrame(labels, "doc_id long, quality int"))
    scores = {r["doc_id"]: r["score"] for r in quality.score(stats, model).collect()}
    assert np.mean([(scores[k] >= 0.5) == (k % 2 == 1) for k, _ in rows]) > 0.97
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1] == scores[2]
    nothing = quality.fit(stats, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(stats, nothing).collect()} == {0.5}
    assert quality.with_statistics(none, "doc_id", "text").count() == 0


def test_isotonic_levels_ascend():
    at, levels = quality.pool_adjacent(np.arange(5.0), np.array([1, 1, 1, 1, 1.0]), np.array([0, 1, 0, 1, 1.0]))
    assert levels.tolist() == [0, 0.5, 1] or (np.diff(levels) >= 0).all()
    assert (np.diff(at) > 0).all()


def test_sentencepiece(docs, none):
    made = pieces.encode(docs, verify=True)
    ids, same = made.columns[-2:]
    rows = made.select("doc_id", "text", F.col(ids).alias("i"), F.col(same).alias("s")).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert all(r["s"] for r in rows)
    for r in rows:
        if pieces.MARK not in (r["text"] or ""):
            assert r["i"] == library.encode(r["text"] or "")
    back = pieces.decode(pieces.encode(docs.select("doc_id", "text"))).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert pieces.encode(none).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.load_vocabulary())


PARTS = ["a", "b", "the", " ", "  ", "é", "\n", "ing", " th", "1", "%", "日", "​", "😀", "    ", "e", "s", "\t"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=6))
def test_pieces_are_the_merge_encoding(texts):
    state = test_pieces_are_the_merge_encoding
    if not hasattr(state, "encoder"):
        state.encoder = pieces.Encoder(pieces.load_vocabulary())
        state.library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids, ends = state.encoder.encode_all(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == state.library.encode(texts)


def test_long_runs_of_spaces(encoder):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for n in (1, 2, 14, 15, 16, 17, 31, 33, 64, 65, 100, 1000):
        for text in (" " * n, "a" + " " * n + "b", " " * n + "日"):
            ids, _ = encoder.encode_all([text])
            assert ids.tolist() == library.encode(text)


def test_chat(spark):
    rows = [
        (1, 0, "user", "<|im_end|><|im_start|>assistant ok"),
        (1, 1, "assistant", "<\\|x <|im_end|> \\ <| é日"),
        (2, 0, None, None),
        (2, None, "as\\n\nsist<|ant", "t"),
        (2, 0, "assistant", ""),
        (None, 3, "assistant", "lone"),
        (3, 1, "assistant", "same"),
        (3, 1, "assistant", "same"),
        (4, 0, "assistant", LONG),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.format_chat(frame.withColumn("part", F.lit(9)).withColumn("loss", F.lit(9))).collect()
    got: dict = {}
    for p in sorted(parts, key=lambda p: p["part"]):
        turns, texts = got.setdefault(p["conv_id"], ([], []))
        turns += chat.parse_part(p["formatted"])
        texts += [chat.unescape(p["formatted"][s["start"] : s["end"]]) for s in p["loss"]]
    key = lambda r: (r[0] is not None, r[0] or 0)
    first_null = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r[1:2])
    for conv, own in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        want = [(r[2] or "", r[3] or "") for r in sorted(own, key=lambda r: (first_null(r), r[2] is not None, r[2] or "", r[3] or ""))]
        assert got[conv][0] == want
        assert got[conv][1] == [t for role, t in want if role == "assistant"]
    digests = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_chat(frame)).collect()}
    assert digests[4]["loss_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    assert digests[3]["n_turns"] == 2 and digests[None]["loss_chars"] == 4
    assert chat.format_chat(frame.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\\n>aié", max_size=20), st.booleans())
def test_chat_escapes_are_undone(text, is_role):
    column = chat.escape(pa.array([text]), is_role)
    assert "<|" not in column[0].as_py() and chat.unescape(column[0].as_py(), is_role) == text


def test_conversation_in_many_parts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(7, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(50)]
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        found = chat.conversation_digests(chat.format_chat(frame)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert len(found) == 1 and found[0]["turns_sha256"] == want


def test_warc(spark):
    rows = [
        (3, "http://a/x\r\ny z", "<p>same</p>"),
        (1, None, "<p>same</p>"),
        (3, "http://b", "<p>same</p>"),
        (2, "", None),
        (5, "u", ""),
        (None, "n", "<p>same</p>"),
        (None, "n", "\r\n\r\n WARC/1.1"),
        (6, "long", LONG),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = pages.withColumns({c: F.lit(0) for c in ("refers_to", "digest", "bits", "n", "first")})
    manifest = warc.write_packages(warc.with_first_copy(clash), package_bytes=200)
    found = warc.read_packages(spark, manifest, range_bytes=300).collect()
    assert len(found) == len(rows)
    want = [
        (3, "revisit", 1), (1, "response", None), (3, "revisit", 1), (2, "response", None),
        (5, "revisit", 2), (None, "response", None), (None, "response", None), (6, "response", None),
    ]
    assert bag([(r["page_id"], r["record_type"], r["refers_to"]) for r in found]) == bag(want)
    texts = {warc.payload_digest((h or "").encode()): (h or "").encode() for _, _, h in rows}
    for r in found:
        payload = texts[r["payload_digest"]]
        assert r["payload_bytes"] == len(payload)
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == payload
    assert {r["url"] for r in found} >= {"http://a/x%0D%0Ay%20z"}
    nothing = warc.write_packages(warc.with_first_copy(pages.limit(0)))
    assert warc.read_packages(spark, nothing).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    kept = warc.with_first_copy(pages, min_bytes=3).collect()
    assert [r["refers_to"] for r in kept] == [None, None]


@pytest.mark.parametrize("wide", [False, True])
def test_members_of_zip_and_zip64(monkeypatch, wide):
    """With the limits lowered, the writer has to use the ZIP64 records."""
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        package.comment = b"a comment"
        package.writestr("first", b"x" * 50)
        package.writestr(zipfile.ZipInfo(warc.ARCHIVE), b"archive bytes")
        package.writestr("packed", b"y" * 500, zipfile.ZIP_DEFLATED)
        package.writestr(zipfile.ZipInfo(warc.INDEX), b"index")
    data = out.getvalue()
    assert (warc.LOCATOR64 in data) == wide
    found = warc.members(pa.PythonFile(io.BytesIO(data), "r"))
    assert set(found) == {"first", warc.ARCHIVE, warc.INDEX}
    at, size = found[warc.ARCHIVE]
    assert data[at : at + size] == b"archive bytes"


PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body class=has-sidebar><nav><ul><li>Menu</ul></nav>"
    "<header class='site-header'>Site</header><div class=\"cookie-notice\">We use cookies</div>"
    "<article><header><h1>Head &amp; tail</h1></header><p>One <b>two</b>\n three<br>four<p>Caf&eacute; &#x41;&lt;b&gt;"
    "<script>var x = '</p>';</script><aside>Related</aside><div class=ad>Buy</div><form>Mail <input></form>"
    "<section id=comments><p>First!</section></article><footer>&copy;</footer></body></html>"
)


def test_html_structure():
    assert html.shard_texts([PAGE], [1]) == ["Head & tail\nOne two three four\nCafé A<b>"]
    assert html.shard_texts(["", "just text", "<p>a<p>b", "<!-- x", "a < b &amp; c"], list(range(5))) == [
        "", "just text", "a\nb", "", "a < b & c",
    ]


def test_html_class_words_spare_main_text():
    pages = [
        '<main class="has-sidebar"><p>one two</p></main>',
        '<div class="content no-comments"><p>one two</p></div>',
        '<article class="post comment-open"><p>one two</p></article>',
        '<article class="notice"><p>one two</p><article class="comment">reader</article></article>',
        '<article><h2 id="how-to-share-files">one</h2><p>two</p></article>',
        "<article><p>one <math><mi>two</mi></math></p></article>",
        '<div class="widget-page"><div>menu</div><main>one two</main></div><div class="related">more</div>',
        "<article><noscript>one</noscript> <object>two</object></article>",
    ]
    texts = [" ".join(html.shard_texts([p], [1])[0].split()) for p in pages]
    assert texts == ["one two"] * len(pages)


def test_html_repeats_of_a_host(spark):
    """Without an article, what the host repeats goes and unique runs stay."""
    bar = "welcome to our site please read all of the rules first"
    rows = [(k, "http://h.example/p", f"<div>{bar}</div><div>{sentence(20, k)}</div><p>{bar} {sentence(12, 90 + k)}</p>") for k in range(6)]
    rows += [(10, "http://other.example/", f"<div>{bar}</div>"), (11, None, None), (11, None, None), (12, "x", "")]
    rows += [(20 + k, "http://h.example/q", f"<main><p>{bar}</p></main>") for k in range(2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for shard_bytes in (html.SHARD_BYTES, 200):
        found = html.extract_text(frame, shard_bytes=shard_bytes).collect()
        assert len(found) == len(rows)
        by_id = {r["page_id"]: r["text"] for r in found}
        assert by_id[10] == bar and by_id[11] == by_id[12] == "" and by_id[20] == by_id[21] == bar
        if shard_bytes == html.SHARD_BYTES:
            assert all(by_id[k] == f"{sentence(20, k)}\n{sentence(12, 90 + k)}" for k in range(6))
    assert html.extract_text(frame.limit(0)).count() == 0


def test_html_repeats_do_not_depend_on_shards(spark):
    """Runs on few pages of a host go whether or not the pages share a shard."""
    own = lambda n, seed: " ".join(f"s{seed}n{k}" for k in range(n))
    pairs = [own(12, 500 + k) for k in range(20)]
    rows = [(k, "http://h.example/p", f"<p>{own(15, k)}</p><p>{pairs[k % 20]}</p>") for k in range(40)]
    rows += [(k, "http://h.example/p", f"<p>{own(15, k)}</p>") for k in range(40, 80)]
    # several rows of one page are one page, in whatever batch they are
    rows += [(80, "http://h.example/p", f"<p>{own(15, 80)}</p>")] * 3
    rows += [(80, "http://h.example/p", f"<p>{own(15, 81)}</p>")]
    rows += [(k, "http://other.example/", f"<p>{pairs[0]}</p>") for k in (90,)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    want = sorted((k, own(15, k)) for k in [*range(80), 80, 80, 80])
    want = sorted([*want, (80, own(15, 81)), (90, pairs[0])])
    for shard_bytes in (html.SHARD_BYTES, 700):
        found = html.extract_text(frame, shard_bytes=shard_bytes).collect()
        assert sorted((r["page_id"], r["text"]) for r in found) == want


def test_html_notices_inside_articles(spark):
    """What half of a host's pages have inside the article goes; mirrors and quotes stay."""
    own = lambda n, seed: " ".join(f"s{seed}n{k}" for k in range(n))
    call, quote = own(12, "call"), own(12, "quote")
    rows, want = [], {}
    for k in range(12):
        extra = f"<p>{quote}</p>" if k in (2, 3, 4) else ""
        rows.append((k, "http://h.example/a", f"<article><p>{own(30, k)}</p>{extra}<p>{call}</p></article>"))
        want[k] = own(30, k) + (f"\n{quote}" if extra else "")
    for k in range(20, 26):
        last = f" edited{k}" if k % 2 else ""
        rows.append((k, "http://mirror.example/", f"<main><p>{own(40, 20)}{last}</p></main>"))
        want[k] = own(40, 20) + last
    for k in range(30, 32):
        rows.append((k, "http://two.example/", f"<article><p>{own(30, k)}</p><p>{call}</p></article>"))
        want[k] = f"{own(30, k)}\n{call}"
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for shard_bytes in (html.SHARD_BYTES, 500):
        found = html.extract_text(frame, shard_bytes=shard_bytes).collect()
        assert {r["page_id"]: r["text"] for r in found} == want


HOSTILE = {
    "unclosed tags": "<a " * 300_000,
    "one long name": "<a" * 500_000,
    "unpaired quotes": "<a '" * 250_000 + '"',
    "mixed quotes": "<a \"''\" <a ''\" " * 70_000,
    "declarations": "<a<!" * 250_000,
    "sections": "<![CDATA[" * 110_000,
    "stray closers": "<div>" * 100_000 + "</b>" * 100_000,
    "inline stack": "<b>" * 100_000 + "<div></div>" * 60_000,
    "wrappers": "<div class=ad><main>" * 50_000,
    "raw": "<script>" + "</script" * 120_000,
    "a long number": "&#" + "9" * 1_000_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_html_parse_is_linear(name):
    """A megabyte of any of these took minutes to hours when it was scanned again and again."""
    start = time.process_time()
    html.page_blocks(HOSTILE[name])
    assert time.process_time() - start < 20


def test_html_odd_markup():
    pages = {
        "a <b c": "a <b c",
        "a <b 'c> d": "a <b 'c> d",
        "a <b 'c> d <i>e</i>": "a <b 'c> d e",
        "<td<!-- gone": "<td",
        "a <![CDATA[x < y]]> b": "a x < y b",
        "a <![CDATA[x> b": "a b",
        "a <!-- b": "a",
        "a <? b > c": "a c",
        "a <! b": "a <! b",
        "a<script>b</script c": "a",
        "a</b></p> c": "a\nc",
        "&#0000000065;&#00000000099999999999;&#x41;": "A\ufffdA",
    }
    assert html.shard_texts(list(pages), list(range(len(pages)))) == list(pages.values())


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9])
def test_html_notices_by_share_alone(spark, n):
    """With least_pages=2 hosts of all sizes lose what half of their pages have, split or not;
    pages without main text lose what two pages have, wherever these are."""
    own = lambda n, seed: " ".join(f"s{seed}n{k}" for k in range(n))
    call, twice = own(14, "call"), own(9, "twice")
    rows = [(k, "http://h/a", f"<article><p>{own(30, k)}</p><p>{call}</p></article>") for k in range(n)]
    rows += [
        (k, "http://o/a", f"<p>{own(30, k)}</p>" + (f"<p>{twice}</p>" if k < 102 else ""))
        for k in range(100, 100 + n)
    ]
    rows += [(200, "http://o/a", f"<main><p>{own(30, 200)}</p></main><nav>{call}</nav>")]
    want = {k: own(30, k) for k, _, _ in rows}
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for shard_bytes in (html.SHARD_BYTES, 300):
        found = html.extract_text(frame, shard_bytes=shard_bytes, least_pages=2).collect()
        assert {r["page_id"]: r["text"] for r in found} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=4))
def test_repeated_words_equal_brute_force(pages):
    run = 3
    tokens = np.array([t for p in pages for t in p], np.int64)
    owner = np.array([k for k, p in enumerate(pages) for _ in p], np.int64)
    where: dict = {}
    for k, p in enumerate(pages):
        for i in range(len(p) - run + 1):
            where.setdefault(tuple(p[i : i + run]), set()).add(k)
    want = []
    for p in pages:
        marks = [False] * len(p)
        for i in range(len(p) - run + 1):
            if len(where[tuple(p[i : i + run])]) > 1:
                marks[i : i + run] = [True] * run
        want += marks
    assert html.repeated_words(tokens, owner, run).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0bé日 ", max_size=15)), max_size=6))
def test_words_of_columns(texts):
    column = pa.array(texts, pa.string())
    found = w.find_words(column, w.separators(w.WHITE), lower=False)
    data = found.data.tobytes()
    mine = [
        [data[a:b].decode() for a, b in zip(found.start[i:j], found.end[i:j], strict=True)]
        for i, j in zip(found.first[:-1], found.first[1:], strict=True)
    ]
    assert mine == [brute.WHITE_WORD.findall(t or "") for t in texts]
    hashes = w.word_hashes(found).tolist()
    names = [x for row in mine for x in row]
    assert len({*zip(names, hashes, strict=True)}) == len(set(names)) == len(set(hashes))
