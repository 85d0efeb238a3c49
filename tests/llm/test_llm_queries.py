"""Registered corpus queries against SQL, brute force or held-out labels."""

from __future__ import annotations

import os
import re
from collections import Counter
from html import unescape

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import connect
from holdfast.llm import sentencepiece as pieces
from holdfast.llm.common import stored
from holdfast.llm.oracles import SQL
from holdfast.llm.queries import QUERIES
from tests.llm import brute

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = connect(SMALL)
    df = QUERIES[name](spark, SMALL)
    con.execute(SQL[name])
    theirs = [d[0] for d in con.description]
    order = sorted(df.columns)
    assert order == sorted(theirs)
    mine = Counter(tuple(r[c] for c in order) for r in df.collect())
    at = [theirs.index(c) for c in order]
    assert mine == Counter(tuple(r[i] for i in at) for r in con.fetchall())


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}


def _accuracy(rows, labels, column):
    known = {r["doc_id"]: r[column] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert held and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    ones = [r["score"] for r in held if known[r["doc_id"]] == 1]
    zeros = [r["score"] for r in held if known[r["doc_id"]] == 0]
    ahead = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
    hits = sum(r["predicted"] == known[r["doc_id"]] for r in held)
    return hits / len(held), ahead / (len(ones) * len(zeros))


@pytest.mark.parametrize(
    ("name", "column", "accuracy", "area"),
    [("op1_toxicity", "toxic", 0.95, 0.93), ("op7_quality_classifier", "quality", 0.96, 0.98)],
)
def test_classifiers_on_held_out_labels(spark, name, column, accuracy, area):
    rows = QUERIES[name](spark, LARGER).collect()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    found = _accuracy(rows, spark.read.parquet(f"{LARGER}/labels.parquet"), column)
    assert found[0] >= accuracy and found[1] >= area


def test_pieces_equal_those_of_the_public_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op2_sentencepiece"](spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
        assert r["ids"] == library.encode(texts[r["doc_id"]])


def test_components_equal_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()]
    rows = QUERIES["op3_ngram_jaccard_join"](spark, LARGER).collect()
    assert sorted(tuple(r) for r in rows) == sorted(brute.near(docs))


def test_main_text_is_the_article(spark):
    rows = {r["page_id"]: r for r in QUERIES["op4_html_extraction"](spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page["html"], re.DOTALL)[1]
        blocks = [re.sub(r"<[^>]+>", "", b) for b in re.split(r"</?(?:p|h1)>|<br>", article)]
        lines = [" ".join(unescape(b).split()) for b in blocks]
        assert rows[page["page_id"]]["text"] == "\n".join(x for x in lines if x)
        assert rows[page["page_id"]]["n_chars"] == len(rows[page["page_id"]]["text"])


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage on what its predecessor kept; toxicity by its own scores."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    names = docs.columns
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op1_toxicity"](spark, LARGER).collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if k == 0:
            kept = {d for d, _ in before if scores[d] < 0.7}
        elif k == 1:
            largest: dict[str, int] = {}
            for d, t in before:
                largest[t] = max(d, largest.get(t, d))
            kept = set(largest.values())
        elif k == 2:
            kept = {d for d, _, c in brute.near(before) if c == d}
        elif k == 3:
            kept = {d for d, n, hit, _ in brute.contamination(before, items) if not (hit and 20 * hit >= n)}
        else:
            kept = {d for d, _ in before}
        after = corpus_pipeline.stored(stage(spark, docs, LARGER))
        rows = after.collect()
        assert len(rows) == len(kept) and {r["doc_id"] for r in rows} == kept
        if k < 4:
            assert after.columns == names
        else:
            texts = dict(before)
            assert all(r["round_trip"] and r["ids"] == library.encode(texts[r["doc_id"]]) for r in rows)
        docs = after


STAGE_ROWS = [
    (1, "a b c d e f", "x"), (1, "g h i j k l", "x"), (2, "a b c d e f", None), (3, None, "x"), (4, "", "x"),
    (None, "a b c d e f", "x"), (None, None, None), (5, "m n o p q r", "x"), (5, "m n o p q r", "x"),
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
@pytest.mark.parametrize("n", [0, len(STAGE_ROWS)])
def test_pipeline_stages_on_odd_rows(spark, name, stage, n):
    """Nulls, repeated ids, copies and extra columns; and an empty table."""
    frame = spark.createDataFrame(STAGE_ROWS[:n], "doc_id long, text string, lang string")
    frame = frame.withColumns({c: F.lit(7) for c in ("source", "bits", "label", "keep_id", "ids", "round_trip")})
    docs = stored(frame)
    found = stage(spark, docs, SMALL)
    rows = sorted([(r["doc_id"], r["lang"]) for r in found.collect()], key=str)
    if name == corpus_pipeline.STAGES[-1][0]:
        assert set(found.columns) == {"doc_id", "lang", "source", "ids", "n_tokens", "round_trip"}
        assert all(r["round_trip"] is True for r in found.collect())
    else:
        assert found.columns == docs.columns
    want = [(i, lang) for i, _, lang in STAGE_ROWS[:n]]
    if name == "exact dedup" and n:
        # of the copies with an id the largest stays; (1, "g ...") is no copy; no id, no drop
        want = [(1, "x"), (2, None), (4, "x"), (None, "x"), (None, None), (5, "x"), (5, "x")]
    if name == "n-gram Jaccard join" and n:
        want.remove((2, None))
    assert rows == sorted(want, key=str)
