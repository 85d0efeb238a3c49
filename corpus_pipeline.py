"""The corpus pipeline: toxic documents, copies, near copies and benchmark passages go,
what is left is tokenised.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``.  All but
the last keep the columns of ``documents``, extra ones included.  Rows without an id cannot
be named, so only the toxicity and decontamination stages, which judge rows by
themselves, ever drop them.  Null and empty texts are copies of each other, have no pieces
and are otherwise clean; an empty table stays empty; an id that several rows share names
a row together with its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import decontaminate, exact_dedup, jaccard, sentencepiece, toxicity
from holdfast.llm.common import stored, without_ids


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches the threshold; learns from the labels of ``docs``."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the document with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, keeps the document with the smallest id.

    Where rows with different texts share an id and one of them stays, all of them do.
    """
    stays = F.max(F.col("doc_id") == F.col("component_id")).alias("stays")
    lost = jaccard.near_duplicates(docs).groupBy("doc_id").agg(stays).where("not stays")
    return without_ids(docs, lost.select("doc_id"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least a twentieth of the words are benchmark passages."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each text, and whether they decode to it."""
    made = sentencepiece.encode(docs, verify=True)
    ids, same = made.columns[-2:]
    return made.select(
        "doc_id",
        "lang",
        "source",
        F.col(ids).alias("ids"),
        F.size(ids).cast("long").alias("n_tokens"),
        F.col(same).alias("round_trip"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece", sentencepiece_stage),
]

# A trained model and a tokenizer are not SQL; tests/llm holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
