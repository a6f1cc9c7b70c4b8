"""A corpus from documents to packed sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.

In every stage rows count each for itself: null ids and sources are values like others, repeated rows are treated alike,
and an empty table gives an empty one. Other columns of docs than those of documents are left behind, so none can clash.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import jaccard_join, mixing, packing, secret_scan, toxicity
from emberlog.llm.common import spool, sweep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more.

    Null and empty texts get the score of the bias alone; with no usable label every score is 0 and all documents stay.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=False)
    return toxicity.score(docs, model, into="_score").filter("_score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every class at five words and a similarity of 0.8.

    Of repeated rows one stays; rows without words are in no class and all stay; a row without an id stays where no row
    with one is in its class.
    """
    return jaccard_join.keep_one(docs).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows. Null texts stay null, with the n_chars that they have."""
    return secret_scan.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as its source's target asks for: 0 to 3 times, and texts without words never."""
    return mixing.take(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens; a row per piece, with its ids. A null text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, guess costs and hashes of this code are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``. Deletes the tables that stages (and other operators, before) have spooled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = spool(docs)
            sweep(spark, docs)  # what the stage has written on its way
    return docs
