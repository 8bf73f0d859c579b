"""A training-corpus pipeline: five stages over ``documents``, each written and reread as the next one's input.

Each function takes ``(spark, docs, sf_dir)``. All stages but the last return
the columns of ``documents``; the last returns ids, token counts and digests.

In every stage ids may be null or repeated, repeated rows are rows of their own unless said
otherwise, other columns only pass through, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm import bpe, decontam, langid, linededup, simhash
from stackloom.llm.common import scratch

#: The documents' columns, in order.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those the model rejects go, and with them null texts and texts without a letter.

    The model learns from the rows whose ``lang`` is not null; if there are none, every row goes.
    """
    return langid.predict(docs, langid.fit(docs)).where("accepted").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more hold; ``n_chars`` follows. A null text comes out empty."""
    kept = linededup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of texts joined by pairs whose five-word shingles have similarity 0.8 or more.

    Null and blank texts are alike. Rows with a null id all stay; of rows with one id and one text that stand for a group, one does.
    """
    found = simhash.near_duplicates(docs, shingle=5, min_similarity=0.8, tables=2)
    return simhash.keep_one(docs, found).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null texts hold none; rows that share an id with one that does go with it."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document, as ``op10`` has them; a null text has no tokens."""
    return bpe.digests(docs.select("doc_id", "text"), bpe.default_codec())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Model training and connected components have no SQL; the tests hold the operators and the stages' results against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
