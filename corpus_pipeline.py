"""Cleaning pipeline over `documents`, a stage an operator.

Each stage reads what its predecessor kept. All but the last return the columns
of documents; the last returns token ids.

Defined results, for every stage: further columns, whatever their names, are
left out; a null text is kept by the filters as an empty one would be, has no
lines, no words to mix (so mixing drops it) and no tokens; a null source is a
source of its own; rows that repeat each other are filtered alike, and near-
duplicates keeps one; of rows that share an id but not a text each is judged by
its own text; texts are read whole, of any length; empty tables stay empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vivaspark.llm import bpe, line_templates, mixing, simhash, toxicity
from vivaspark.llm.common import table
from vivaspark.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores as toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(COLUMNS), model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs go, but for their first document; n_chars follows the text."""
    out = line_templates.drop_recurring_lines(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id: texts with 0.8 of their five-word shingles in common, or fingerprints at 2 bits."""
    return simhash.keep_one(docs.select(COLUMNS), words_each=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take_copies(docs.select(COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to as a digest."""
    coded = bpe.round_trip(docs, keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", "n_tokens", F.col("ids_text").alias("ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Learned scores, Newton steps and merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def _forget(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later stage reads."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; what a stage wrote goes once the next has written."""
    docs, last = table(spark, sf_dir, "documents"), None
    shared = shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{shared}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            _forget(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
