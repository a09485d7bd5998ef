"""The corpus pipeline: five stages from documents to a mix, each on what the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.
In all of them null texts are empty texts, null ids are ids like any other, rows are judged one by one, repeated rows
alike (the near-copy stage keeps one of them), texts of any length are read whole, and an empty table gives no rows.
The first four keep further columns of ``docs`` too, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from factweave.functions.storage import checkpoint_dir
from factweave.llm.decontaminate import decontaminate
from factweave.llm.line_dedup import line_dedup
from factweave.llm.ngram_join import one_of_each
from factweave.llm.queries import fold
from factweave.llm.source_mix import mix_sources
from factweave.llm.toxicity import fit, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, lambda doc_id: F.coalesce(fold(doc_id, 3) == 1, F.lit(False)))
    return toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are taken out of the texts; a text of which nothing is left goes."""
    done = line_dedup(docs)
    left = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays, of repeated rows one; rows that share an id but not a text are told apart."""
    return one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), exact=True)
    return found.where(F.size("leaks") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("source_mix", mix),
]

#: fitted models and 64-bit sketches of this library stand in several stages, which SQL does not express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
