"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's docs. All but the last return the columns of docs, extra ones too, whatever their names.

Edge cases, for all stages: null texts count as empty; texts of any length are read whole; an empty
table gives no rows; rows that repeat an id or have none are documents like others, but that the id
orders and seeds (which copy stays, what the mix takes, and ties in the packing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, free_name
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import drop_near_copies
from tidemark.llm.packing import pack
from tidemark.llm.quality import classify
from tidemark.llm.secrets import redact, scan_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Empty texts have a score and may go; without usable labels all have
    the score 0.5 and stay; equal texts go or stay together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classify(docs, labels)
    return scored.where(F.col(scored.columns[-1]) == 1).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more): the one with the
    smallest id. Texts without words are no copies; rows equal in id and text are."""
    return drop_near_copies(docs).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text and n_chars follows; every row stays, null texts stay null with their n_chars."""
    found = scan_secrets(docs)
    masked = redact(found, spans_col=found.columns[-1])
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Sources without words are not taken; null is a source."""
    mixed = mix(docs)
    copies, nth = F.col(mixed.columns[-2]), free_name(mixed, "_copy")
    taken = mixed.where(copies > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    return taken.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row with their places in sequences of 2048; an empty text is its end id."""
    return pack(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: A random field, token ids and repeated draws are beyond SQL; tests/llm/test_pipeline.py holds every stage and the chain
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
