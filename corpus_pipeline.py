"""A corpus pipeline of five stages over documents: each reads all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe.llm import lines, minhash, mixing, quality
from flowframe.llm.common import discard, materialize
from flowframe.llm.queries import tokens


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; rows that share an id are told apart."""
    return minhash.deduplicate(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that mixes their sources to the target weights.

    The order is that of the written files by name and of the rows in them; a reader that needs
    it reads them so (a scan is free to deal files to tasks in another order).
    """
    return mixing.in_order(mixing.mix(docs), rows=docs.count()).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text that is left."""
    return tokens(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: SQL cannot express the classifier that comes first; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is deleted once the next one is written, the last stays as the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = getattr(docs, "path", None)
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"), "zstd")
        if before:
            discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
