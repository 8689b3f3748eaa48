"""One query an operator, over whole tables, with production parameters; and their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe.llm import bpe, embedding_dedup, licenses, lines, minhash, mixing, quality, secrets, topk, warc
from flowframe.llm.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that its files deal to half as many tasks as there are cores or fewer is dealt anew, as a row group cannot be split."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows if 2 * rows.rdd.getNumPartitions() > cores else rows.repartition(cores)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.train(secrets.samples(spark), secrets.corpus_words(docs)))
    spelt = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(spelt(F.filter("secrets", lambda s: s["kind"] != "random")), 256).alias("base_sha256"), spelt(F.col("secrets")).alias("spans"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), all_ranges=True)
    base = F.array_sort(F.array_distinct("places.label"))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
                        F.array_min("places.start").cast("bigint").alias("first_word"), F.array_max("places.start").cast("bigint").alias("last_word"),
                        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.col("blocks.label"))), ",").alias("labels"), score.alias("score"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", F.col("block_no").cast("bigint").alias("block_no"), "slot", F.col("within").cast("bigint").alias("within"), "in_balance")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, topk.queries_of(vectors))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_path(spark))
    number = lambda name: F.regexp_extract(name, r"^urn:page:(-?[0-9]+)$", 1).try_cast("bigint")
    return warc.read_archives(spark, path, payload=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents"))


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of what they decode to."""
    return bpe.encode(docs, decoded=True).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_embedding_dedup, op3_secret_scan, op4_license_scan, op5_source_mixing,
                                   op6_line_dedup, op7_topk_search, op8_quality, op9_warc, op10_bpe)}
