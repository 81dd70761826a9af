"""The opN queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm import decontam, difference_cover, lattice, licenses, oracles, simhash, suffix_buckets, token_counts, toxicity, trie_bpe, vantage
from chorale.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3))
    return toxicity.score(docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages")


def op5_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_buckets.dedup(table(spark, sf_dir, "documents"))


def op6_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vantage.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"))


def op9_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difference_cover.dedup(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_licenses, op3_token_counts, op4_toxicity, op5_suffix_buckets, op6_vantage_points, op7_decontaminate, op8_lattice, op9_difference_cover, op10_bpe_round_trip)}

#: The others need a hash, a tokenizer, a learned model or a closure that SQL lacks.
ORACLES: dict[str, str] = {"op2_licenses": oracles.OP2, "op5_suffix_buckets": oracles.OP5, "op6_vantage_points": oracles.OP6, "op7_decontaminate": oracles.OP7, "op9_difference_cover": oracles.OP9}
