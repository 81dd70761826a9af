"""Sources, and the long-form views that the signal operators take.

samples (chan, t, x): events averaged in 120 bins over all their span, of 6 hours
or the least multiple of that; one channel per type.
field (site, sample, v): mean order value by customer's nation and quarter.
sites (site, row, col, x, y): the nations on a 5-column grid.
cloud (i, v): embeddings as points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BIN_US, BINS, DAY_US = 21_600_000_000, 120, 86_400_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents_mean(c: str) -> F.Column:
    """Mean of a column of two decimals, from an exact integer sum."""
    return F.sum(F.round(F.col(c) * 100).cast("long")) / F.lit(1e2) / F.count(c)


def micros(c: str) -> F.Column:
    """Microseconds since the start of 2024, negative before."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', {c})")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chan and event_type, numbered in order of name."""
    types = load(spark, sf_dir, "events").select("event_type").where("event_type is not null").distinct()
    names = types.groupBy().agg(F.array_sort(F.collect_set("event_type")).alias("names"))
    return names.select(F.posexplode("names").alias("chan", "event_type"))


def span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin and width (microseconds), one row: the first event's day, and bins that reach the last event."""
    e = load(spark, sf_dir, "events").where("value is not null and event_type is not null")
    ends = e.agg(F.min(micros("ts")).alias("a"), F.max(micros("ts")).alias("b"))
    ends = ends.select((F.floor(F.col("a") / DAY_US) * DAY_US).alias("origin"), "b")
    return ends.select("origin", (F.ceil((F.col("b") - F.col("origin") + 1) / (BINS * BIN_US)) * BIN_US).alias("width"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chan, t, x: every bin of every channel, 0 where it has no event."""
    e = load(spark, sf_dir, "events").where("value is not null").crossJoin(F.broadcast(span(spark, sf_dir)))  # one row
    means = e.groupBy("event_type", F.floor((micros("ts") - F.col("origin")) / F.col("width")).alias("t")).agg(cents_mean("value").alias("x"))
    grid = channels(spark, sf_dir).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long"))))
    return grid.join(means, ["event_type", "t"], "left").select("chan", "t", F.coalesce("x", F.lit(0.0)).alias("x"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chan, block_id, x: event values of each user by day."""
    e = load(spark, sf_dir, "events").where("value is not null and user_id is not null")
    return e.select(F.col("user_id").alias("chan"), F.floor(micros("ts") / 86_400_000_000).alias("block_id"), F.col("value").alias("x"))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, sample, v: mean order value, in thousands, by nation and quarter."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    joined = orders.join(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sample = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("sample")
    return joined.groupBy(F.col("c_nationkey").alias("site"), sample).agg((cents_mean("o_totalprice") / F.lit(1e3)).alias("v"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, row, col and coordinates of the nations."""
    k = F.col("n_nationkey")
    row, col = F.floor(k / 5).cast("int"), (k % 5).cast("int")
    return load(spark, sf_dir, "nation").select(k.alias("site"), row.alias("row"), col.alias("col"), col.cast("double").alias("x"), row.cast("double").alias("y"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, v: embeddings as arrays of double."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v"))
