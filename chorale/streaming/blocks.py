"""Block operators on streams: tumbling, sliding and session windows.

Extensions: the batch operators work on stored signals; these give the same
reductions while samples arrive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.sources.masks import mask_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chan, at, x as a stream; a watermark needs a timestamp with time zone."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return rows.select(F.col("event_type").alias("chan"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("x"))


def block_rms(stream: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """chan, start, rms, n of time blocks, overlapping if ``slide`` is shorter than ``length``."""
    block = F.window("at", length, slide) if slide else F.window("at", length)
    g = stream.withWatermark("at", late).groupBy("chan", block.alias("w"))
    return g.agg(F.stddev_pop("x").alias("rms"), F.count("x").alias("n")).select("chan", F.col("w.start").alias("start"), "rms", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """chan, start, end, n of bursts of events with no gap as long as ``gap``."""
    g = stream.withWatermark("at", late).groupBy("chan", F.session_window("at", gap).alias("w"))
    return g.agg(F.count("*").alias("n")).select("chan", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def average_reference(stream: DataFrame, length: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """start, car: the mean over all channels of each time block."""
    g = stream.withWatermark("at", late).groupBy(F.window("at", length).alias("w"))
    return g.agg(F.avg("x").alias("car"), F.count("x").alias("n")).select(F.col("w.start").alias("start"), "car", "n")


def finished(result: DataFrame) -> DataFrame:
    """Run a stream over what is there now, and read its final result."""
    spark = result.sparkSession
    folder = f"{mask_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    run = result.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")
