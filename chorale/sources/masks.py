"""Channel masks kept by name as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions.shared import shared_folder


def mask_folder(spark: SparkSession) -> str:
    """A folder for masks beside the shared checkpoints (a temporary one in tests)."""
    return f"{shared_folder(spark)}/masks"


def stash(mask: DataFrame, name: str, folder: str | None = None, overwrite: bool = False) -> str:
    """Write chan and ok under a dataset's name; refuse to replace one unless told to."""
    path = folder or mask_folder(mask.sparkSession)
    mask.select("chan", "ok").write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/dataset={name}")
    return path


def lookup(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """dataset, chan and ok as they were stashed."""
    return spark.read.parquet(f"{folder}/dataset={name}").select(F.lit(name).alias("dataset"), "chan", "ok")


def toggled(mask: DataFrame, chans: DataFrame) -> DataFrame:
    """``mask`` (chan, ok) with the state of ``chans`` (chan, repeats counted once) turned over."""
    flip = chans.select("chan").distinct().withColumn("__flip", F.lit(True))
    return mask.join(flip, "chan", "left").select("chan", (F.col("ok") != F.coalesce("__flip", F.lit(False))).alias("ok"))


def cleared(power: DataFrame, value: str = "p") -> DataFrame:
    """chan and ok: the mask that keeps every channel with a value."""
    return power.select("chan", (F.col(value).isNotNull() & ~F.isnan(value)).alias("ok"))
