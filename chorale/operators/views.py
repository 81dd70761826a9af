"""Paging, windowing, slicing, epoch and frame reductions behind interactive views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.columns import quantile


def blocks_of(samples: DataFrame, size: int, full: bool = True) -> DataFrame:
    """chan, block_id, pos, x; with ``full`` only blocks that have all samples."""
    cut = samples.select("chan", F.floor(F.col("t") / size).alias("block_id"), (F.col("t") % size).alias("pos"), "x")
    if not full:
        return cut
    n = F.count("*").over(Window.partitionBy("chan", "block_id"))
    return cut.withColumn("n", n).where(F.col("n") == size).drop("n")


def overlapped(samples: DataFrame, size: int, hop: int, last: int) -> DataFrame:
    """chan, block_id, pos, t, x of overlapping full blocks, of t up to ``last``."""
    t = F.col("t")
    first = F.greatest(F.ceil((t - size + 1) / hop), F.lit(0)).cast("long")
    final = F.least(F.floor(t / hop), F.floor(F.lit((last - size + 1) / hop))).cast("long")
    rows = samples.where((t <= last)).withColumn("__a", first).withColumn("__b", final).where("__a <= __b")
    return rows.select("chan", "t", "x", F.explode(F.sequence("__a", "__b")).alias("block_id")).withColumn("pos", F.col("t") - F.col("block_id") * hop)


def overlap_add(blocks: DataFrame, weight: str = "w") -> DataFrame:
    """chan, t, y: weighted mean of what overlapping blocks say of a time."""
    g = blocks.groupBy("chan", "t").agg(F.sum(F.col(weight) * F.col("x")).alias("s"), F.sum(weight).alias("w"))
    return g.select("chan", "t", (F.col("s") / F.coalesce(F.nullif(F.col("w"), F.lit(0.0)), F.lit(1.0))).alias("y"))


def safe_slice(series: DataFrame, start: int, num: int, fill: float | None = None) -> DataFrame:
    """chan, pos, x of ``num`` positions from ``start``; missing ones get ``fill`` or go on in a line.

    The line runs through the two first or the two last samples of a channel.
    """
    want = series.select("chan").distinct().withColumn("t", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(start + num - 1).cast("long"))))
    got = want.join(series, ["chan", "t"], "left")
    if fill is not None:
        return got.select("chan", (F.col("t") - start).alias("pos"), F.coalesce("x", F.lit(fill)).alias("x"))
    ends = series.groupBy("chan").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.min_by("x", "t").alias("xa"), F.max_by("x", "t").alias("xb"))
    near = series.join(ends, "chan").groupBy("chan", "a", "b", "xa", "xb").agg(F.max(F.when(F.col("t") == F.col("a") + 1, F.col("x"))).alias("xa2"), F.max(F.when(F.col("t") == F.col("b") - 1, F.col("x"))).alias("xb2"))
    line = F.when(F.col("t") < F.col("a"), F.col("xa") + (F.col("t") - F.col("a")) * (F.col("xa2") - F.col("xa"))).when(F.col("t") > F.col("b"), F.col("xb") + (F.col("t") - F.col("b")) * (F.col("xb") - F.col("xb2")))
    return got.join(near, "chan").select("chan", (F.col("t") - start).alias("pos"), F.coalesce("x", line).alias("x"))


def page(samples: DataFrame, number: int, size: int) -> DataFrame:
    """chan, t, y: a page with one page either side, channels stacked by the median peak-to-peak."""
    part = samples.where((F.col("t") >= (number - 1) * size) & (F.col("t") < (number + 2) * size))
    offset = part.groupBy("chan").agg((F.max("x") - F.min("x")).alias("ptp")).agg(quantile("ptp", 0.5).alias("off"))
    return part.crossJoin(F.broadcast(offset)).select("chan", "t", (F.col("x") + F.col("chan") * F.col("off")).alias("y"))


def common_average(samples: DataFrame) -> DataFrame:
    """chan, t, x: samples less the mean over channels at their time."""
    return samples.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("t"))).select("chan", "t", "x")


def epochs(samples: DataFrame, events: DataFrame, pre: int, post: int) -> DataFrame:
    """chan, trial, t, x: samples from ``pre`` before to ``post`` after (excluded) each event.

    Each event names the times of its window, so samples meet it by equality.
    """
    want = events.select("trial", F.explode(F.sequence(F.col("t") - pre, F.col("t") + post - 1)).alias("at"), F.col("t").alias("t0"))
    return samples.join(want, samples["t"] == want["at"]).select("chan", "trial", (F.col("at") - F.col("t0")).alias("t"), "x")


def interval_overlap(intervals: DataFrame, lo: float, hi: float) -> DataFrame:
    """Intervals that touch [lo, hi], with how: within, contains, opens or closes in it."""
    a, b = F.col("a"), F.col("b")
    opens, closes = (a >= lo) & (a <= hi), (b >= lo) & (b <= hi)
    how = F.when(opens & closes, "within").when((a < lo) & (b > hi), "contains").when(opens, "opens").when(closes, "closes")
    return intervals.withColumn("how", how).where("how is not null")


def frames(samples: DataFrame, grid: DataFrame) -> DataFrame:
    """t, row, col, v: every site of the grid at every time, null where no channel is."""
    times = samples.select("t").distinct()
    full = times.crossJoin(F.broadcast(grid.select("site", "row", "col")))  # the grid is one array's sites
    return full.join(samples.select(F.col("chan").alias("site"), "t", F.col("x").alias("v")), ["site", "t"], "left").select("t", "row", "col", "v")


def mosaic(n: int) -> tuple[int, int]:
    """Rows and columns of the most square grid that ``n`` tiles fit."""
    cols = int(-(-(n**0.5) // 1))
    return -(-n // cols), cols
