"""Robust channel quality: fences, block power, correlations, box statistics."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.columns import quantile
from chorale.functions.shared import settled

#: Groups whose bounds are broadcast at most.
GROUPS = 100_000


def quantiles(df: DataFrame, value: str, by: list[str], **qs: float) -> DataFrame:
    """``by`` and the exact linear-interpolation quantiles ``qs`` by name: a row for every group, NULL where it has no value.

    Distinct values are dealt out by range with their counts, and kept; counts
    before each range and before each value in it give the ranks, so that a large
    group is held by no task.
    """
    keys = [f"__k{n}" for n in range(len(by) or 1)]
    groups = [F.col(b).alias(k) for b, k in zip(by, keys)] or [F.lit(0).alias(keys[0])]
    counts = df.select(*groups, F.col(value).cast("double").alias("__v")).groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = settled(counts.repartitionByRange(ranges, *keys, "__v").withColumn("__p", F.spark_partition_id()))
    values = kept.where("__v is not null")

    sums = values.groupBy(*keys, "__p").agg(F.sum("__n").alias("__m"))
    before = F.sum("__m").over(Window.partitionBy(*keys).orderBy("__p")) - F.col("__m")
    sums = sums.select(*keys, "__p", "__m", before.alias("__from"), F.sum("__m").over(Window.partitionBy(*keys)).alias("__total"))
    places = {name: (F.col("__total") - 1) * F.lit(float(q)) for name, q in qs.items()}
    ranks = [f(p).cast("long") for p in places.values() for f in (F.floor, F.ceil)]
    within = [(r >= F.col("__from")) & (r < F.col("__from") + F.col("__m")) for r in ranks]
    hit = sums.where(reduce(or_, within)).select(*[F.col(k).alias(f"{k}h") for k in keys], F.col("__p").alias("__ph"), F.col("__from").alias("__base"), "__total")
    near = values.join(hit, reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}h")) for k in keys] + [F.col("__p") == F.col("__ph")])).drop(*[f"{k}h" for k in keys], "__ph")
    to = F.sum("__n").over(Window.partitionBy(*keys, "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = near.withColumn("__to", F.col("__base") + to)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("__to")) & (rank >= F.col("__to") - F.col("__n")), F.col("__v")))

    ends = [c.alias(f"{name}_{end}") for name, p in places.items() for end, c in (("lo", at(F.floor(p).cast("long"))), ("hi", at(F.ceil(p).cast("long"))))]
    found = near.groupBy(*keys).agg(F.max("__total").alias("__total"), *ends)
    out = []
    for name, p in places.items():
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi).alias(name))
    found = found.select(*[F.col(k).alias(f"{k}f") for k in keys], *out)
    all_groups = kept.select(*keys).distinct()
    found = all_groups.join(found, reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}f")) for k in keys]), "left")
    return found.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], *qs)


def _joined(df: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with its groups' bounds; those of few groups are broadcast, as a join by few keys has as few tasks."""
    if not by:
        return df.crossJoin(F.broadcast(bounds))  # one row
    bounds = settled(bounds)
    return df.join(F.broadcast(bounds) if bounds.count() <= GROUPS else bounds, by)


def fenced(df: DataFrame, value: str, by: list[str], k: float, lo: float = 0.25, hi: float = 0.75, how: str = "both") -> DataFrame:
    """``df`` with inlier: value within k interquartile ranges of the quartiles of its group.

    Bounds are inclusive; a null value is no inlier.  The bounds are one row per
    group, joined back, so that no group is held in memory.
    """
    joined = _joined(df, quantiles(df, value, by, __lo=lo, __hi=hi), by)
    span = F.col("__hi") - F.col("__lo")
    low = F.col(value) >= F.col("__lo") - k * span if how in ("both", "lower") else F.lit(True)
    high = F.col(value) <= F.col("__hi") + k * span if how in ("both", "upper") else F.lit(True)
    return joined.withColumn("inlier", F.coalesce(low & high & F.col(value).isNotNull(), F.lit(False))).drop("__lo", "__hi")


def bad_channels(power: DataFrame, value: str = "p", k: float = 4.0, is_log: bool = False, lo: float = 0.25, hi: float = 0.75) -> DataFrame:
    """chan and ok: power above numerical noise, not 100 times under the median, and within the fence."""
    logs = power.withColumn("__l", F.col(value) if is_log else F.when(F.col(value) > 0, F.log(value)))
    floor = F.col("__l") > math.log(1e-8)
    median = logs.where(floor).agg(F.percentile("__l", F.lit(0.5)).alias("__m"))
    first = logs.crossJoin(F.broadcast(median)).withColumn("__ok", F.coalesce(floor & (F.col("__l") >= F.col("__m") - math.log(1e2)), F.lit(False)))
    kept = fenced(first.where("__ok"), "__l", [], k, lo, hi).select("chan", "inlier")
    return first.select("chan").join(kept, "chan", "left").select("chan", F.coalesce("inlier", F.lit(False)).alias("ok"))


def auto_mask(power: DataFrame, value: str = "p", k: float = 3.0, step: float = 0.2) -> DataFrame:
    """chan and ok: :func:`bad_channels` again and again on the channels left, each fence ``step`` wider.

    It ends when a round drops no channel, or none are left.  What a round
    keeps is an interval of log power, so that rounds hand on two numbers; the
    log power itself is computed once.
    """
    l = F.when(F.col(value) > 0, F.log(value))
    logs = settled(power.select("chan", l.alias("l")))
    lo, hi = math.nextafter(math.log(1e-8), math.inf), math.inf
    before = logs.count()
    while True:
        inside = logs.where(F.col("l").between(lo, hi))
        m = inside.agg(quantile("l", 0.5).alias("m")).first().m
        if m is None:
            break
        lo = max(lo, m - math.log(1e2))
        a, b = logs.where(F.col("l").between(lo, hi)).agg(quantile("l", 0.25), quantile("l", 0.75)).first()
        lo, hi = max(lo, a - k * (b - a)), min(hi, b + k * (b - a))
        left = logs.where(F.col("l").between(lo, hi)).count()
        if left in (0, before):
            break
        before, k = left, k + step
    return logs.select("chan", F.coalesce(F.col("l").between(lo, hi), F.lit(False)).alias("ok"))


def block_std(blocks: DataFrame) -> DataFrame:
    """chan, block_id, s, n: population deviation of each block."""
    return blocks.groupBy("chan", "block_id").agg(F.stddev_pop("x").alias("s"), F.count("x").alias("n"))


def safe_avg_power(blocks: DataFrame, k: float = 3.0, per_chan: bool = False) -> DataFrame:
    """chan, power, n_blocks: mean deviation of a channel's blocks without outlying ones."""
    cells = fenced(settled(block_std(blocks)), "s", ["chan"] if per_chan else [], k)
    return cells.where("inlier").groupBy("chan").agg(F.avg("s").alias("power"), F.count("*").alias("n_blocks"))


def pair_moments(blocks: DataFrame, how: str = "corr") -> DataFrame:
    """block_id, i, j, c for i <= j: correlation, covariance or semivariance of two channels in a block.

    ``blocks`` is chan, block_id, pos, x; channels meet on (block_id, pos).
    """
    a = blocks.select("block_id", "pos", F.col("chan").alias("i"), F.col("x").alias("a"))
    b = blocks.select("block_id", "pos", F.col("chan").alias("j"), F.col("x").alias("b"))
    joined = a.join(b, ["block_id", "pos"]).where("i <= j")
    agg = {"corr": F.corr("a", "b"), "cov": F.covar_samp("a", "b"), "semivar": F.var_pop(F.col("a") - F.col("b")) / 2}[how]
    return joined.groupBy("block_id", "i", "j").agg(agg.alias("c"))


def safe_pairs(blocks: DataFrame, how: str = "corr", k: float = 3.0) -> DataFrame:
    """i, j, c: mean over blocks whose matrix norm is no outlier."""
    cells = pair_moments(blocks, how)
    norms = cells.groupBy("block_id").agg(F.sum(F.when(F.col("i") == F.col("j"), F.pow("c", F.lit(2.0))).otherwise(2 * F.pow("c", F.lit(2.0)))).alias("s"))
    keep = fenced(norms, "s", [], k).where("inlier").select("block_id")
    return cells.join(keep, "block_id", "left_semi").groupBy("i", "j").agg(F.avg("c").alias("c"))


def mirror(pairs: DataFrame, value: str = "c") -> DataFrame:
    """Both triangles of an upper-triangular pair table."""
    return pairs.select("i", "j", value).unionByName(pairs.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), value))


def ar1_whiten(samples: DataFrame) -> DataFrame:
    """chan, t, e: residual of the regression on the sample before; the first has none."""
    before = F.lag("x").over(Window.partitionBy("chan").orderBy("t"))
    lagged = samples.withColumn("b", before)
    fit = lagged.where("b is not null").groupBy("chan").agg(F.regr_slope("x", "b").alias("m"), F.regr_intercept("x", "b").alias("c"))
    return lagged.where("b is not null").join(fit, "chan").select("chan", "t", (F.col("x") - F.col("m") * F.col("b") - F.col("c")).alias("e"))


def spatial_autocov(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """dy, dx, c, n: values of all site pairs by displacement, null-skipping mean."""
    full = mirror(pairs)
    a = sites.select(F.col("site").alias("i"), F.col("row").alias("r1"), F.col("col").alias("c1"))
    b = sites.select(F.col("site").alias("j"), F.col("row").alias("r2"), F.col("col").alias("c2"))
    moved = full.join(a, "i").join(b, "j").withColumn("dy", F.col("r2") - F.col("r1")).withColumn("dx", F.col("c2") - F.col("c1"))
    return moved.groupBy("dy", "dx").agg(F.avg("c").alias("c"), F.count("c").alias("n"))


def band_power(psd: DataFrame, fc: float, df: float, root: bool = True) -> DataFrame:
    """chan, power: sum below a cutoff frequency times the bin width."""
    p = F.pow("p", F.lit(2.0)) if root else F.col("p")
    return psd.where(F.col("freq") < fc).groupBy("chan").agg((F.sum(p) * df).alias("power"))


def box(df: DataFrame, value: str, by: list[str], k: float, clamp: bool = False) -> DataFrame:
    """Quartiles, whiskers and outliers of each group.

    Whiskers are the extreme inliers, or with ``clamp`` the extremes of all
    values moved to the fence where they are beyond it.
    """
    q = quantiles(df, value, by, q1=0.25, med=0.5, q3=0.75)
    v, span = F.col(value), F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - k * span, F.col("q3") + k * span
    inside = (v >= lo) & (v <= hi)
    agg = _joined(df, q, by).groupBy(*by, "q1", "med", "q3").agg(F.min(v if clamp else F.when(inside, v)).alias("lo"), F.max(v if clamp else F.when(inside, v)).alias("hi"), F.sum(F.when(inside, 0).otherwise(F.when(v.isNotNull(), 1))).alias("n_out"))
    if clamp:
        agg = agg.withColumn("lo", F.greatest("lo", lo)).withColumn("hi", F.least("hi", hi))
    return agg.withColumn("n_out", F.coalesce("n_out", F.lit(0)).cast("long"))


def limits(df: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """lo and hi quantiles of a column, as one row."""
    return df.agg(quantile(value, lo).alias("lo"), quantile(value, hi).alias("hi"))


def logged(power: DataFrame, sem: bool = False) -> tuple[DataFrame, DataFrame]:
    """Geometric mean over blocks by (chan, k), and over channels by k with its band."""
    by_chan = power.where("p > 0").groupBy("chan", "k").agg(F.avg(F.log("p")).alias("l"))
    width: Column = F.stddev_pop("l") / F.sqrt(F.count("l")) if sem else F.stddev_pop("l")
    band = by_chan.groupBy("k").agg(F.avg("l").alias("m"), width.alias("w"))
    band = band.select("k", F.exp("m").alias("grand"), F.exp(F.col("m") - F.col("w")).alias("lower"), F.exp(F.col("m") + F.col("w")).alias("upper"))
    return by_chan.select("chan", "k", F.exp("l").alias("p")), band
