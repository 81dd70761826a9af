"""Bootstrap and jackknife as joins and grouped sums.

Draws come from a counter-based generator on (replicate, position), so they
are the same on every machine and need no state; several arrays resampled by
the same draws stay aligned.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions.columns import lcg


def draws(positions: DataFrame, n: int, reps: int, seed: int = 0) -> DataFrame:
    """rep, pos, idx: for each replicate and place, the position that is drawn."""
    rep = F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))
    return positions.select("pos").withColumn("rep", rep).withColumn("idx", lcg(F.col("rep") + seed, F.col("pos")) % n)


def resampled(data: DataFrame, n: int, reps: int, seed: int = 0) -> DataFrame:
    """rep, pos and the drawn rows' values: all columns of ``data`` but pos."""
    d = draws(data, n, reps, seed)
    return d.join(data.withColumnRenamed("pos", "idx"), "idx")


def weighted_draws(weights: DataFrame, size: int, reps: int) -> DataFrame:
    """rep, k, pos: draws with given probabilities, by the interval a uniform falls in.

    ``weights`` is pos, w of bounded size (one array); cumulative shares are
    joined to the draws on a grid of shares, then compared.
    """
    cum = weights.withColumn("b", F.expr("sum(w) over (order by pos)") / F.expr("sum(w) over ()")).withColumn("a", F.expr("coalesce(lag(b) over (order by pos), 0D)"))
    grid = 64
    cells = cum.withColumn("cell", F.explode(F.sequence(F.floor(F.col("a") * grid), F.floor(F.col("b") * grid))))
    u = weights.sparkSession.range(size).select(F.col("id").alias("k")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("u", lcg(F.col("rep"), F.col("k")) / F.lit(2147483647.0))
    return u.withColumn("cell", F.floor(F.col("u") * grid)).join(cells, "cell").where("u >= a and u < b").select("rep", "k", "pos")


def estimate(data: DataFrame, n: int, reps: int, statistic: Column, ci: float | None = 0.95) -> DataFrame:
    """theta, mean, lo, hi (or se without ``ci``): a statistic and its bootstrap."""
    theta = resampled(data, n, reps).groupBy("rep").agg(statistic.alias("th"))
    out = [F.avg("th").alias("mean")]
    out += [F.percentile("th", F.lit((1 - ci) / 2)).alias("lo"), F.percentile("th", F.lit((1 + ci) / 2)).alias("hi")] if ci else [F.stddev_pop("th").alias("se")]
    return data.agg(statistic.alias("theta")).crossJoin(F.broadcast(theta.agg(*out)))


def _applied(samples: DataFrame, by: list[str], values: list[str], estimator: Column | Callable, e_args: dict) -> DataFrame:
    """by, th: the estimator of each group, a Column or a function of the values' arrays in order of pos."""
    if isinstance(estimator, Column):
        return (samples.groupBy(*by) if by else samples.groupBy()).agg(estimator.alias("th"))
    if not by:
        return _applied(samples.withColumn("__one", F.lit(1)), ["__one"], values, estimator, e_args).drop("__one")
    types = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in by)

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        return pd.DataFrame([[*key, float(estimator(*[group[v].to_numpy() for v in values], **e_args))]], columns=[*by, "th"])

    return samples.select(*by, "pos", *values).groupBy(*by).applyInPandas(one, f"{types}, th double")


class Bootstrap:
    """Resamples of one or several arrays, all by the same draws along one axis.

    ``data`` is pos (0 to n - 1, the resampled axis), ``values`` (the arrays)
    and ``keys`` (the other axes).  ``size`` draws a replicate, ``n`` unless
    given; ``proba`` (pos, w) draws by weight.  Estimators are aggregate
    Columns, which stay in the JVM, or functions of the arrays, which are
    called once for each replicate and key.
    """

    def __init__(self, data: DataFrame, values: list[str], reps: int, keys: list[str] | None = None, size: int | None = None, proba: DataFrame | None = None, seed: int = 0):
        self.data, self.values, self.keys, self.reps, self.seed, self.proba = data, values, keys or [], reps, seed, proba
        self.n = data.select("pos").distinct().count()
        self.size = size or self.n

    def draws(self) -> DataFrame:
        """rep, pos, idx: which place each place of a replicate takes."""
        if self.proba is not None:
            return weighted_draws(self.proba, self.size, self.reps).select("rep", F.col("k").alias("pos"), F.col("pos").alias("idx"))
        return draws(self.data.sparkSession.range(self.size).select(F.col("id").alias("pos")), self.n, self.reps, self.seed)

    def samples(self) -> DataFrame:
        """rep, pos, keys and values of every replicate."""
        return self.draws().join(self.data.select(F.col("pos").alias("idx"), *self.keys, *self.values), "idx").select("rep", "pos", *self.keys, *self.values)

    def all_samples(self, estimator: Column | Callable, **e_args) -> DataFrame:
        """rep, keys, th: the estimator of each replicate."""
        return _applied(self.samples(), ["rep", *self.keys], self.values, estimator, e_args)

    def estimate(self, estimator: Column | Callable, ci: float | None = 0.95, **e_args) -> DataFrame:
        """keys, theta, mean, and lo and hi by percentile, or without ``ci`` se."""
        theta = _applied(self.data, self.keys, self.values, estimator, e_args).withColumnRenamed("th", "theta")
        out = [F.avg("th").alias("mean")]
        out += [F.percentile("th", F.lit((1 - ci) / 2)).alias("lo"), F.percentile("th", F.lit((1 + ci) / 2)).alias("hi")] if ci else [F.stddev_pop("th").alias("se")]
        found = self.all_samples(estimator, **e_args).groupBy(*self.keys).agg(*out)
        return theta.join(found, self.keys) if self.keys else theta.crossJoin(F.broadcast(found))  # one row each


def unranked(k: int, n: int, r: int) -> list[int]:
    """The ``k``-th r-subset of range(n) in lexicographic order."""
    out, at = [], 0
    for left in range(r, 0, -1):
        while k >= (here := math.comb(n - at - 1, left - 1)):
            k, at = k - here, at + 1
        out.append(at)
        at += 1
    return out


class Jackknife:
    """Replicates that leave ``n_out`` places out, of data as in :class:`Bootstrap`.

    Replicates are numbered in lexicographic order of the places left out, the
    first place first; with ``max_samples`` they are that many distinct random
    ones.  Which places a replicate leaves out follows from its number, on the
    machine that makes it.
    """

    def __init__(self, data: DataFrame, values: list[str], n_out: int = 1, keys: list[str] | None = None, max_samples: int | None = None, seed: int = 1):
        self.data, self.values, self.keys, self.n_out = data, values, keys or [], n_out
        self.n = data.select("pos").distinct().count()
        self.reps = max_samples or math.comb(self.n, n_out)
        self.picked = random_combinations(self.n, n_out, max_samples, seed) if max_samples else None

    def left_out(self) -> DataFrame:
        """rep, pos: the places that each replicate leaves out."""
        spark, n, r = self.data.sparkSession, self.n, self.n_out
        if self.picked is not None:
            return spark.createDataFrame([(k, p) for k, c in enumerate(self.picked) for p in c], "rep long, pos long")
        out = F.pandas_udf(lambda k: k.map(lambda x: unranked(int(x), n, r)), "array<long>")
        return spark.range(self.reps).select(F.col("id").alias("rep"), F.explode(out("id")).alias("pos"))

    def samples(self) -> DataFrame:
        """rep, pos, keys and values of every replicate."""
        every = self.data.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.reps - 1).cast("long"))))
        return every.join(self.left_out(), ["rep", "pos"], "left_anti").select("rep", "pos", *self.keys, *self.values)

    def all_samples(self, estimator: Column | Callable, **e_args) -> DataFrame:
        """rep, keys, th."""
        return _applied(self.samples(), ["rep", *self.keys], self.values, estimator, e_args)

    def pseudovals(self, estimator: Column | Callable, **e_args) -> DataFrame:
        """rep, keys, th, theta, pv."""
        theta = _applied(self.data, self.keys, self.values, estimator, e_args).withColumnRenamed("th", "theta")
        th = self.all_samples(estimator, **e_args)
        both = th.join(theta, self.keys) if self.keys else th.crossJoin(F.broadcast(theta))  # one row
        return both.withColumn("pv", F.lit(self.n / self.n_out) * F.col("theta") - F.lit((self.n - self.n_out) / self.n_out) * F.col("th"))

    def estimate(self, estimator: Column | Callable, correct_bias: bool = True, **e_args) -> DataFrame:
        """keys, est, se: of pseudovalues, or of the replicates themselves."""
        v = self.pseudovals(estimator, **e_args).groupBy(*self.keys)
        if correct_bias:
            return v.agg(F.avg("pv").alias("est"), (F.stddev_pop("pv") / F.sqrt(F.count("pv") - 1)).alias("se"))
        return v.agg(F.avg("th").alias("est"), (F.sqrt(F.count("th") - 1) * F.stddev_pop("th")).alias("se"))

    def bias(self, estimator: Column | Callable, **e_args) -> DataFrame:
        """keys, bias: the estimate less the mean of its pseudovalues."""
        return self.pseudovals(estimator, **e_args).groupBy(*self.keys).agg((F.first("theta") - F.avg("pv")).alias("bias"))

    def variance(self, estimator: Column | Callable, **e_args) -> DataFrame:
        """keys, v."""
        return self.all_samples(estimator, **e_args).groupBy(*self.keys).agg((F.lit(float(self.n - 1)) * F.var_pop("th")).alias("v"))


def jackknife_std(data: DataFrame) -> DataFrame:
    """pos, th, theta, pv, n: leave-one-out deviations and pseudovalues, in one pass of sums."""
    t = data.agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    x = data.crossJoin(F.broadcast(t))
    m = F.col("n") - 1
    th = F.sqrt(F.greatest((F.col("q") - F.col("x") * F.col("x")) / m - F.pow((F.col("s") - F.col("x")) / m, F.lit(2.0)), F.lit(0.0)))
    theta = F.sqrt(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0)))
    return x.select("pos", "n", th.alias("th"), theta.alias("theta")).withColumn("pv", F.col("n") * F.col("theta") - (F.col("n") - 1) * F.col("th"))


def jackknife_mean_d2(data: DataFrame) -> DataFrame:
    """i, j, th, pv of the mean without each pair of places."""
    t = data.agg(F.count("x").alias("n"), F.sum("x").alias("s"))
    a, b = data.select(F.col("pos").alias("i"), F.col("x").alias("a")), data.select(F.col("pos").alias("j"), F.col("x").alias("b"))
    p = a.join(b, F.col("i") < F.col("j")).crossJoin(F.broadcast(t))
    th = (F.col("s") - F.col("a") - F.col("b")) / (F.col("n") - 2)
    return p.select("i", "j", "n", th.alias("th"), (F.col("n") / 2 * F.col("s") / F.col("n") - (F.col("n") - 2) / 2 * th).alias("pv"))


def summary(pseudo: DataFrame) -> DataFrame:
    """est and se of pseudovalues."""
    return pseudo.agg(F.avg("pv").alias("est"), (F.stddev_pop("pv") / F.sqrt(F.count("pv") - 1)).alias("se"))


def t_test(x: DataFrame, y: DataFrame, nx: int, ny: int, reps: int) -> DataFrame:
    """t and p: Welch's statistic with population variances, and the share of
    recentred bootstrap statistics at least as far from 0."""
    moments = lambda d, p: d.agg(F.avg("x").alias(f"m{p}"), F.var_pop("x").alias(f"v{p}"), F.sum("x").alias(f"s{p}"))
    full = moments(x, "x").crossJoin(moments(y, "y"))
    t = lambda mx, vx, my, vy: (F.col(mx) - F.col(my)) / F.sqrt(F.col(vx) / nx + F.col(vy) / ny)
    whole = full.select(t("mx", "vx", "my", "vy").alias("t"), F.col("mx").alias("cx"), F.col("my").alias("cy"))
    by = lambda d, n, p, seed: resampled(d, n, reps, seed).groupBy("rep").agg(F.avg("x").alias(f"m{p}"), F.var_pop("x").alias(f"v{p}"))
    both = by(x, nx, "x", 0).join(by(y, ny, "y", 1000), "rep").crossJoin(F.broadcast(whole))
    # recentring on the pooled mean only moves the means
    star = ((F.col("mx") - F.col("cx")) - (F.col("my") - F.col("cy"))) / F.sqrt(F.col("vx") / nx + F.col("vy") / ny)
    return both.groupBy("t").agg(F.avg((F.abs(star) >= F.abs("t")).cast("double")).alias("p"))


def random_combinations(n: int, r: int, count: int, seed: int = 1) -> list[tuple[int, ...]]:
    """``count`` distinct r-subsets of range(n), by one keyed draw."""
    if count > math.comb(n, r):
        raise ValueError(f"there are only {math.comb(n, r)} subsets")
    rng, found = random.Random(seed), set()
    while len(found) < count:
        found.add(tuple(sorted(rng.sample(range(n), r))))
    return sorted(found)
