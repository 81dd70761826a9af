"""Multitaper spectra from direct spectra: (keys, taper, k, re, im) rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions.columns import circular


def eigenvalues(spark: SparkSession, lam: np.ndarray) -> DataFrame:
    """taper, lam: one row per taper, a handful."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(lam)], "taper int, lam double")


def taper_rows(spark: SparkSession, tapers: np.ndarray) -> DataFrame:
    """taper, pos, v."""
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(tapers) for j, v in enumerate(row)], "taper int, pos int, v double")


def detrend(samples: DataFrame, keys: list[str], how: str = "constant", at: str = "t") -> DataFrame:
    """``samples`` less the mean or the regression line of each series."""
    if how == "constant":
        return samples.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy(*keys)))
    fit = samples.groupBy(*keys).agg(F.regr_slope("x", at).alias("__m"), F.regr_intercept("x", at).alias("__c"))
    return samples.join(fit, keys).withColumn("x", F.col("x") - F.col("__m") * F.col(at) - F.col("__c")).drop("__m", "__c")


def one_sided(p: Column, nfft: int, fs: float) -> Column:
    """Density scale: by half the rate between DC and the last bin, by the rate at both."""
    return F.when((F.col("k") == 0) | (F.col("k") == nfft // 2), p / fs).otherwise(p / (fs / 2))


def psd(sdf: DataFrame, lam: np.ndarray, keys: list[str], nfft: int, fs: float = 1.0) -> DataFrame:
    """keys, k, freq, p: eigenvalue-weighted mean of the tapers' power."""
    w = eigenvalues(sdf.sparkSession, lam)
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    p = sdf.join(F.broadcast(w), "taper").groupBy(*keys, "k").agg((F.sum(F.col("lam") * power) / F.sum("lam")).alias("p"))
    return p.select(*keys, "k", (F.col("k") * (fs / nfft)).alias("freq"), one_sided(F.col("p"), nfft, fs).alias("p"))


def log_jackknife(sdf: DataFrame, lam: np.ndarray, keys: list[str]) -> DataFrame:
    """keys, k, m, se: mean and error of the log spectrum's pseudovalues over tapers."""
    w = eigenvalues(sdf.sparkSession, lam)
    rows = sdf.join(F.broadcast(w), "taper").withColumn("wp", F.col("lam") * (F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    all_ = Window.partitionBy(*keys, "k")
    n = float(len(lam))
    s, l = F.sum("wp").over(all_), F.sum("lam").over(all_)
    pv = n * F.log(s / l) - (n - 1) * F.log((s - F.col("wp")) / (l - F.col("lam")))
    return rows.withColumn("pv", pv).groupBy(*keys, "k").agg(F.avg("pv").alias("m"), (F.stddev_pop("pv") / F.sqrt(F.lit(n - 1))).alias("se"))


def csd(sdf: DataFrame, lam: np.ndarray) -> DataFrame:
    """i, j, k, re, im for i <= j: eigenvalue-weighted cross spectra of channels."""
    w = eigenvalues(sdf.sparkSession, lam)
    rows = sdf.join(F.broadcast(w), "taper")
    a = rows.select("taper", "lam", "k", F.col("chan").alias("i"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = rows.select("taper", "k", F.col("chan").alias("j"), F.col("re").alias("br"), F.col("im").alias("bi"))
    re = F.sum(F.col("lam") * (F.col("ar") * F.col("br") + F.col("ai") * F.col("bi"))) / F.sum("lam")
    im = F.sum(F.col("lam") * (F.col("ai") * F.col("br") - F.col("ar") * F.col("bi"))) / F.sum("lam")
    return a.join(b, ["taper", "k"]).where("i <= j").groupBy("i", "j", "k").agg(re.alias("re"), im.alias("im"))


def cross_csd(one: DataFrame, two: DataFrame, lam: np.ndarray) -> DataFrame:
    """i, j, k, re, im: weighted cross spectra of each channel of ``one`` with each of ``two``."""
    w = eigenvalues(one.sparkSession, lam)
    a = one.join(F.broadcast(w), "taper").select("taper", "lam", "k", F.col("chan").alias("i"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = two.select("taper", "k", F.col("chan").alias("j"), F.col("re").alias("br"), F.col("im").alias("bi"))
    mean = lambda c: F.sum(F.col("lam") * c) / F.sum("lam")
    g = a.join(b, ["taper", "k"]).groupBy("i", "j", "k")
    return g.agg(mean(F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")).alias("re"), mean(F.col("ai") * F.col("br") - F.col("ar") * F.col("bi")).alias("im"))


def _products(sdf: DataFrame, lam: np.ndarray, seed: int | None) -> DataFrame:
    """i, j, k, taper and weighted products of channels i < j (one of them ``seed``, if given)."""
    w = eigenvalues(sdf.sparkSession, lam)
    a = sdf.join(F.broadcast(w), "taper").select("taper", "lam", "k", F.col("chan").alias("i"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = sdf.select("taper", "k", F.col("chan").alias("j"), F.col("re").alias("br"), F.col("im").alias("bi"))
    pairs = a.join(b, ["taper", "k"]).where("i < j")
    if seed is not None:
        pairs = pairs.where((F.col("i") == seed) | (F.col("j") == seed))
    l, ar, ai, br, bi = map(F.col, ("lam", "ar", "ai", "br", "bi"))
    return pairs.select("i", "j", "k", "taper", (l * (ar * br + ai * bi)).alias("re"), (l * (ai * br - ar * bi)).alias("im"), (l * (ar * ar + ai * ai)).alias("pa"), (l * (br * br + bi * bi)).alias("pb"))


def coherency(sdf: DataFrame, lam: np.ndarray, seed: int | None = None) -> DataFrame:
    """i, j, k, re, im for i < j: the complex coherence, within the unit circle; NULL without power."""
    t = _products(sdf, lam, seed).groupBy("i", "j", "k").agg(*[F.sum(c).alias(c) for c in ("re", "im", "pa", "pb")])
    size = F.sqrt(F.nullif(F.col("pa") * F.col("pb"), F.lit(0.0)))
    re, im = circular(F.col("re") / size, F.col("im") / size)
    return t.select("i", "j", "k", re.alias("re"), im.alias("im"))


def coherence_interval(sdf: DataFrame, lam: np.ndarray, t: float, fisher: bool = False, seed: int | None = None) -> DataFrame:
    """i, j, k, msc, lo, hi for i < j: squared coherence and its jackknife interval over tapers.

    ``t`` is the quantile that the standard error is taken by; with ``fisher``
    the jackknife works on the inverse hyperbolic tangent.  Bounds stay in 0 to 1.
    """
    rows = _products(sdf, lam, seed)
    over = Window.partitionBy("i", "j", "k")
    total = {c: F.sum(c).over(over) for c in ("re", "im", "pa", "pb")}

    def estimate(re: Column, im: Column, pa: Column, pb: Column) -> Column:
        msc = F.least((re * re + im * im) / F.nullif(pa * pb, F.lit(0.0)), F.lit(1.0))
        return F.atanh(F.least(msc, F.lit(1 - 1e-12))) if fisher else msc

    each = rows.select("i", "j", "k", estimate(*total.values()).alias("z"), estimate(*[v - F.col(c) for c, v in total.items()]).alias("out"))
    g = each.groupBy("i", "j", "k").agg(F.first("z").alias("z"), F.sqrt((F.count("out") - 1) * F.var_pop("out")).alias("e"))
    back = lambda c: F.least(F.greatest(F.tanh(c) if fisher else c, F.lit(0.0)), F.lit(1.0))
    return g.select("i", "j", "k", back(F.col("z")).alias("msc"), back(F.col("z") - t * F.col("e")).alias("lo"), back(F.col("z") + t * F.col("e")).alias("hi"))


def scaled_csd(cross: DataFrame, fs: float = 1.0, nfft: int | None = None, consistent: bool = False) -> DataFrame:
    """Cross spectra as densities: by the rate, doubled for every bin but DC.

    So the last bin is doubled too, unlike in :func:`psd`; ``consistent``
    leaves it single.
    """
    single = (F.col("k") == 0) | (F.col("k") == (nfft or 0) // 2 if consistent else F.lit(False))
    f = F.when(single, 1.0).otherwise(2.0) / fs
    return cross.select("i", "j", "k", (F.col("re") * f).alias("re"), (F.col("im") * f).alias("im"))


def coherence(cross: DataFrame, seed: int | None = None) -> DataFrame:
    """i, j, k, msc for i < j: squared magnitude over the two powers, at most 1."""
    own = cross.where("i = j").select(F.col("i").alias("c"), "k", F.col("re").alias("p"))
    pairs = cross.where("i < j") if seed is None else cross.where((F.col("i") < F.col("j")) & ((F.col("i") == seed) | (F.col("j") == seed)))
    pi, pj = own.select(F.col("c").alias("i"), "k", F.col("p").alias("pi")), own.select(F.col("c").alias("j"), "k", F.col("p").alias("pj"))
    msc = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("pi") * F.col("pj"))
    return pairs.join(pi, ["i", "k"]).join(pj, ["j", "k"]).select("i", "j", "k", F.least(msc, F.lit(1.0)).alias("msc"))


def semiherence(cross: DataFrame, fmax: int | None = None) -> DataFrame:
    """i, j, k, s: mean power of two channels less the real cross power, at least 0."""
    own = cross.where("i = j").select(F.col("i").alias("c"), "k", F.col("re").alias("p"))
    pi, pj = own.select(F.col("c").alias("i"), "k", F.col("p").alias("pi")), own.select(F.col("c").alias("j"), "k", F.col("p").alias("pj"))
    pairs = cross.where("i < j") if fmax is None else cross.where((F.col("i") < F.col("j")) & (F.col("k") < fmax))
    s = (F.col("pi") + F.col("pj")) / 2 - F.abs("re")
    return pairs.join(pi, ["i", "k"]).join(pj, ["j", "k"]).select("i", "j", "k", F.greatest(s, F.lit(0.0)).alias("s"))


def demodulate(sdf: DataFrame, lam: np.ndarray, tapers: np.ndarray, step: int) -> DataFrame:
    """chan, k, pt, re, im: band-limited envelope at points midway between ``step`` samples."""
    n = tapers.shape[1]
    rows = []
    for pt in range(n // step):
        at = int((pt + 0.5) * step)
        v = tapers[:, at] if step % 2 == 0 else (tapers[:, at] + tapers[:, at + 1]) / 2
        rows += [(i, pt, float(v[i] * np.sqrt(lam[i]))) for i in range(len(lam))]
    base = sdf.sparkSession.createDataFrame(rows, "taper int, pt int, g double")
    joined = sdf.join(F.broadcast(base), "taper")
    return joined.groupBy("chan", "k", "pt").agg(F.sum(F.col("re") * F.col("g")).alias("re"), F.sum(F.col("im") * F.col("g")).alias("im"))


def triple_products(demod: DataFrame, nf: int, scale: float) -> DataFrame:
    """chan, f1, f2, pt, re, im: x(f1) x(f2) conj x(f1 + f2) for f2 <= f1, f1 + f2 < nf."""
    a = demod.select("chan", "pt", F.col("k").alias("f1"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = demod.select("chan", "pt", F.col("k").alias("f2"), F.col("re").alias("br"), F.col("im").alias("bi"))
    c = demod.select("chan", "pt", F.col("k").alias("f3"), F.col("re").alias("cr"), F.col("im").alias("ci"))
    ab = a.join(b, ["chan", "pt"]).where((F.col("f2") <= F.col("f1")) & (F.col("f1") + F.col("f2") < nf)).withColumn("f3", F.col("f1") + F.col("f2"))
    re = F.col("ar") * F.col("br") - F.col("ai") * F.col("bi")
    im = F.col("ar") * F.col("bi") + F.col("ai") * F.col("br")
    j = ab.withColumn("pr", re).withColumn("pi", im).join(c, ["chan", "pt", "f3"])
    return j.select("chan", "f1", "f2", "pt", (scale * (F.col("pr") * F.col("cr") + F.col("pi") * F.col("ci"))).alias("re"), (scale * (F.col("pi") * F.col("cr") - F.col("pr") * F.col("ci"))).alias("im"))


def bispectrum(products: DataFrame) -> DataFrame:
    """chan, f1, f2, re, im, bic: mean triple product and the bicoherence ratio."""
    m = products.groupBy("chan", "f1", "f2").agg(F.avg("re").alias("re"), F.avg("im").alias("im"), F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("q"))
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return m.select("chan", "f1", "f2", "re", "im", (size / F.sqrt(F.nullif("q", F.lit(0.0)))).alias("bic"))


def dual_spectrum(sdf: DataFrame, one: int, two: int, fmax: int | None = None) -> DataFrame:
    """f1, f2, msc: coherence over tapers between frequencies of two channels."""
    rows = sdf if fmax is None else sdf.where(F.col("k") < fmax)
    a = rows.where(F.col("chan") == one).select("taper", F.col("k").alias("f1"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = rows.where(F.col("chan") == two).select("taper", F.col("k").alias("f2"), F.col("re").alias("br"), F.col("im").alias("bi"))
    g = a.join(b, "taper").groupBy("f1", "f2").agg(
        F.sum(F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")).alias("re"), F.sum(F.col("ai") * F.col("br") - F.col("ar") * F.col("bi")).alias("im"),
        F.sum(F.col("ar") * F.col("ar") + F.col("ai") * F.col("ai")).alias("pa"), F.sum(F.col("br") * F.col("br") + F.col("bi") * F.col("bi")).alias("pb"),
    )
    return g.select("f1", "f2", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("pa") * F.col("pb"))).alias("msc"))


def normalised(power: DataFrame, baseline: Column) -> DataFrame:
    """block_id, k, z: trial mean of log power in deviations of the baseline blocks'."""
    logs = power.where("p > 0").withColumn("l", F.log("p"))
    base = logs.where(baseline).groupBy("k").agg(F.avg("l").alias("m"), F.stddev_pop("l").alias("s"))
    return logs.groupBy("block_id", "k").agg(F.avg("l").alias("l")).join(base, "k").select("block_id", "k", ((F.col("l") - F.col("m")) / F.col("s")).alias("z"))
