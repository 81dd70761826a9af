"""Queries on site pairs, variograms and covariance models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from chorale.functions.columns import quantile, rounded
from chorale.functions.special import matern
from chorale.operators import spatial
from chorale.plans.base import query
from chorale.plans.duck import FIELD, SITES
from chorale.sources import tables

R = rounded
THETA, NU, SILL, NUGGET, KAPPA = 2.0, 1.5, 1.2, 0.2, 0.1
_Z = f"({math.sqrt(3) / THETA!r}::DOUBLE * dist)"
_RHO = f"((1 + {_Z}) * exp(-{_Z}))"
_P = SITES + ", pairs AS (SELECT a.site AS i, b.site AS j, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 5) AS dist FROM sites a JOIN sites b ON a.site < b.site)"
_D = f"{FIELD}, {_P}, df AS (SELECT i, j, dist, a.sample, a.v - b.v AS d FROM field a JOIN field b ON a.sample = b.sample JOIN pairs ON i = a.site AND j = b.site)"
_E = f"{FIELD}, {_P}, ce AS (SELECT site, sample, v - avg(v) OVER (PARTITION BY sample) AS v FROM field), q AS (SELECT quantile_cont(v, 0.25) a, quantile_cont(v, 0.75) b FROM ce), kp AS (SELECT ce.* FROM ce, q WHERE v BETWEEN a - 4 * (b - a) AND b + 4 * (b - a)), cv AS (SELECT a.site AS i, b.site AS j, sum(a.v * b.v) / count(*) AS c FROM kp a JOIN kp b ON a.sample = b.sample AND a.site <= b.site GROUP BY ALL), er AS (SELECT cv.i, cv.j, cv.c, a.c AS vi, b.c AS vj FROM cv JOIN cv a ON a.i = cv.i AND a.j = cv.i JOIN cv b ON b.i = cv.j AND b.j = cv.j)"
_CL = f"{_D}, cl AS (SELECT i, j, dist, var_pop(d) / 2 AS sv FROM df GROUP BY ALL), bn AS (SELECT floor(dist) AS xb, sv AS y FROM cl)"


def _pairs(s, d):
    return spatial.site_pairs(tables.sites(s, d))


def _diffs(s, d):
    return spatial.differences(tables.field(s, d), _pairs(s, d))


def _cloud(s, d):
    return _diffs(s, d).groupBy("i", "j", "dist").agg((F.var_pop("d") / 2).alias("sv"))


def _binned(s, d):
    return _cloud(s, d).select(F.floor("dist").cast("double").alias("xb"), F.col("sv").alias("y"))


def _lag(s, d, how, k=4.0):
    return spatial.semivariogram(_diffs(s, d), how, k).select("dist", R("sv", 5).alias("sv"), "n", R("se", 5).alias("se"))


_SE = "count(d) AS n, round(stddev_pop(d * d / 2) / sqrt(count(d)), 5) + 0.0 AS se"


@query(f"WITH {_P} SELECT i, j, dist FROM pairs")
def site_pairs(s, d):
    return _pairs(s, d)


@query(f"WITH {_D} SELECT dist, round(avg(d * d / 2), 5) + 0.0 AS sv, {_SE} FROM df GROUP BY dist")
def semivariogram(s, d):
    return _lag(s, d, "classical")


@query(f"WITH {_D} SELECT dist, round(power(avg(sqrt(abs(d))), 4) / 2 / (0.457 + 0.494 / count(d)), 5) + 0.0 AS sv, {_SE} FROM df GROUP BY dist")
def semivariogram_robust(s, d):
    return _lag(s, d, "robust")


@query(f"WITH {_D}, q AS (SELECT dist, quantile_cont(d, 0.25) a, quantile_cont(d, 0.75) b FROM df GROUP BY dist) SELECT dist, round(avg(d * d / 2), 5) + 0.0 AS sv, {_SE} FROM df JOIN q USING (dist) WHERE d BETWEEN a - (b - a) AND b + (b - a) GROUP BY dist")
def semivariogram_trimmed(s, d):
    return _lag(s, d, "trimmed", 1.0)


@query(f"WITH {_CL} SELECT i, j, dist, round(sv, 5) + 0.0 AS sv FROM cl")
def variogram_cloud(s, d):
    return _cloud(s, d).select("i", "j", "dist", R("sv", 5).alias("sv"))


@query(f"WITH {_D} SELECT i, j, round(avg(d * d) / 2, 5) + 0.0 AS sv FROM df GROUP BY ALL")
def pairwise_semivar(s, d):
    return _diffs(s, d).groupBy("i", "j").agg(R(F.avg(F.col("d") * F.col("d")) / 2, 5).alias("sv"))


@query(f"WITH {_E} SELECT i, j, round((vi + vj) / 2 - c, 5) + 0.0 AS sv FROM er WHERE i < j")
def ergodic_semivar(s, d):
    return spatial.ergodic(tables.field(s, d)).where("i < j").select("i", "j", R((F.col("vi") + F.col("vj")) / 2 - F.col("c"), 5).alias("sv"))


@query(f"WITH {_E} SELECT i, j, round(c, 5) + 0.0 AS c FROM er")
def ergodic_covar(s, d):
    return spatial.ergodic(tables.field(s, d)).select("i", "j", R("c", 5).alias("c"))


@query(f"WITH {_E} SELECT dist, round(avg((vi + vj) / 2 - c), 5) + 0.0 AS sv, count(*) AS n FROM er JOIN pairs USING (i, j) GROUP BY dist")
def fast_semivariogram(s, d):
    e = spatial.ergodic(tables.field(s, d)).where("i < j").join(_pairs(s, d), ["i", "j"])
    return e.groupBy("dist").agg(R(F.avg((F.col("vi") + F.col("vj")) / 2 - F.col("c")), 5).alias("sv"), F.count("*").alias("n"))


@query()
def adapt_bins(s, d):
    return spatial.adapt_bins(s, _pairs(s, d), 1.0).select("dist", R("bin").alias("bin"))


@query(f"WITH {_CL} SELECT xb, count(*) AS n, round(sum(y), 4) + 0.0 AS s FROM bn GROUP BY xb")
def binned(s, d):
    return _binned(s, d).groupBy("xb").agg(F.count("*").alias("n"), R(F.sum("y"), 4).alias("s"))


@query(f"WITH {_CL} SELECT xb, round(avg(y), 5) + 0.0 AS m, round(quantile_cont(y, 0.5), 5) + 0.0 AS med, round(stddev_pop(y) / sqrt(count(*)), 5) + 0.0 AS sem, round(stddev_pop(y), 5) + 0.0 AS sd, round(quantile_cont(y, 0.25), 5) + 0.0 AS q1, round(quantile_cont(y, 0.75), 5) + 0.0 AS q3 FROM bn GROUP BY xb HAVING count(*) >= 3")
def binned_agg(s, d):
    g = _binned(s, d).groupBy("xb").agg(F.count("*").alias("n"), R(F.avg("y"), 5).alias("m"), R(quantile("y", 0.5), 5).alias("med"), R(F.stddev_pop("y") / F.sqrt(F.count("*")), 5).alias("sem"), R(F.stddev_pop("y"), 5).alias("sd"), R(quantile("y", 0.25), 5).alias("q1"), R(quantile("y", 0.75), 5).alias("q3"))
    return g.where("n >= 3").drop("n")


@query()
def subsample_bins(s, d):
    return spatial.subsample(_binned(s, d), F.xxhash64("xb", "y")).select("xb", R("y", 5).alias("y"))


@query()
def resample_bins(s, d):
    return spatial.resample(_binned(s, d), 10, 0.5).select("xb", R("y", 5).alias("y"))


@query(f"WITH {_CL}, g AS (SELECT xb, list(y) AS ys FROM bn GROUP BY xb) SELECT xb, round(unnest(ys), 5) + 0.0 AS y FROM g")
def concat_bins(s, d):
    g = _binned(s, d).groupBy("xb").agg(F.collect_list("y").alias("ys"))
    return g.select("xb", F.explode("ys").alias("y")).select("xb", R("y", 5).alias("y"))


@query(f"WITH {_P} SELECT DISTINCT dist, round(exp(-dist / {THETA}), 9) + 0.0 AS r05, round({_RHO}, 9) + 0.0 AS r15 FROM pairs")
def matern_corr(s, d):
    x = _pairs(s, d).select("dist").distinct()
    return x.select("dist", R(spatial.matern_half(F.col("dist"), THETA, 0.5), 9).alias("r05"), R(spatial.matern_half(F.col("dist"), THETA, 1.5), 9).alias("r15"))


_CONST = 4 * math.pi * math.gamma(NU + 1) * (2 * NU) ** NU / math.gamma(NU) / THETA ** (2 * NU)


@query(f"SELECT DISTINCT l_discount AS k, round({_CONST!r}::DOUBLE / power({2 * NU / THETA**2} + 4 * pi() * pi() * l_discount * l_discount, {NU + 1}), 6) + 0.0 AS p FROM lineitem")
def matern_spec(s, d):
    k = tables.load(s, d, "lineitem").select(F.col("l_discount").alias("k")).distinct()
    return k.select("k", R(spatial.matern_spectrum(F.col("k"), THETA, NU)).alias("p"))


@query(f"SELECT n_nationkey AS k, round(1 / (2 * sqrt((2 * {NU} / power(n_nationkey + 1, 2)) * (power(10, 2.0 / ({NU} + 1)) - 1) / (4 * pi() * pi()))), 6) + 0.0 AS dens FROM nation")
def matern_nyquist(s, d):
    t = tables.load(s, d, "nation")
    return t.select(F.col("n_nationkey").alias("k"), R(spatial.matern_nyquist((F.col("n_nationkey") + 1).cast("double"), NU)).alias("dens"))


@query(f"WITH {_P}, c AS (SELECT i, j, {SILL - NUGGET} * {_RHO} + {KAPPA} AS c FROM pairs) SELECT i, j, round(c, 6) + 0.0 AS c FROM c UNION ALL SELECT j, i, round(c, 6) + 0.0 FROM c UNION ALL SELECT site, site, round({SILL + KAPPA}::DOUBLE, 6) FROM sites")
def matern_cov(s, d):
    p = _pairs(s, d).withColumn("c", (SILL - NUGGET) * spatial.matern_half(F.col("dist"), THETA, NU) + KAPPA)
    c = R("c").alias("c")
    own = tables.sites(s, d).select(F.col("site").alias("i"), F.col("site").alias("j"), F.round(F.lit(SILL + KAPPA), 6).alias("c"))
    return p.select("i", "j", c).unionByName(p.select(F.col("j").alias("i"), F.col("i").alias("j"), c)).unionByName(own)


@query(f"WITH {_P} SELECT DISTINCT dist, round({SILL - NUGGET} * (1 - {_RHO}) + {NUGGET}, 6) + 0.0 AS g FROM pairs")
def matern_variogram(s, d):
    x = _pairs(s, d).select("dist").distinct()
    return x.select("dist", R((SILL - NUGGET) * (1 - spatial.matern_half(F.col("dist"), THETA, NU)) + NUGGET).alias("g"))


@query()
def matern_sim(s, d):
    sites = [(r.site, r.x, r.y) for r in tables.sites(s, d).orderBy("site").collect()]
    return spatial.simulate(s, sites, THETA, NU, 200).select("site", "sample", R("v").alias("v"))


def _fit(s, d):
    """The model, from lag means and counts that Spark aggregates."""
    rows = spatial.semivariogram(_diffs(s, d)).orderBy("dist").collect()
    x, y, n = (np.array([getattr(r, c) for r in rows], dtype=float) for c in ("dist", "sv", "n"))
    return spatial.fit_matern(x, y, n / n.sum())


@query()
def matern_fit(s, d):
    p = _fit(s, d)
    return s.createDataFrame([tuple(round(float(p[k]), 6) for k in ("theta", "nu", "nugget", "sill", "loss"))], "theta double, nu double, nugget double, sill double, loss double")


@query()
def eff_range(s, d):
    p = _fit(s, d)
    level = p["nugget"] + 0.95 * (p["sill"] - p["nugget"])
    return s.createDataFrame([(round(spatial.effective_range(p, level), 4), round(level, 4))], "x double, level double")


_EXP = f"{FIELD}, {_P}, pc AS (SELECT a.site AS i, b.site AS j, corr(a.v, b.v) AS c FROM field a JOIN field b ON a.sample = b.sample AND a.site < b.site GROUP BY ALL), l AS (SELECT dist, -ln(abs(c)) AS l FROM pc JOIN pairs USING (i, j) WHERE c <> 0), w AS (SELECT dist, count(*) AS n, var_pop(l) AS v FROM l GROUP BY dist), w2 AS (SELECT dist, CASE WHEN n > 10 THEN v ELSE (SELECT max(v) FROM w WHERE n > 10) END AS v FROM w)"


def _exp_rows(s, d):
    """dist, l, w: negative log correlation by lag, weighted by its lag's inverse variance."""
    f = tables.field(s, d)
    a, b = f.select(F.col("site").alias("i"), "sample", F.col("v").alias("a")), f.select(F.col("site").alias("j"), "sample", F.col("v").alias("b"))
    c = a.join(b, "sample").where("i < j").groupBy("i", "j").agg(F.corr("a", "b").alias("c")).join(_pairs(s, d), ["i", "j"]).where("c != 0")
    l = c.select("dist", "c", (-F.log(F.abs("c"))).alias("l"))
    w = l.groupBy("dist").agg(F.count("*").alias("n"), F.var_pop("l").alias("v"))
    top = w.where("n > 10").agg(F.max("v").alias("top"))
    w = w.crossJoin(F.broadcast(top)).select("dist", F.when(F.col("n") > 10, F.col("v")).otherwise(F.col("top")).alias("v"))
    return l.join(F.broadcast(w), "dist").withColumn("w", 1 / F.col("v"))


@query(f"WITH {_EXP} SELECT round(sum(dist * dist / v) / sum(dist * l / v), 6) + 0.0 AS lam FROM l JOIN w2 USING (dist)")
def exp_fit(s, d):
    e = _exp_rows(s, d)
    return e.agg(R(F.sum(F.col("w") * F.col("dist") * F.col("dist")) / F.sum(F.col("w") * F.col("dist") * F.col("l"))).alias("lam"))


@query()
def exp_fit_nonlinear(s, d):
    """Gauss-Newton on the scale of |c| = exp(-dist / lam), from lag sums."""
    rows = [(r.dist, r.n, r.m) for r in _exp_rows(s, d).groupBy("dist").agg(F.count("*").alias("n"), F.avg(F.abs("c")).alias("m")).orderBy("dist").collect()]
    x, n, m = (np.array(v, dtype=float) for v in zip(*rows, strict=True))
    lam = 1.0
    for _ in range(200):
        g = np.exp(-x / lam)
        slope = g * x / lam**2
        step = (n * slope * (m - g)).sum() / max((n * slope * slope).sum(), 1e-300)
        lam = min(max(lam + max(-lam / 2, min(lam, step)), 1e-3), 1e3)
        if abs(step) < 1e-12:
            break
    return s.createDataFrame([(round(float(lam), 6),)], "lam double")


@query(f"WITH {_CL} SELECT dist, round(quantile_cont(sv, 0.25), 5) + 0.0 AS q1, round(quantile_cont(sv, 0.5), 5) + 0.0 AS med, round(quantile_cont(sv, 0.75), 5) + 0.0 AS q3 FROM cl GROUP BY dist")
def variogram_iqr(s, d):
    return _cloud(s, d).groupBy("dist").agg(*[R(quantile("sv", q), 5).alias(n) for q, n in ((0.25, "q1"), (0.5, "med"), (0.75, "q3"))])


@query(f"WITH {_E}, fl AS (SELECT i, j, c FROM er WHERE i < j UNION ALL SELECT j, i, c FROM er WHERE i < j) SELECT i, round(sum(abs(c)) / (SELECT count(*) - 1 FROM sites), 5) + 0.0 AS r FROM fl GROUP BY i")
def node_rank(s, d):
    c = spatial.ergodic(tables.field(s, d)).where("i < j").select("i", "j", "c")
    full = c.unionByName(c.select(F.col("j").alias("i"), F.col("i").alias("j"), "c"))
    n = tables.sites(s, d).agg((F.count("*") - 1).alias("n"))
    return full.groupBy("i").agg(F.sum(F.abs("c")).alias("s")).crossJoin(F.broadcast(n)).select("i", R(F.col("s") / F.col("n"), 5).alias("r"))


@query()
def spatial_variance(s, d):
    """Quartiles of the cloud by lag beside the fitted model."""
    p = _fit(s, d)
    iqr = variogram_iqr(s, d)
    dist = [r.dist for r in iqr.select("dist").collect()]
    g = (p["sill"] - p["nugget"]) * (1 - matern(np.array(dist), p["theta"], p["nu"])) + p["nugget"]
    fit = s.createDataFrame([(x, round(float(v), 4)) for x, v in zip(dist, g, strict=True)], "dist double, fit double")
    return iqr.join(F.broadcast(fit), "dist")
