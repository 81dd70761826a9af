"""Queries on bootstrap and jackknife."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from chorale.functions.columns import rounded
from chorale.operators import resample
from chorale.plans.base import query
from chorale.plans.duck import FIELD, SAMPLES
from chorale.sources import tables

R = rounded
REPS = 50
_LCG = "(((((cast({r} AS BIGINT) * 1000003 + {p} * 7919 + 12345) % 2147483647) * 48271) % 2147483647) * 48271 + 11) % 2147483647"
_VEC = SAMPLES + ", vec AS (SELECT chan * 120 + t AS pos, x FROM samples), dr AS (SELECT rep, pos, " + _LCG.format(r="rep", p="pos") + " % (SELECT count(*) FROM vec) AS idx FROM vec, (SELECT unnest(range(50)) AS rep)), rs AS (SELECT rep, dr.pos, idx, v.x FROM dr JOIN vec v ON v.pos = idx)"
_SITE = FIELD + ", sv AS (SELECT site AS pos, avg(v) AS x FROM field GROUP BY site), tot AS (SELECT count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM sv)"
_JK = _SITE + ", jk AS (SELECT pos, n, sqrt((q - x * x) / (n - 1) - power((s - x) / (n - 1), 2)) AS th, sqrt(q / n - power(s / n, 2)) AS theta FROM sv, tot), pv AS (SELECT *, n * theta - (n - 1) * th AS pv FROM jk)"


def _vector(s, d):
    x = tables.samples(s, d).select((F.col("chan") * 120 + F.col("t")).alias("pos"), "x")
    return x, 120 * tables.channels(s, d).count()


def _sites(s, d):
    return tables.field(s, d).groupBy(F.col("site").alias("pos")).agg(F.avg("v").alias("x"))


@query(f"WITH {_VEC} SELECT rep, pos, idx FROM dr")
def boot_index(s, d):
    x, n = _vector(s, d)
    return resample.draws(x, n, REPS).select("rep", "pos", "idx")


@query()
def boot_weighted(s, d):
    w = _sites(s, d).select("pos", F.col("x").alias("w"))
    return resample.weighted_draws(w, 100, REPS)


@query(f"WITH {_VEC} SELECT rep, pos, round(x, 6) + 0.0 AS x FROM rs")
def bootstrap_draws(s, d):
    x, n = _vector(s, d)
    return resample.resampled(x, n, REPS).select("rep", "pos", R("x").alias("x"))


@query(f"WITH {_VEC} SELECT rep, round(avg(x), 9) + 0.0 AS th FROM rs GROUP BY rep")
def bootstrap_mean(s, d):
    x, n = _vector(s, d)
    return resample.resampled(x, n, REPS).groupBy("rep").agg(R(F.avg("x"), 9).alias("th"))


@query(f"WITH {_VEC}, th AS (SELECT rep, avg(x) AS th FROM rs GROUP BY rep) SELECT round((SELECT avg(x) FROM vec), 9) + 0.0 AS theta, round(avg(th), 9) + 0.0 AS mean, round(quantile_cont(th, 0.025), 9) + 0.0 AS lo, round(quantile_cont(th, 0.975), 9) + 0.0 AS hi FROM th")
def bootstrap_ci(s, d):
    x, n = _vector(s, d)
    return resample.estimate(x, n, REPS, F.avg("x")).select(*[R(c, 9).alias(c) for c in ("theta", "mean", "lo", "hi")])


@query(f"WITH {_VEC}, th AS (SELECT rep, stddev_pop(x) AS th FROM rs GROUP BY rep) SELECT round((SELECT stddev_pop(x) FROM vec), 6) + 0.0 AS theta, round(avg(th), 6) + 0.0 AS mean, round(stddev_pop(th), 6) + 0.0 AS se FROM th")
def bootstrap_se(s, d):
    x, n = _vector(s, d)
    return resample.estimate(x, n, REPS, F.stddev_pop("x"), None).select(*[R(c).alias(c) for c in ("theta", "mean", "se")])


def _ranked(s, d):
    """The sites' means by place from 0."""
    return _sites(s, d).withColumn("pos", F.row_number().over(Window.orderBy("pos")) - 1)  # one array's sites


_RANKED = _SITE + ", rk AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, x FROM sv)"


@query(f"WITH {_RANKED} SELECT a.pos AS rep, b.pos, round(b.x, 6) + 0.0 AS x FROM rk a JOIN rk b ON a.pos <> b.pos")
def leave_out(s, d):
    return resample.Jackknife(_ranked(s, d), ["x"]).samples().select("rep", "pos", R("x").alias("x"))


_D4 = _RANKED + ", c4 AS (SELECT row_number() OVER (ORDER BY a.pos, b.pos, c.pos, e.pos) - 1 AS rep, a.x + b.x + c.x + e.x AS gone FROM rk a JOIN rk b ON a.pos < b.pos JOIN rk c ON b.pos < c.pos JOIN rk e ON c.pos < e.pos), t4 AS (SELECT rep, (s - gone) / (n - 4) AS th, n, s / n AS theta FROM c4, tot), p4 AS (SELECT *, n / 4.0 * theta - (n - 4) / 4.0 * th AS pv FROM t4)"


@query(f"WITH {_D4} SELECT rep, round(th, 6) + 0.0 AS th, round(pv, 6) + 0.0 AS pv FROM p4")
def jackknife_d4(s, d):
    """Four places left out, in order."""
    return resample.Jackknife(_ranked(s, d), ["x"], n_out=4).pseudovals(F.avg("x")).select("rep", R("th").alias("th"), R("pv").alias("pv"))


@query(f"WITH {_D4} SELECT round(avg(pv), 5) + 0.0 AS est, round(stddev_pop(pv) / sqrt(count(*) - 1), 6) + 0.0 AS se FROM p4")
def jackknife_d4_est(s, d):
    return resample.Jackknife(_ranked(s, d), ["x"], n_out=4).estimate(F.avg("x")).select(R("est", 5).alias("est"), R("se").alias("se"))


@query(f"WITH {_RANKED}, lo AS (SELECT a.pos AS rep, median(b.x) AS th FROM rk a JOIN rk b ON a.pos <> b.pos GROUP BY a.pos), md AS (SELECT median(x) AS theta, count(*) AS n FROM rk) SELECT rep, round(th, 6) + 0.0 AS th, round(n * theta - (n - 1) * th, 6) + 0.0 AS pv FROM lo, md")
def jackknife_median(s, d):
    """Pseudovalues of a function."""
    return resample.Jackknife(_ranked(s, d), ["x"]).pseudovals(np.median).select("rep", R("th").alias("th"), R("pv").alias("pv"))


@query(f"WITH {_VEC}, th AS (SELECT rep, median(x) AS th FROM rs GROUP BY rep) SELECT round((SELECT median(x) FROM vec), 6) + 0.0 AS theta, round(avg(th), 6) + 0.0 AS mean, round(quantile_cont(th, 0.05), 6) + 0.0 AS lo, round(quantile_cont(th, 0.95), 6) + 0.0 AS hi FROM th")
def bootstrap_function(s, d):
    x, _ = _vector(s, d)
    return resample.Bootstrap(x, ["x"], REPS).estimate(np.median, ci=0.9).select(*[R(c).alias(c) for c in ("theta", "mean", "lo", "hi")])


@query(f"WITH {SAMPLES}, dr AS (SELECT rep, t AS pos, {_LCG.format(r='rep', p='t')} % 120 AS idx FROM (SELECT unnest(range(120)) AS t), (SELECT unnest(range(50)) AS rep)), th AS (SELECT rep, v.chan, corr(v.x, v.t) AS th FROM dr JOIN samples v ON v.t = idx GROUP BY ALL) SELECT rep, chan, round(th, 6) + 0.0 AS th FROM th")
def bootstrap_aligned(s, d):
    """Two arrays, x and its time, of all channels, resampled along time by the same draws."""
    x = tables.samples(s, d).select("chan", F.col("t").alias("pos"), "x", F.col("t").cast("double").alias("at"))
    b = resample.Bootstrap(x, ["x", "at"], REPS, keys=["chan"])
    return b.all_samples(lambda v, t: np.corrcoef(v, t)[0, 1]).select("rep", "chan", R("th").alias("th"))


@query(f"WITH {_SITE} SELECT a.pos AS i, b.pos AS j, round((s - a.x - b.x) / (n - 2), 6) + 0.0 AS th, round(s / 2 - (s - a.x - b.x) / 2, 6) + 0.0 AS pv FROM sv a JOIN sv b ON a.pos < b.pos, tot")
def jackknife_d2(s, d):
    return resample.jackknife_mean_d2(_sites(s, d)).select("i", "j", R("th").alias("th"), R("pv").alias("pv"))


@query(f"WITH {_JK} SELECT pos, round(th, 6) + 0.0 AS th, round(pv, 6) + 0.0 AS pv FROM pv")
def jackknife_pseudo(s, d):
    return resample.jackknife_std(_sites(s, d)).select("pos", R("th").alias("th"), R("pv").alias("pv"))


@query(f"WITH {_JK} SELECT round(avg(pv), 6) + 0.0 AS est, round(stddev_pop(pv) / sqrt(count(*) - 1), 6) + 0.0 AS se FROM pv")
def jackknife_est(s, d):
    return resample.summary(resample.jackknife_std(_sites(s, d))).select(R("est").alias("est"), R("se").alias("se"))


@query(f"WITH {_JK} SELECT round(any_value(theta) - avg(pv), 6) + 0.0 AS bias FROM pv")
def jackknife_bias(s, d):
    return resample.jackknife_std(_sites(s, d)).agg(R(F.first("theta") - F.avg("pv")).alias("bias"))


@query(f"WITH {_JK} SELECT round((any_value(n) - 1) * var_pop(th), 6) + 0.0 AS v FROM pv")
def jackknife_var(s, d):
    return resample.jackknife_std(_sites(s, d)).agg(R((F.first("n") - 1) * F.var_pop("th")).alias("v"))


_ONE = "{a} AS (SELECT rep, avg(v.x) AS m, var_pop(v.x) AS v FROM (SELECT rep, " + _LCG.format(r="(rep + {seed})", p="t") + " % 120 AS idx FROM samples, (SELECT unnest(range(50)) AS rep) WHERE chan = {c}) JOIN samples v ON v.t = idx AND v.chan = {c} GROUP BY rep)"


@query(f"WITH {SAMPLES}, {_ONE.format(a='bx', seed=0, c=0)}, {_ONE.format(a='bw', seed=1000, c=1)}, f AS (SELECT avg(x) FILTER (chan = 0) mx, var_pop(x) FILTER (chan = 0) vx, avg(x) FILTER (chan = 1) my, var_pop(x) FILTER (chan = 1) vy FROM samples), st AS (SELECT (mx - my) / sqrt(vx / 120 + vy / 120) AS t, mx, my FROM f) SELECT round(t, 6) + 0.0 AS t, round(avg(CASE WHEN abs((bx.m - mx - bw.m + my) / sqrt(bx.v / 120 + bw.v / 120)) >= abs(t) THEN 1.0 ELSE 0.0 END), 6) AS p FROM bx JOIN bw USING (rep), st GROUP BY t")
def boot_t_test(s, d):
    x = tables.samples(s, d)
    one = lambda c: x.where(F.col("chan") == c).select(F.col("t").alias("pos"), "x")
    return resample.t_test(one(0), one(1), 120, 120, REPS).select(R("t").alias("t"), R("p").alias("p"))


@query()
def rand_combos(s, d):
    rows = [(k, p) for k, c in enumerate(resample.random_combinations(25, 4, 40)) for p in c]
    return s.createDataFrame(rows, "rep int, pos int")
