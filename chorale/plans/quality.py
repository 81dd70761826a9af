"""Queries on scans, block quality control and its summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chorale.functions.columns import quantile, rounded
from chorale.operators import robust, views
from chorale.plans.base import query
from chorale.plans.duck import DAYS, FIELD, SAMPLES, SITES
from chorale.sources import tables
from chorale.sources.masks import lookup, stash

R = rounded


def _blocks(s, d, size=20):
    return views.blocks_of(tables.samples(s, d), size)


_B = SAMPLES + ", blocks AS (SELECT chan, t // 20 AS block_id, t % 20 AS pos, x FROM samples)"
_S = DAYS + ", cells AS (SELECT chan, block_id, stddev_pop(x) AS s, count(x) AS n FROM days GROUP BY ALL)"


@query(f"WITH {SAMPLES} SELECT chan, count(DISTINCT t // 7) AS n_blocks, count(*) AS n FROM samples GROUP BY chan")
def block_count(s, d):
    b = views.blocks_of(tables.samples(s, d), 7, full=False)
    return b.groupBy("chan").agg(F.countDistinct("block_id").alias("n_blocks"), F.count("*").alias("n"))


@query(f"WITH {SAMPLES}, b AS (SELECT chan, t // 7 AS block_id, t % 7 AS pos, x FROM samples) SELECT chan, block_id, pos, round(x, 6) + 0.0 AS x FROM b QUALIFY count(*) OVER (PARTITION BY chan, block_id) = 7")
def full_blocks(s, d):
    return views.blocks_of(tables.samples(s, d), 7).select("chan", "block_id", "pos", R("x").alias("x"))


@query(f"WITH {SAMPLES} SELECT chan, t, round(x, 6) + 0.0 AS x FROM samples WHERE t < 10000000 // (SELECT count(DISTINCT chan) FROM samples)")
def head_points(s, d):
    x = tables.samples(s, d)
    n = tables.channels(s, d).count()
    return x.where(F.col("t") < 10_000_000 // max(1, n)).select("chan", "t", R("x").alias("x"))


@query(f"WITH {SAMPLES}, p AS (SELECT chan, stddev_pop(x) AS p FROM samples GROUP BY chan) SELECT 'events' AS dataset, chan, p > (SELECT quantile_cont(p, 0.25) FROM p) AS ok FROM p")
def mask_roundtrip(s, d):
    p = tables.samples(s, d).groupBy("chan").agg(F.stddev_pop("x").alias("p"))
    q = p.agg(quantile("p", 0.25).alias("q"))
    mask = p.crossJoin(F.broadcast(q)).select("chan", (F.col("p") > F.col("q")).alias("ok"))
    return lookup(s, stash(mask, "events", overwrite=True), "events")


@query(f"WITH {_S}, q AS (SELECT quantile_cont(s, 0.25) a, quantile_cont(s, 0.75) b FROM cells) SELECT chan, round(avg(s), 6) + 0.0 AS power, count(*) AS n_blocks FROM cells, q WHERE s BETWEEN a - 3 * (b - a) AND b + 3 * (b - a) GROUP BY chan")
def safe_avg_power(s, d):
    return robust.safe_avg_power(tables.user_days(s, d)).select("chan", R("power").alias("power"), "n_blocks")


@query(f"WITH {_S}, q AS (SELECT chan, quantile_cont(s, 0.25) a, quantile_cont(s, 0.75) b FROM cells GROUP BY chan) SELECT chan, round(avg(s), 6) + 0.0 AS power, count(*) AS n_blocks FROM cells JOIN q USING (chan) WHERE s BETWEEN a - 1.0 * (b - a) AND b + 1.0 * (b - a) GROUP BY chan")
def safe_avg_power_per_chan(s, d):
    return robust.safe_avg_power(tables.user_days(s, d), k=1.0, per_chan=True).select("chan", R("power").alias("power"), "n_blocks")


@query("WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.75) b FROM lineitem GROUP BY ALL) SELECT l_returnflag, count(*) FILTER (l_extendedprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)) AS n_in, count(*) AS n FROM lineitem JOIN q USING (l_returnflag) GROUP BY ALL")
def fence(s, d):
    x = robust.fenced(tables.load(s, d, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", ["l_returnflag"], 0.5)
    return x.groupBy("l_returnflag").agg(F.sum(F.col("inlier").cast("long")).alias("n_in"), F.count("*").alias("n"))


def _user_power(s, d):
    return tables.user_days(s, d).groupBy("chan").agg(F.stddev_pop("x").alias("p"))


_BAD = DAYS + ", pw AS (SELECT chan, CASE WHEN stddev_pop(x) > 0 THEN ln(stddev_pop(x)) END AS l FROM days GROUP BY chan), m1 AS (SELECT chan, l, coalesce(l > ln(1e-8), false) AS a FROM pw), m2 AS (SELECT chan, l, a AND l >= (SELECT quantile_cont(l, 0.5) FROM m1 WHERE a) - ln(1e2) AS a FROM m1), q AS (SELECT quantile_cont(l, {lo}) x, quantile_cont(l, {hi}) y FROM m2 WHERE a) SELECT chan, coalesce(a AND l BETWEEN x - {k} * (y - x) AND y + {k} * (y - x), false) AS ok FROM m2, q"


@query("WITH " + _BAD.format(lo=0.25, hi=0.75, k=1.5))
def bad_channels(s, d):
    return robust.bad_channels(_user_power(s, d), k=1.5)


@query("WITH " + _BAD.format(lo=0.5, hi=0.8, k=3.0))
def channel_mask(s, d):
    return robust.bad_channels(_user_power(s, d), k=3.0, lo=0.5, hi=0.8)


_STEP = "SELECT i + 1, CASE WHEN i = 0 THEN (SELECT count(*) FROM lg) ELSE len(v) END, list_filter(w, lambda x: x BETWEEN q1 - kk * (q3 - q1) AND q3 + kk * (q3 - q1)) FROM (SELECT *, list_aggregate(w, 'quantile_cont', 0.25) AS q1, list_aggregate(w, 'quantile_cont', 0.75) AS q3 FROM (SELECT i, n, v, {k} + 0.2 * i AS kk, list_filter(v, lambda x: x >= m - ln(1e2)) AS w FROM (SELECT *, list_aggregate(v, 'quantile_cont', 0.5) AS m FROM r WHERE len(v) > 0 AND (i = 0 OR len(v) <> n))))"
_AUTO = "WITH RECURSIVE " + _S + ", qq AS (SELECT quantile_cont(s, 0.25) a, quantile_cont(s, 0.75) b FROM cells), pw AS (SELECT chan, avg(s) AS p FROM cells, qq WHERE s BETWEEN a - {far} * (b - a) AND b + {far} * (b - a) GROUP BY chan), lg AS (SELECT chan, CASE WHEN p > 0 THEN ln(p) END AS l FROM pw), r(i, n, v) AS (SELECT 0, cast(-1 AS BIGINT), coalesce(list(l), []) FROM lg WHERE l > ln(1e-8) UNION ALL " + _STEP + ") SELECT chan, coalesce(list_contains((SELECT v FROM r ORDER BY i DESC LIMIT 1), l), false) AS ok FROM lg"


@query(_AUTO.format(k=3, far=15))
def auto_mask(s, d):
    return robust.auto_mask(robust.safe_avg_power(tables.user_days(s, d), k=15.0).select("chan", F.col("power").alias("p")))


@query(_AUTO.format(k=0.5, far=15))
def auto_mask_narrow(s, d):
    """A fence that takes several rounds."""
    return robust.auto_mask(robust.safe_avg_power(tables.user_days(s, d), k=15.0).select("chan", F.col("power").alias("p")), k=0.5)


@query(f"WITH {DAYS}, p AS (SELECT chan, stddev_pop(x) AS r FROM days GROUP BY chan) SELECT chan, round(r, 6) + 0.0 AS rms FROM p WHERE NOT (r > 40 AND r < 60)")
def rms_exclude(s, d):
    return _user_power(s, d).where(~((F.col("p") > 40) & (F.col("p") < 60))).select("chan", R("p").alias("rms"))


_PAIR = _B + ", pairs AS (SELECT a.block_id, a.chan AS i, b.chan AS j, {agg} AS c FROM blocks a JOIN blocks b ON a.block_id = b.block_id AND a.pos = b.pos AND a.chan <= b.chan GROUP BY ALL), norms AS (SELECT block_id, sum(CASE WHEN i = j THEN c * c ELSE 2 * c * c END) AS s FROM pairs GROUP BY block_id), q AS (SELECT quantile_cont(s, 0.25) a, quantile_cont(s, 0.75) b FROM norms), kept AS (SELECT block_id FROM norms, q WHERE s BETWEEN a - 3 * (b - a) AND b + 3 * (b - a)), safe AS (SELECT i, j, avg(c) AS c FROM pairs WHERE block_id IN (SELECT block_id FROM kept) GROUP BY ALL)"
_CORR, _COV, _SEMI = (_PAIR.format(agg=a) for a in ("corr(a.x, b.x)", "covar_samp(a.x, b.x)", "var_pop(a.x - b.x) / 2"))


@query(f"WITH {_CORR} SELECT i, j, round(c, 6) + 0.0 AS c FROM safe")
def safe_corrcoef(s, d):
    return robust.safe_pairs(_blocks(s, d), "corr").select("i", "j", R("c").alias("c"))


@query(f"WITH {_COV} SELECT i, j, round(c, 6) + 0.0 AS c FROM safe")
def safe_cov(s, d):
    return robust.safe_pairs(_blocks(s, d), "cov").select("i", "j", R("c").alias("c"))


@query(f"WITH {_SEMI} SELECT i, j, round(c, 6) + 0.0 AS c FROM safe")
def safe_semivar(s, d):
    return robust.safe_pairs(_blocks(s, d), "semivar").select("i", "j", R("c").alias("c"))


@query(f"WITH {_CORR} SELECT i, j, round(c, 6) + 0.0 AS c FROM safe UNION ALL SELECT j, i, round(c, 6) + 0.0 FROM safe WHERE i <> j")
def mirror(s, d):
    return robust.mirror(robust.safe_pairs(_blocks(s, d), "corr")).select("i", "j", R("c").alias("c"))


@query(f"WITH {SAMPLES}, l AS (SELECT chan, t, x, lag(x) OVER (PARTITION BY chan ORDER BY t) AS b FROM samples), f AS (SELECT chan, regr_slope(x, b) m, regr_intercept(x, b) c FROM l WHERE b IS NOT NULL GROUP BY chan) SELECT chan, t, round(x - m * b - c, 6) + 0.0 AS e FROM l JOIN f USING (chan) WHERE b IS NOT NULL")
def ar1_whiten(s, d):
    return robust.ar1_whiten(tables.samples(s, d)).select("chan", "t", R("e").alias("e"))


def _site_corr(s, d):
    f = tables.field(s, d)
    a, b = f.select(F.col("site").alias("i"), "sample", F.col("v").alias("a")), f.select(F.col("site").alias("j"), "sample", F.col("v").alias("b"))
    return a.join(b, "sample").where("i <= j").groupBy("i", "j").agg(F.covar_samp("a", "b").alias("cv"), F.stddev_samp("a").alias("sa"), F.stddev_samp("b").alias("sb"), F.corr("a", "b").alias("c"))


_SC = FIELD + ", " + SITES + ", pc AS (SELECT a.site AS i, b.site AS j, corr(a.v, b.v) AS c FROM field a JOIN field b ON a.sample = b.sample AND a.site <= b.site GROUP BY ALL), full_pc AS (SELECT i, j, c FROM pc UNION ALL SELECT j, i, c FROM pc WHERE i <> j), moved AS (SELECT b.\"row\" - a.\"row\" AS dy, b.col - a.col AS dx, c FROM full_pc JOIN sites a ON a.site = i JOIN sites b ON b.site = j)"


@query(f"WITH {_SC} SELECT dy, dx, round(avg(c), 6) + 0.0 AS c, count(c) AS n FROM moved GROUP BY ALL")
def spatial_autocov(s, d):
    return robust.spatial_autocov(_site_corr(s, d).select("i", "j", "c"), tables.sites(s, d)).select("dy", "dx", R("c").alias("c"), "n")


@query(f"WITH {_SC}, g AS (SELECT dy, dx, avg(c) AS c FROM moved GROUP BY ALL) SELECT 'x' AS axis, dx AS lag, round(quantile_cont(c, 0.25), 6) + 0.0 AS q1, round(quantile_cont(c, 0.5), 6) + 0.0 AS med, round(quantile_cont(c, 0.75), 6) + 0.0 AS q3 FROM g GROUP BY dx UNION ALL SELECT 'y', dy, round(quantile_cont(c, 0.25), 6) + 0.0, round(quantile_cont(c, 0.5), 6) + 0.0, round(quantile_cont(c, 0.75), 6) + 0.0 FROM g GROUP BY dy")
def rxx_marginals(s, d):
    g = robust.spatial_autocov(_site_corr(s, d).select("i", "j", "c"), tables.sites(s, d))
    out = None
    for axis, col in (("x", "dx"), ("y", "dy")):
        m = g.groupBy(F.lit(axis).alias("axis"), F.col(col).alias("lag")).agg(*[R(quantile("c", q)).alias(n) for q, n in ((0.25, "q1"), (0.5, "med"), (0.75, "q3"))])
        out = m if out is None else out.unionByName(m)
    return out


@query(f"WITH {_SC} SELECT i, j, round(c, 6) + 0.0 AS c, a.\"row\" = b.\"row\" AS same_row, a.col = b.col AS same_col, abs(a.\"row\" - b.\"row\") + abs(a.col - b.col) = 1 AS near FROM pc JOIN sites a ON a.site = i JOIN sites b ON b.site = j WHERE i < j")
def corr_pairs(s, d):
    t = tables.sites(s, d)
    a = t.select(F.col("site").alias("i"), F.col("row").alias("r1"), F.col("col").alias("c1"))
    b = t.select(F.col("site").alias("j"), F.col("row").alias("r2"), F.col("col").alias("c2"))
    p = _site_corr(s, d).where("i < j").join(a, "i").join(b, "j")
    return p.select("i", "j", R("c").alias("c"), F.expr("r1 = r2").alias("same_row"), F.expr("c1 = c2").alias("same_col"), F.expr("abs(r1 - r2) + abs(c1 - c2) = 1").alias("near"))


@query(f"WITH {_SC} SELECT round(quantile_cont(c, 0.02), 6) + 0.0 AS lo, round(quantile_cont(c, 0.98), 6) + 0.0 AS hi, count(c) AS n FROM full_pc WHERE i <> j")
def site_corr(s, d):
    full = robust.mirror(_site_corr(s, d).select("i", "j", "c")).where("i != j")
    return full.agg(R(quantile("c", 0.02)).alias("lo"), R(quantile("c", 0.98)).alias("hi"), F.count("c").alias("n"))


@query(f"WITH {DAYS}, p AS (SELECT chan, stddev_pop(x) AS r FROM days GROUP BY chan) SELECT round(quantile_cont(r, 0.05), 6) + 0.0 AS lo, round(quantile_cont(r, 0.95), 6) + 0.0 AS hi FROM p WHERE r > 1e-2 * (SELECT quantile_cont(r, 0.5) FROM p)")
def rms_clim(s, d):
    p = _user_power(s, d)
    m = p.agg(quantile("p", 0.5).alias("m"))
    kept = p.crossJoin(F.broadcast(m)).where(F.col("p") > 1e-2 * F.col("m"))
    return robust.limits(kept, "p", 0.05, 0.95).select(R("lo").alias("lo"), R("hi").alias("hi"))


@query(f"WITH {SAMPLES}, r AS (SELECT chan, x, sin(0.7 * t) + 0.3 * cos(2.1 * t) AS ref FROM samples) SELECT chan, round(regr_slope(x, ref), 6) + 0.0 AS gain FROM r GROUP BY chan")
def sinusoid_gain(s, d):
    t = F.col("t").cast("double")
    r = tables.samples(s, d).withColumn("ref", F.sin(0.7 * t) + 0.3 * F.cos(2.1 * t))
    return r.groupBy("chan").agg(R(F.regr_slope("x", "ref")).alias("gain"))


_IV = "iv AS (SELECT o_custkey AS k, epoch_us(min(o_orderdate)) / 86400000000.0 AS a, epoch_us(max(o_orderdate)) / 86400000000.0 AS b FROM orders GROUP BY o_custkey)"


@query(f"WITH {_IV} SELECT k, a, b, CASE WHEN a BETWEEN 9000 AND 9500 AND b BETWEEN 9000 AND 9500 THEN 'within' WHEN a < 9000 AND b > 9500 THEN 'contains' WHEN a BETWEEN 9000 AND 9500 THEN 'opens' ELSE 'closes' END AS how FROM iv WHERE a <= 9500 AND b >= 9000")
def interval_overlap(s, d):
    o = tables.load(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    day = lambda c: F.expr(f"timestampdiff(DAY, timestamp_ntz'1970-01-01 00:00:00', {c})").cast("double")
    return views.interval_overlap(o.select("k", day("a").alias("a"), day("b").alias("b")), 9000, 9500)


@query("SELECT l_returnflag, l_orderkey, l_linenumber, cast(rn AS INTEGER) AS rn, l_extendedprice AS e FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE rn = cast(floor(0.9 * n) AS BIGINT)")
def rank_pick(s, d):
    """The trial at the 90th percentile of energy in each condition.

    The rank comes from a count per condition; only rows at the 90 % value are
    ordered, so no condition is sorted in one task.
    """
    x = tables.load(s, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("e"))
    n = x.groupBy("l_returnflag").agg(F.count("*").alias("n")).withColumn("k", F.floor(0.9 * F.col("n")))
    sizes = x.groupBy("l_returnflag", "e").agg(F.count("*").alias("c"))
    below = sizes.withColumn("upto", F.sum("c").over(Window.partitionBy("l_returnflag").orderBy("e"))).join(n, "l_returnflag").where("upto >= k and upto - c < k")
    at = x.join(below.select("l_returnflag", "e", "k", (F.col("upto") - F.col("c")).alias("before")), ["l_returnflag", "e"])
    rank = F.row_number().over(Window.partitionBy("l_returnflag").orderBy("l_orderkey", "l_linenumber")) + F.col("before")
    return at.withColumn("rn", rank.cast("int")).where("rn = k").select("l_returnflag", "l_orderkey", "l_linenumber", "rn", "e")
