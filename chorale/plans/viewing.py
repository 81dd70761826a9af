"""Queries for the reductions behind views and plots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chorale.functions.columns import clip, eps_map, normal_pdf, quantile, rounded
from chorale.operators import numeric, robust, views
from chorale.plans.base import query
from chorale.plans.duck import FIELD, SAMPLES, SITES, box
from chorale.sources import tables

R = rounded
_STIM = "stim AS (SELECT row_number() OVER (ORDER BY t) - 1 AS trial, t FROM (SELECT unnest(range(10, 110, 12)) AS t))"


def _stims(s):
    return s.range(10, 110, 12).select(((F.col("id") - 10) / 12).cast("long").alias("trial"), F.col("id").alias("t"))


@query(f"WITH {SAMPLES}, g AS (SELECT chan, unnest(range(-5, 135)) AS t FROM names) SELECT g.chan, g.t + 5 AS pos, round(CASE WHEN g.t < 0 THEN a.x + g.t * (b.x - a.x) WHEN g.t > 119 THEN y.x + (g.t - 119) * (y.x - z.x) ELSE s.x END, 6) + 0.0 AS x FROM g LEFT JOIN samples s ON s.chan = g.chan AND s.t = g.t JOIN samples a ON a.chan = g.chan AND a.t = 0 JOIN samples b ON b.chan = g.chan AND b.t = 1 JOIN samples y ON y.chan = g.chan AND y.t = 119 JOIN samples z ON z.chan = g.chan AND z.t = 118")
def safe_slice(s, d):
    return views.safe_slice(tables.samples(s, d), -5, 140).select("chan", "pos", R("x").alias("x"))


@query(f"WITH {SAMPLES}, p AS (SELECT * FROM samples WHERE t >= 10 AND t < 40), o AS (SELECT quantile_cont(m, 0.5) AS off FROM (SELECT max(x) - min(x) AS m FROM p GROUP BY chan)) SELECT chan, t, round(x + chan * off, 6) + 0.0 AS y FROM p, o")
def paged_stack(s, d):
    return views.page(tables.samples(s, d), 2, 10).select("chan", "t", R("y").alias("y"))


@query(f"WITH {SAMPLES}, w AS (SELECT chan, b AS block_id, x FROM samples, (SELECT unnest(range(0, 23)) AS b) WHERE t >= b * 5 AND t < b * 5 + 10) SELECT chan, block_id, round(avg(x), 9) + 0.0 AS m, count(*) AS n FROM w GROUP BY ALL")
def sliding_windows(s, d):
    w = views.overlapped(tables.samples(s, d), 10, 5, 119)
    return w.groupBy("chan", "block_id").agg(R(F.avg("x"), 9).alias("m"), F.count("*").alias("n"))


@query(f"WITH {SAMPLES} SELECT chan, t, round(sum(x) OVER (PARTITION BY chan ORDER BY t RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) + 0.0 AS s, count(*) OVER (PARTITION BY chan ORDER BY t RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS n FROM samples")
def rolling_range(s, d):
    w = Window.partitionBy("chan").orderBy("t").rangeBetween(-4, 4)
    return tables.samples(s, d).select("chan", "t", R(F.sum("x").over(w)).alias("s"), F.count("*").over(w).alias("n"))


@query("SELECT e.event_id, CASE WHEN e.user_id % 3 = 0 THEN value END AS c0, CASE WHEN e.user_id % 3 = 1 THEN value END AS c1 FROM events e WHERE e.user_id % 3 < 2")
def segment_pivot(s, d):
    """One null-masked series per class label of 0 or more; label -1 is out of bounds."""
    e = tables.load(s, d, "events").withColumn("label", F.when(F.col("user_id") % 3 == 2, -1).otherwise(F.col("user_id") % 3))
    return e.where("label >= 0").select("event_id", *[F.when(F.col("label") == k, F.col("value")).alias(f"c{k}") for k in (0, 1)])


@query(f"WITH {SAMPLES} SELECT chan, t // 4 AS t, round(x, 6) + 0.0 AS x FROM samples WHERE t % 4 = 0")
def decimate(s, d):
    return tables.samples(s, d).where("t % 4 = 0").select("chan", F.floor(F.col("t") / 4).alias("t"), R("x").alias("x"))


@query(f"WITH {SAMPLES} SELECT chan, t, round(x - avg(x) OVER (PARTITION BY t), 9) + 0.0 AS x FROM samples")
def car(s, d):
    return views.common_average(tables.samples(s, d)).select("chan", "t", R("x", 9).alias("x"))


@query(f"WITH {_STIM} SELECT trial, t FROM stim WHERE t >= 30 AND t < 60")
def stim_page(s, d):
    return _stims(s).where("t >= 30 and t < 60")


@query("SELECT DISTINCT l_discount AS e, round(power((sin(pi() * (l_discount - 0.5)) + 1) / 2, 2), 9) + 0.0 AS g FROM lineitem")
def map_eps(s, d):
    return tables.load(s, d, "lineitem").select(F.col("l_discount").alias("e")).distinct().select("e", R(eps_map(F.col("e")), 9).alias("g"))


@query(f"WITH {SAMPLES} SELECT t, chan // 3 AS \"row\", chan % 3 AS col, round(x, 6) + 0.0 AS v FROM samples")
def grid_embed(s, d):
    return tables.samples(s, d).select("t", F.floor(F.col("chan") / 3).cast("int").alias("row"), (F.col("chan") % 3).alias("col"), R("x").alias("v"))


@query(f"WITH {SAMPLES}, {SITES}, ts AS (SELECT DISTINCT t FROM samples) SELECT ts.t, \"row\", col, round(x.x, 6) + 0.0 AS v FROM ts CROSS JOIN sites LEFT JOIN samples x ON x.chan = site AND x.t = ts.t")
def frames(s, d):
    return views.frames(tables.samples(s, d), tables.sites(s, d)).select("t", "row", "col", R("v").alias("v"))


@query(f"WITH {SAMPLES} SELECT round(quantile_cont(x, 0.02), 6) + 0.0 AS lo, round(quantile_cont(x, 0.98), 6) + 0.0 AS hi FROM samples")
def frame_clim(s, d):
    return robust.limits(tables.samples(s, d), "x", 0.02, 0.98).select(R("lo").alias("lo"), R("hi").alias("hi"))


@query()
def upsample(s, d):
    """Natural cubic spline at three points per sample."""
    return numeric.upsample(tables.samples(s, d), 3).select("chan", "t", R("x").alias("x"))


@query()
def median_ci(s, d):
    return numeric.median_ci(tables.load(s, d, "events").select(F.col("event_type").alias("g"), F.col("value").alias("x")), 200)


@query(f"WITH {box('documents', 'n_chars', 'lang', 1.5)} SELECT lang, q1, med, q3, cast(min(CASE WHEN n_chars BETWEEN f_lo AND f_hi THEN n_chars END) AS BIGINT) AS lo, cast(max(CASE WHEN n_chars BETWEEN f_lo AND f_hi THEN n_chars END) AS BIGINT) AS hi, count(*) FILTER (n_chars NOT BETWEEN f_lo AND f_hi) AS n_out FROM documents JOIN q USING (lang) GROUP BY ALL")
def boxplot(s, d):
    return robust.box(tables.load(s, d, "documents").select("lang", "n_chars"), "n_chars", ["lang"], 1.5)


@query(f"WITH {box('events', 'value', 'event_type', 1.0)} SELECT event_type, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, round(greatest(min(value), any_value(f_lo)), 6) + 0.0 AS lo, round(least(max(value), any_value(f_hi)), 6) + 0.0 AS hi, count(*) FILTER (value NOT BETWEEN f_lo AND f_hi) AS n_out FROM events JOIN q USING (event_type) GROUP BY event_type, q1, med, q3")
def line_dist(s, d):
    b = robust.box(tables.load(s, d, "events").select("event_type", "value"), "value", ["event_type"], 1.0, clamp=True)
    return b.select("event_type", *[F.round(c, 6).alias(c) for c in ("q1", "med", "q3")], R("lo").alias("lo"), R("hi").alias("hi"), "n_out")


@query(f"WITH {SAMPLES}, m AS (SELECT t, avg(x) m, stddev_pop(x) s FROM samples GROUP BY t) SELECT t, l AS level, round(exp(-power((l - m) / s, 2) / 2) / (s * sqrt(2 * pi())), 9) + 0.0 AS dens FROM m, (SELECT unnest([10.0, 20.0, 30.0, 40.0, 50.0]) AS l) WHERE s > 0")
def density_band(s, d):
    m = tables.samples(s, d).groupBy("t").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).where("s > 0")
    x = m.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in (10, 20, 30, 40, 50)])))
    return x.select("t", "level", R(normal_pdf(F.col("level"), F.col("m"), F.col("s")), 9).alias("dens"))


_EP = SAMPLES + ", " + _STIM + ", ep AS (SELECT s.chan, trial, s.t - stim.t AS t, x FROM samples s JOIN stim ON s.t BETWEEN stim.t - 3 AND stim.t + 5)"


def _epochs(s, d):
    return views.epochs(tables.samples(s, d), _stims(s), 3, 6)


@query(f"WITH {_EP} SELECT chan, trial, t, round(x, 6) + 0.0 AS x FROM ep")
def epochs(s, d):
    return _epochs(s, d).select("chan", "trial", "t", R("x").alias("x"))


@query(f"WITH {_EP}, tr AS (SELECT chan, trial, max(x) - min(x) AS m FROM ep GROUP BY ALL), o AS (SELECT quantile_cont(m, 0.5) AS off FROM (SELECT quantile_cont(m, 0.5) AS m FROM tr GROUP BY chan)), k AS (SELECT chan, trial, row_number() OVER (ORDER BY chan, trial) - 1 AS k FROM tr) SELECT chan, trial, t, round(x + k * off, 6) + 0.0 AS y FROM ep JOIN k USING (chan, trial), o")
def epoch_stack(s, d):
    e = _epochs(s, d)
    ptp = e.groupBy("chan", "trial").agg((F.max("x") - F.min("x")).alias("m"))
    off = ptp.groupBy("chan").agg(quantile("m", 0.5).alias("m")).agg(quantile("m", 0.5).alias("off"))
    per = _stims(s).agg(F.count("*").alias("per"))
    k = e.crossJoin(F.broadcast(off)).crossJoin(F.broadcast(per)).withColumn("k", F.col("chan") * F.col("per") + F.col("trial"))
    return k.select("chan", "trial", "t", R(F.col("x") + F.col("k") * F.col("off")).alias("y"))


@query("SELECT round(5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) + quantile_cont(value, 0.5), 6) + 0.0 AS lim FROM events")
def sample_lim(s, d):
    e = tables.load(s, d, "events")
    return e.agg(R(5 * (quantile("value", 0.75) - quantile("value", 0.25)) + quantile("value", 0.5)).alias("lim"))


@query("WITH q AS (SELECT quantile_cont(value, 0.05) a, quantile_cont(value, 0.95) b FROM events) SELECT event_id, round((greatest(least(value, b), a) - a) / (b - a), 6) + 0.0 AS g FROM events, q WHERE value IS NOT NULL")
def clip_norm(s, d):
    e = tables.load(s, d, "events").where("value is not null").select("event_id", "value")
    q = robust.limits(e, "value", 0.05, 0.95)
    x = F.least(F.greatest(F.col("value"), F.col("lo")), F.col("hi"))
    return e.crossJoin(F.broadcast(q)).select("event_id", R((x - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("g"))


@query('WITH n AS (SELECT count(*) AS n, cast(ceil(sqrt(count(*))) AS INTEGER) AS w FROM nation) SELECT n_nationkey AS k, cast((row_number() OVER (ORDER BY n_nationkey) - 1) // w AS INTEGER) AS "row", cast((row_number() OVER (ORDER BY n_nationkey) - 1) % w AS INTEGER) AS col FROM nation, n')
def mosaic(s, d):
    t = tables.load(s, d, "nation").select(F.col("n_nationkey").alias("k"))
    _, w = views.mosaic(t.count())
    at = t.agg(F.array_sort(F.collect_set("k")).alias("ks")).select(F.posexplode("ks").alias("p", "k"))
    return at.select("k", F.floor(F.col("p") / w).cast("int").alias("row"), (F.col("p") % w).cast("int").alias("col"))


@query(f"WITH {_EP} SELECT chan, t, round(avg(x), 9) + 0.0 AS m, round(quantile_cont(x, 0.15), 6) + 0.0 AS lo, round(quantile_cont(x, 0.85), 6) + 0.0 AS hi, round(stddev_pop(x) / sqrt(count(x)), 6) + 0.0 AS sem FROM ep GROUP BY ALL")
def trial_band(s, d):
    return _epochs(s, d).groupBy("chan", "t").agg(R(F.avg("x"), 9).alias("m"), R(quantile("x", 0.15)).alias("lo"), R(quantile("x", 0.85)).alias("hi"), R(F.stddev_pop("x") / F.sqrt(F.count("x"))).alias("sem"))


@query(f"WITH {SAMPLES} SELECT chan, t, round(sum(x) OVER w, 6) + 0.0 AS s, round(sqrt((row_number() OVER (PARTITION BY chan ORDER BY t) - 1) / 119.0), 6) + 0.0 AS ramp FROM samples WINDOW w AS (PARTITION BY chan ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def trail_window(s, d):
    w = Window.partitionBy("chan").orderBy("t")
    return tables.samples(s, d).select("chan", "t", R(F.sum("x").over(w.rowsBetween(-9, 0))).alias("s"), R(F.sqrt((F.row_number().over(w) - 1) / F.lit(119.0))).alias("ramp"))


@query(f"WITH {_EP} SELECT chan, round(min(x), 6) + 0.0 AS lo, round(max(x), 6) + 0.0 AS hi, min(t) AS a, max(t) AS b FROM ep WHERE t BETWEEN 0 AND 3 GROUP BY chan")
def evoked_peak(s, d):
    return _epochs(s, d).where("t between 0 and 3").groupBy("chan").agg(R(F.min("x")).alias("lo"), R(F.max("x")).alias("hi"), F.min("t").alias("a"), F.max("t").alias("b"))


@query("SELECT o_orderkey, round(least(greatest(o_totalprice / 100000, 0.5), 2.5), 9) + 0.0 AS c FROM orders")
def clip_values(s, d):
    return tables.load(s, d, "orders").select("o_orderkey", R(clip(F.col("o_totalprice") / 100000, 0.5, 2.5), 9).alias("c"))


@query(f"WITH {FIELD} SELECT site, count(v) AS n, round(avg(v), 6) + 0.0 AS m, round(var_pop(v), 5) + 0.0 AS s2, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM field GROUP BY site")
def field_moments(s, d):
    return tables.field(s, d).groupBy("site").agg(F.count("v").alias("n"), R(F.avg("v")).alias("m"), R(F.var_pop("v"), 5).alias("s2"), F.round(F.min("v"), 6).alias("lo"), F.round(F.max("v"), 6).alias("hi"))
