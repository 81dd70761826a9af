"""Identities and edge cases of the operators, on small fixtures."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chorale.functions import special
from chorale.operators import graph, multitaper, numeric, resample, robust, spatial, spectral, views
from chorale.sources import masks


def series(spark, n=64, chans=2):
    rows = [(c, t, math.sin(0.7 * t + c) + 0.3 * math.cos(2.1 * t)) for c in range(chans) for t in range(n)]
    return spark.createDataFrame(rows, "chan int, t long, x double")


def test_tapers_are_orthonormal_and_concentrated():
    for n, nw in ((64, 2.5), (120, 4), (256, 3)):
        v, lam = special.dpss(n, nw)
        assert np.allclose(v @ v.T, np.eye(len(v)), atol=1e-9)
        assert (lam > 0.99).all() and (np.diff(lam) < 1e-9).all()
        assert (v[::2].sum(axis=1) > 0).all()
    assert len(special.dpss(256, 4)[1]) == 6 and len(special.dpss(256, 4, 0.9)[1]) == 7


def test_quantiles_and_bessel():
    assert special.chi2_ppf(0.975, 10) == pytest.approx(20.4832, abs=1e-4)
    assert special.t_ppf(0.975, 4) == pytest.approx(2.77645, abs=1e-5)
    for z in (0.01, 0.1, 1, 5, 20):
        assert special.bessel_k(0.5, z)[0] == pytest.approx(math.sqrt(math.pi / 2 / z) * math.exp(-z), rel=1e-12)
    x = np.array([0.0, 0.5, 2.0])
    assert np.allclose(special.matern(x, 1.0, 0.5), np.exp(-x))
    assert (special.matern(x, 0.0, 1.0) == 0).all()


def test_psd_integrates_to_the_variance(spark):
    x = spectral.detrend(series(spark), ["chan"])
    v = np.ones((1, 64)) / 8
    p = spectral.psd(numeric.direct_sdf(x, v, 64, ["chan"]), np.ones(1), ["chan"], 64).groupBy("chan").agg((F.sum("p") / 64).alias("v"))
    want = {r.chan: r.v for r in x.groupBy("chan").agg(F.var_pop("x").alias("v")).collect()}
    for r in p.collect():
        assert r.v == pytest.approx(want[r.chan], rel=1e-9)


def test_coherence_with_itself_is_one(spark):
    x = series(spark, chans=1)
    both = x.unionByName(x.withColumn("chan", F.lit(1)))
    v, lam = special.dpss(64, 2.5, 0.9)
    c = spectral.coherence(spectral.csd(numeric.direct_sdf(both, v, 64, ["chan"]), lam)).collect()
    assert len(c) == 33 and all(r.msc == pytest.approx(1, abs=1e-9) for r in c)


def test_series_of_another_length_is_an_error(spark):
    v, _ = special.dpss(32, 2.5)
    with pytest.raises(Exception, match="series of .20. samples, tapers of 32"):
        numeric.direct_sdf(series(spark, 20), v, 32, ["chan"]).count()


def vector(spark, n=10):
    return spark.createDataFrame([(i, math.sin(0.7 * i) + 0.3 * math.cos(2.1 * i)) for i in range(n)], "pos long, x double")


@pytest.mark.parametrize(("n_out", "most", "count"), [(1, None, 10), (4, None, 210), (4, 10, 10)])
def test_jackknife_replicates(spark, n_out, most, count):
    j = resample.Jackknife(vector(spark), ["x"], n_out, max_samples=most)
    got = {}
    for r in j.samples().collect():
        got.setdefault(r.rep, set()).add(r.pos)
    assert len(got) == count == len(set(map(frozenset, got.values()))) and {len(v) for v in got.values()} == {10 - n_out}
    if not most:
        out = [tuple(sorted(set(range(10)) - got[k])) for k in sorted(got)]
        assert out == sorted(out) and out[0] == tuple(range(n_out))


@pytest.mark.parametrize("n_out", [1, 4])
def test_jackknife_bias_and_errors(spark, n_out):
    """Both definitions of the error agree for one place out; the bias is that of its definition."""
    j = resample.Jackknife(vector(spark), ["x"], n_out)
    th = np.array([r.th for r in j.all_samples(np.std).collect()])
    theta = np.std([r.x for r in vector(spark).collect()])
    bias = j.bias(F.stddev_pop("x")).first().bias
    assert bias == pytest.approx((10 - n_out) / n_out * (th.mean() - theta), abs=1e-12)
    one, raw = j.estimate(np.std).first(), j.estimate(F.stddev_pop("x"), correct_bias=False).first()
    assert raw.est == pytest.approx(th.mean()) and one.est == pytest.approx(theta - bias)
    assert j.variance(np.std).first().v == pytest.approx(9 * th.var())
    if n_out == 1:
        assert one.se == pytest.approx(raw.se) == pytest.approx(math.sqrt(9 * th.var()))


def test_bootstrap_of_axes_and_arguments(spark):
    rows = [(a, b, c, math.sin(1 + a + 7 * b + 31 * c)) for a in range(10) for b in range(3) for c in range(8)]
    t = spark.createDataFrame(rows, "a long, b int, c int, x double")
    for axis, n, keys in (("a", 10, ["b", "c"]), ("b", 3, ["a", "c"]), ("c", 8, ["a", "b"])):
        boot = resample.Bootstrap(t.withColumnRenamed(axis, "pos"), ["x"], 4, keys)
        assert boot.n == n and boot.samples().count() == 4 * 240
    boot = resample.Bootstrap(vector(spark), ["x"], 4, size=8)
    assert boot.samples().groupBy("rep").count().collect() == boot.samples().groupBy("rep").count().where("count = 8").collect()
    got = {r.rep: r.th for r in boot.all_samples(np.percentile, q=25).collect()}
    want = {}
    for r in boot.samples().collect():
        want.setdefault(r.rep, []).append(r.x)
    assert got == {k: pytest.approx(np.percentile(v, 25)) for k, v in want.items()}
    heavy = resample.Bootstrap(vector(spark), ["x"], 3, proba=spark.createDataFrame([(i, float(i == 3)) for i in range(10)], "pos long, w double"))
    assert {r.idx for r in heavy.draws().collect()} == {3} and heavy.draws().count() == 30


def test_estimator_arguments():
    e = multitaper.Estimator(100, bw=0.07, fs=2.0, nfft="auto", low_bias=False)
    assert (e.nw, e.nfft, len(e.lam)) == (2.0, 128, 3) and e.bandwidth == pytest.approx(0.08)
    assert multitaper.Estimator(64).nfft == 64 and multitaper.Estimator(64).nw == 4


def test_estimator_intervals_hold_the_spectrum(spark):
    e = multitaper.Estimator(64, nw=2.5, low_bias=0.9)
    x = series(spark)
    for kind in ({"ci": 0.95}, {"ci": 0.95, "adaptive": True}, {"jackknife": True}):
        got = e.psd(x, **kind).where("k > 0").collect()
        assert len(got) == 64 and all(r.lo < r.hi for r in got) and sum(r.lo <= r.p <= r.hi for r in got) > 50
    assert e.csd(x).count() == 3 * 33 and e.csd(x.where("chan = 0"), x).where("i = 0").count() == 2 * 33


def test_coherence_interval_and_seed(spark):
    v, lam = special.dpss(64, 2.5, 0.9)
    sdf = numeric.direct_sdf(spectral.detrend(series(spark, chans=3), ["chan"]), v, 64, ["chan"]).where("k > 0")
    t = special.t_ppf(0.975, len(lam) - 1)
    for fisher in (False, True):
        got = spectral.coherence_interval(sdf, lam, t, fisher).collect()
        assert len(got) == 3 * 32 and all(0 <= r.lo <= r.msc <= r.hi <= 1 for r in got)
    assert {(r.i, r.j) for r in spectral.coherency(sdf, lam, seed=1).collect()} == {(0, 1), (1, 2)}
    assert all(r.re**2 + r.im**2 <= 1 + 1e-12 for r in spectral.coherency(sdf, lam).collect())


def test_auto_mask_only_shrinks(spark):
    rng = np.random.default_rng(3)
    power = [*np.exp(rng.normal(0, 0.1, 60)), *np.exp(rng.normal(0, 0.9, 12)), 1e-12, 3e4]
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(power)] + [(90, None)], "chan int, p double")
    keep = np.log(power)
    alive = np.flatnonzero(keep > math.log(1e-8))

    def step(at, k):
        at = at[keep[at] >= np.median(keep[at]) - math.log(1e2)]
        a, b = np.percentile(keep[at], [25, 75])
        return at[(keep[at] >= a - k * (b - a)) & (keep[at] <= b + k * (b - a))]

    before, k, rounds = 75, 1.0, 0
    while True:
        alive, rounds = step(alive, k), rounds + 1
        if len(alive) in (0, before):
            break
        before, k = len(alive), k + 0.2
    assert rounds > 2
    assert {r.chan for r in robust.auto_mask(df, k=1.0).where("ok").collect()} == set(alive.tolist())
    assert robust.auto_mask(df.where("false")).count() == 0


def test_masks_are_toggled_and_cleared(spark):
    m = spark.createDataFrame([(1, True), (2, False), (3, True)], "chan int, ok boolean")
    some = spark.createDataFrame([(1,), (2,), (2,), (9,)], "chan int")
    assert {r.chan: r.ok for r in masks.toggled(m, some).collect()} == {1: False, 2: True, 3: True}
    p = spark.createDataFrame([(1, 2.0), (2, None), (3, float("nan"))], "chan int, p double")
    assert {r.chan: r.ok for r in masks.cleared(p).collect()} == {1: True, 2: False, 3: False}


def test_jackknife_errors_agree(spark):
    x = spark.createDataFrame([(i, math.sin(0.7 * i) + 0.3 * math.cos(2.1 * i)) for i in range(10)], "pos int, x double")
    j = resample.jackknife_mean_d2(x)
    assert j.count() == math.comb(10, 2)
    values = np.array([r.x for r in x.collect()])
    s = resample.jackknife_std(x).collect()
    for r in s:
        assert r.th == pytest.approx(np.delete(values, r.pos).std(), abs=1e-12)
    bias = s[0].theta - np.mean([r.pv for r in s])
    assert bias == pytest.approx(9 * (np.mean([r.th for r in s]) - s[0].theta), abs=1e-12)


def test_bootstrap_is_repeatable_and_aligned(spark):
    x = spark.createDataFrame([(i, float(i), float(-i)) for i in range(10)], "pos long, x double, y double")
    one = resample.resampled(x, 10, 4).orderBy("rep", "pos").collect()
    assert one == resample.resampled(x, 10, 4).orderBy("rep", "pos").collect()
    assert len(one) == 40 and all(r.x == -r.y for r in one)


def test_random_combinations():
    found = resample.random_combinations(6, 3, 20)
    assert len(set(found)) == 20 == math.comb(6, 3)
    with pytest.raises(ValueError):
        resample.random_combinations(4, 2, 7)


def test_graph_identities(spark):
    rng = np.random.default_rng(0)
    pts = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(30)], "i long, v array<double>")
    e = graph.knn(pts, 4)
    g = graph.knn_graph(e).cache()
    sums = lambda d: {r.i: r.s for r in d.groupBy("i").agg(F.sum("w").alias("s")).collect()}
    assert all(v == pytest.approx(1) for v in sums(graph.markov(g)).values())
    assert all(abs(v) < 1e-9 for v in sums(graph.laplacian(g)).values())
    b = {(r.i, r.j): r.w for r in graph.bimarkov(g).collect()}
    assert all(b[j, i] == pytest.approx(w) for (i, j), w in b.items())
    mutual = {(r.i, r.j) for r in graph.knn_graph(e, mutual=True).collect()}
    assert mutual <= {(r.i, r.j) for r in g.collect()}
    assert {(r.i, r.j, r.w) for r in graph.anisotropic(g, 0).collect()} == {(r.i, r.j, r.w) for r in graph.markov(g).collect()}


def test_knn_in_several_blocks_and_ties(spark, monkeypatch):
    pts = spark.createDataFrame([(i, [float(i // 2), 0.0]) for i in range(40)], "i long, v array<double>")
    whole = graph.knn(pts, 3).collect()
    monkeypatch.setattr(graph, "BLOCK", 7)
    assert sorted(whole) == sorted(graph.knn(pts, 3).collect())
    first = {r.i: r.j for r in whole if r["rank"] == 1}
    assert first[0] == 1 and first[1] == 0


def _all_pairs(rows, k):
    """i, rank, j of the k nearest in plain Python."""
    sound = [(i, v) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for i in {i for i, _ in sound}:
        near = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(v, w))), j) for n, v in sound if n == i for j, w in sound if j != i)
        out |= {(i, rank, j) for rank, (_, j) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize("kind", ["plain", "equal", "offset", "near copies", "huge", "tiny", "far point", "one hot", "odd"])
def test_knn_of_every_scale(spark, monkeypatch, kind):
    """Cells in single precision agree with all pairs, whatever the points' scale, copies and missing values."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 5))
    v = {"equal": np.repeat(v[:5], 30, axis=0), "offset": v * 1e-3 + 1e4, "near copies": v[:1] + 1e-9 * v, "huge": v * 1e150, "tiny": v * 1e-120, "far point": np.vstack([v[1:], [1e40] * 5]), "one hot": np.eye(5)[np.arange(150) % 5]}.get(kind, v)
    rows = [(n, x.tolist()) for n, x in enumerate(v)]
    if kind == "odd":
        rows += [(None, [0.0] * 5), (900, None), (901, [None, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] * 5), (903, [math.inf] * 5), (7, v[8].tolist()), (8, v[8].tolist())]
    monkeypatch.setattr(graph, "BLOCK", 40)
    got = graph.knn(spark.createDataFrame(rows, "i long, v array<double>"), 4)
    assert {(r.i, r["rank"], r.j) for r in got.collect()} == _all_pairs(rows, 4)


def test_neighbours_are_searched_once_and_copies_stay_few(spark, monkeypatch):
    """A graph takes its edges several times; what is searched is no part of its plan.  Equal points are not all candidates."""
    monkeypatch.setattr(graph, "BLOCK", 50)
    pts = spark.createDataFrame([(n, [1.0, 2.0]) for n in range(200)], "i long, v array<double>")
    assert graph._near(pts, 3, None).count() <= 200 * 3 * 4
    for g in (graph.bimarkov, graph.anisotropic, graph.normalized_laplacian):
        plan = g(graph.knn_graph(graph.knn(pts, 3)))._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan
    assert graph.eps_edges(pts, 0.5, 1.0).count() == 200 * 199


def test_fence_edges(spark):
    x = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 5.0), ("b", 5.0), ("a", None)], "g string, v double")
    kept = robust.fenced(x, "v", ["g"], 1.5)
    assert {r.v for r in kept.where("inlier and g = 'a'").collect()} == {1.0, 2.0, 3.0, 4.0}
    assert kept.where("inlier and g = 'b'").count() == 2
    assert kept.where("v is null and not inlier").count() == 1
    assert robust.fenced(x.where("false"), "v", ["g"], 1.5).count() == 0


def test_pairs_under_eps_in_several_cells(spark, monkeypatch):
    """Both orders of each pair, from one comparison."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(150, 3))
    monkeypatch.setattr(graph, "BLOCK", 40)
    pts = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)] + [(3, v[9].tolist()), (500, [math.nan] * 3)], "i long, v array<double>")
    got = sorted((r.i, r.j, r.w) for r in graph.eps_edges(pts, 0.9, 0.0).collect())
    at = [*enumerate(v), (3, v[9])]
    assert got == sorted((i, j, 1.0) for i, a in at for j, b in at if i != j and math.dist(a, b) < 0.9)
    cells = graph._cells(pts, False).select("cell").distinct().count()
    assert cells == 4 * 5 // 2 and graph._cells(pts, True).select("cell").distinct().count() == 16


def test_quantiles_of_groups_of_every_kind(spark):
    rng = np.random.default_rng(5)
    rows = [("big", float(x)) for x in rng.normal(size=500)] + [("few", 1.0), ("few", 2.0)] + [("one", 3.0)] * 40 + [("none", None)] * 3 + [(None, 4.0), ("nan", math.nan), ("nan", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"a": 0.0, "b": 0.25, "c": 0.37, "d": 0.8, "e": 1.0}
    want = df.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in qs.items()])
    assert sorted(map(repr, robust.quantiles(df, "v", ["g"], **qs).collect())) == sorted(map(repr, want.collect()))
    whole = df.where("g != 'nan'")
    assert robust.quantiles(whole, "v", [], **qs).collect() == whole.agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in qs.items()]).collect()


def test_a_large_group_is_in_no_single_task(spark):
    """Neither for its quantiles nor for the join with them."""
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 3001).cast("double").alias("v"))
    plan = robust.fenced(df, "v", ["g"], 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "percentile" not in robust.box(df, "v", ["g"], 0.5)._jdf.queryExecution().executedPlan().toString()


def test_auto_mask_computes_power_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    power = spark.createDataFrame([(c, float(c * c + 1)) for c in range(60)], "chan long, p double").mapInArrow(noted, "chan long, p double")
    assert robust.auto_mask(power, k=0.5).where("ok").count() < 60
    assert seen.value <= 2 * 60


def test_constant_channel_is_bad(spark):
    p = spark.createDataFrame([(0, 1.0), (1, 1.1), (2, 0.9), (3, 0.0), (4, None)], "chan int, p double")
    ok = {r.chan: r.ok for r in robust.bad_channels(p).collect()}
    assert ok == {0: True, 1: True, 2: True, 3: False, 4: False}


def test_mask_is_not_replaced_silently(spark, tmp_path):
    m = spark.createDataFrame([(1, True)], "chan int, ok boolean")
    folder = masks.stash(m, "a", str(tmp_path))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        masks.stash(m, "a", folder)
    masks.stash(m, "a", folder, overwrite=True)
    assert masks.lookup(spark, folder, "a").count() == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(-10, 30), st.integers(1, 25))
def test_safe_slice(spark, start, num):
    x = [float(t * t) for t in range(12)]
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate(x)], "chan int, t long, x double")
    line = lambda t: x[0] + t * (x[1] - x[0]) if t < 0 else x[11] + (t - 11) * (x[11] - x[10]) if t > 11 else x[t]
    got = {r.pos: r.x for r in views.safe_slice(df, start, num).collect()}
    assert got == {p: line(start + p) for p in range(num)}
    zero = {r.pos: r.x for r in views.safe_slice(df, start, num, 0.0).collect()}
    assert zero == {p: x[start + p] if 0 <= start + p < 12 else 0.0 for p in range(num)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=12))
def test_interval_overlap(spark, ends):
    rows = [(k, float(min(e)), float(max(e))) for k, e in enumerate(ends)]
    got = {r.k for r in views.interval_overlap(spark.createDataFrame(rows, "k int, a double, b double"), 5, 10).collect()}
    assert got == {k for k, a, b in rows if a <= 10 and b >= 5}


def test_overlapped_blocks(spark):
    x = series(spark, 23, 1)
    b = {r.block_id: r.n for r in views.overlapped(x, 10, 5, 22).groupBy("block_id").agg(F.count("*").alias("n")).collect()}
    assert b == {0: 10, 1: 10, 2: 10}
    back = views.overlap_add(views.overlapped(x, 10, 5, 22).withColumn("w", F.lit(1.0)))
    want = {r.t: r.x for r in x.collect()}
    assert all(r.y == pytest.approx(want[r.t]) for r in back.collect())


def test_fit_recovers_a_model():
    x = np.linspace(0.5, 8, 16)
    y = 0.2 + 0.8 * (1 - special.matern(x, 2.0, 1.5))
    p = spatial.fit_matern(x, y, np.ones(16), 1.5)
    assert p["theta"] == pytest.approx(2, rel=0.05) and p["nugget"] == pytest.approx(0.2, abs=0.03) and p["loss"] < 1e-4
    r = spatial.effective_range(p, 0.9)
    assert 0.9 == pytest.approx(p["nugget"] + (p["sill"] - p["nugget"]) * (1 - special.matern(np.array([r]), p["theta"], p["nu"])[0]), abs=1e-6)


def test_upsample_passes_through_samples(spark):
    x = series(spark, 12, 1)
    got = {round(r.t, 6): r.x for r in numeric.upsample(x, 3).collect()}
    assert all(got[float(r.t)] == pytest.approx(r.x) for r in x.collect())


def test_long_splines(spark):
    x = spark.createDataFrame([(0, t, math.sin(t / 50)) for t in range(20_000)], "chan int, t long, x double")
    got = numeric.upsample(x, 2).where("t > 100 and t < 19800").collect()
    assert max(abs(r.x - math.sin(r.t / 50)) for r in got) < 1e-6


def test_lloyd_bins():
    assert spatial.lloyd([1.0, 1.1, 5.0, 5.2], 3.0) == pytest.approx([1.05, 5.1])
