"""Queries on multitaper spectra.

Their oracles transform by sums over sines with the tapers written out, so
they check the relational part; the tapers have tests of their own.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from chorale.functions.columns import bw_of, circular, nw_of, rounded
from chorale.functions.special import chi2_ppf, dpss, t_ppf
from chorale.operators import multitaper, numeric, robust, spectral, views
from chorale.plans.base import query
from chorale.plans.duck import SAMPLES
from chorale.sources import tables

R = rounded
N, NW = 120, 2.5
V, LAM = dpss(N, NW, 0.9)
BN, BFFT = 40, 64
BV, BLAM = dpss(BN, NW, 0.9)
K = len(LAM)


def _values(tapers, lam, name=""):
    t = ", ".join(f"({i}, {j}, {float(v)!r}::DOUBLE)" for i, row in enumerate(tapers) for j, v in enumerate(row))
    e = ", ".join(f"({i}, {float(v)!r}::DOUBLE)" for i, v in enumerate(lam))
    return f"tap{name}(taper, pos, v) AS (VALUES {t}), eig{name}(taper, lam) AS (VALUES {e})"


_SDF = f"{SAMPLES}, {_values(V, LAM)}, d AS (SELECT chan, t, x - avg(x) OVER (PARTITION BY chan) AS x FROM samples), sdf AS (SELECT chan, taper, k, sum(x * v * cos(2 * pi() * ((k * t) % {N}) / {N})) AS re, -sum(x * v * sin(2 * pi() * ((k * t) % {N}) / {N})) AS im FROM d JOIN tap ON pos = t, (SELECT unnest(range({N // 2 + 1})) AS k) GROUP BY ALL)"
_RAW = f"{_SDF}, raw AS (SELECT chan, k, sum(lam * (re * re + im * im)) / sum(lam) AS p FROM sdf JOIN eig USING (taper) GROUP BY ALL), psd AS (SELECT chan, k, CASE WHEN k IN (0, {N // 2}) THEN p ELSE 2 * p END AS p FROM raw)"
_CSD = f"{_SDF}, cr AS (SELECT a.chan AS i, b.chan AS j, a.k, sum(lam * (a.re * b.re + a.im * b.im)) / sum(lam) AS re, sum(lam * (a.im * b.re - a.re * b.im)) / sum(lam) AS im FROM sdf a JOIN sdf b ON a.taper = b.taper AND a.k = b.k AND a.chan <= b.chan JOIN eig ON eig.taper = a.taper GROUP BY ALL), own AS (SELECT i AS c, k, re AS p FROM cr WHERE i = j)"


def _sdf(s, d):
    return numeric.direct_sdf(spectral.detrend(tables.samples(s, d), ["chan"]), V, N, ["chan"])


def _psd(s, d):
    return spectral.psd(_sdf(s, d), LAM, ["chan"], N)


@query("SELECT l_linenumber AS n, round(round_even((100.0 * l_linenumber / 50.0) * 0.7 / 2 * 2, 0) / 2, 6) + 0.0 AS nw, round(2 * (round_even((100.0 * l_linenumber / 50.0) * 0.7 / 2 * 2, 0) / 2) * 50.0 / (100.0 * l_linenumber), 6) + 0.0 AS bw FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def bw_nw(s, d):
    n = tables.load(s, d, "lineitem").select(F.col("l_linenumber").alias("n")).distinct()
    nw = nw_of(F.lit(0.7), 100.0 * F.col("n"), F.lit(50.0))
    return n.select("n", R(nw).alias("nw"), R(bw_of(nw, 100.0 * F.col("n"), F.lit(50.0))).alias("bw"))


@query()
def dpss_tapers(s, d):
    return spectral.taper_rows(s, V).join(F.broadcast(spectral.eigenvalues(s, LAM)), "taper").select("taper", "pos", R("v", 9).alias("v"), R("lam", 9).alias("lam"))


@query(f"SELECT unnest(range({N // 2 + 1})) AS k, round(unnest(range({N // 2 + 1})) * 0.5 / {N // 2}, 9) + 0.0 AS freq")
def freq_grid(s, d):
    return s.range(N // 2 + 1).select(F.col("id").alias("k"), R(F.col("id") * 0.5 / (N // 2), 9).alias("freq"))


@query(f"WITH {SAMPLES} SELECT chan, t, round(x - avg(x) OVER (PARTITION BY chan), 9) + 0.0 AS x FROM samples")
def detrend_const(s, d):
    return spectral.detrend(tables.samples(s, d), ["chan"]).select("chan", "t", R("x", 9).alias("x"))


@query(f"WITH {SAMPLES}, f AS (SELECT chan, regr_slope(x, t) m, regr_intercept(x, t) c FROM samples GROUP BY chan) SELECT chan, t, round(x - m * t - c, 6) + 0.0 AS x FROM samples JOIN f USING (chan)")
def detrend_linear(s, d):
    return spectral.detrend(tables.samples(s, d), ["chan"], "linear").select("chan", "t", R("x").alias("x"))


@query(f"WITH {_SDF} SELECT chan, taper, k, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM sdf")
def direct_sdf(s, d):
    return _sdf(s, d).select("chan", "taper", "k", R("re").alias("re"), R("im").alias("im"))


@query()
def psd_adaptive(s, d):
    return numeric.adaptive(_sdf(s, d), LAM, ["chan"]).select("chan", "k", R("p").alias("p"), R("dof").alias("dof"))


@query(f"WITH {_RAW} SELECT chan, k, round(p, 6) + 0.0 AS p FROM raw")
def psd(s, d):
    w = spectral.eigenvalues(s, LAM)
    g = _sdf(s, d).join(F.broadcast(w), "taper").groupBy("chan", "k")
    return g.agg(R(F.sum(F.col("lam") * (F.pow("re", F.lit(2.0)) + F.pow("im", F.lit(2.0)))) / F.sum("lam")).alias("p"))


@query(f"WITH {_RAW} SELECT chan, k, round(k / {float(N)}, 9) + 0.0 AS freq, round(p, 6) + 0.0 AS p FROM psd")
def psd_multitaper(s, d):
    return _psd(s, d).select("chan", "k", R("freq", 9).alias("freq"), R("p").alias("p"))


_LO, _HI = 2 * K / chi2_ppf(0.975, 2 * K), 2 * K / chi2_ppf(0.025, 2 * K)


@query(f"WITH {_RAW} SELECT chan, k, round(p * {_LO!r}::DOUBLE, 5) + 0.0 AS lo, round(p * {_HI!r}::DOUBLE, 5) + 0.0 AS hi FROM psd")
def psd_chi2_ci(s, d):
    return _psd(s, d).select("chan", "k", R(F.col("p") * _LO, 5).alias("lo"), R(F.col("p") * _HI, 5).alias("hi"))


_T = t_ppf(0.975, K - 1)


@query(f"WITH {_SDF}, r AS (SELECT chan, k, lam, lam * (re * re + im * im) AS wp FROM sdf JOIN eig USING (taper)), s AS (SELECT chan, k, {K} * ln(sum(wp) OVER w / sum(lam) OVER w) - {K - 1} * ln((sum(wp) OVER w - wp) / (sum(lam) OVER w - lam)) AS pv FROM r WINDOW w AS (PARTITION BY chan, k)), c AS (SELECT chan, k, avg(pv) m, stddev_pop(pv) / sqrt({K - 1}) AS se FROM s WHERE k > 0 GROUP BY ALL) SELECT chan, k, round(m, 6) + 0.0 AS m, round(m - {_T!r}::DOUBLE * se, 6) + 0.0 AS lo, round(m + {_T!r}::DOUBLE * se, 6) + 0.0 AS hi FROM c")
def psd_jackknife_ci(s, d):
    """Log-domain interval of the unscaled spectrum (the mean's bin has no power left)."""
    j = spectral.log_jackknife(_sdf(s, d).where("k > 0"), LAM, ["chan"])
    return j.select("chan", "k", R("m").alias("m"), R(F.col("m") - _T * F.col("se")).alias("lo"), R(F.col("m") + _T * F.col("se")).alias("hi"))


@query(f"WITH {_CSD} SELECT i, j, k, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM cr")
def csd(s, d):
    return spectral.csd(_sdf(s, d), LAM).select("i", "j", "k", R("re", 5).alias("re"), R("im", 5).alias("im"))


@query(f"WITH {_CSD} SELECT i, j, k, round(re * CASE WHEN k = 0 THEN 1 ELSE 2 END, 5) + 0.0 AS re, round(im * CASE WHEN k = 0 THEN 1 ELSE 2 END, 5) + 0.0 AS im FROM cr")
def csd_multitaper(s, d):
    return spectral.scaled_csd(spectral.csd(_sdf(s, d), LAM)).select("i", "j", "k", R("re", 5).alias("re"), R("im", 5).alias("im"))


@query(f"WITH {_CSD} SELECT i, j, cr.k, round(least((re * re + im * im) / (a.p * b.p), 1.0), 6) + 0.0 AS msc FROM cr JOIN own a ON a.c = i AND a.k = cr.k JOIN own b ON b.c = j AND b.k = cr.k WHERE i < j")
def coherence_msc(s, d):
    return spectral.coherence(spectral.csd(_sdf(s, d), LAM)).select("i", "j", "k", R("msc").alias("msc"))


_CO = f"WITH {_SDF}, pr AS (SELECT a.chan AS i, b.chan AS j, a.k, a.taper, lam * (a.re * b.re + a.im * b.im) AS re, lam * (a.im * b.re - a.re * b.im) AS im, lam * (a.re * a.re + a.im * a.im) AS pa, lam * (b.re * b.re + b.im * b.im) AS pb FROM sdf a JOIN sdf b ON a.taper = b.taper AND a.k = b.k AND a.chan < b.chan JOIN eig ON eig.taper = a.taper WHERE a.k > 0), tt AS (SELECT i, j, k, sum(re) AS re, sum(im) AS im, sum(pa) AS pa, sum(pb) AS pb FROM pr GROUP BY ALL)"


@query(f"{_CO} SELECT i, j, k, round(re / sqrt(pa * pb), 6) + 0.0 AS re, round(im / sqrt(pa * pb), 6) + 0.0 AS im FROM tt")
def coherence_complex(s, d):
    c = spectral.coherency(_sdf(s, d).where("k > 0"), LAM)
    return c.select("i", "j", "k", R("re").alias("re"), R("im").alias("im"))


_Z = "atanh(least(({re} * {re} + {im} * {im}) / ({pa} * {pb}), 1 - 1e-12))"
_OUT1 = {x: f"(tt.{x} - pr.{x})" for x in ("re", "im", "pa", "pb")}


@query(f"{_CO}, zz AS (SELECT i, j, k, {_Z.format(re='re', im='im', pa='pa', pb='pb')} AS z FROM tt), lo1 AS (SELECT pr.i, pr.j, pr.k, {_Z.format(**_OUT1)} AS z FROM pr JOIN tt ON tt.i = pr.i AND tt.j = pr.j AND tt.k = pr.k), er AS (SELECT i, j, k, sqrt({K - 1} * var_pop(z)) AS e FROM lo1 GROUP BY ALL) SELECT i, j, k, round(tanh(z), 5) + 0.0 AS msc, round(greatest(tanh(z - {_T!r}::DOUBLE * e), 0), 5) + 0.0 AS lo, round(tanh(z + {_T!r}::DOUBLE * e), 5) + 0.0 AS hi FROM zz JOIN er USING (i, j, k)")
def coherence_ci(s, d):
    """Jackknife over tapers, on Fisher's scale."""
    c = spectral.coherence_interval(_sdf(s, d).where("k > 0"), LAM, t_ppf(0.975, K - 1), fisher=True)
    return c.select("i", "j", "k", *[R(x, 5).alias(x) for x in ("msc", "lo", "hi")])


@query(f"WITH {_SDF}, xy AS (SELECT a.chan AS i, b.chan AS j, a.k AS k, sum(lam * (a.re * b.re + a.im * b.im)) / sum(lam) AS re, sum(lam * (a.im * b.re - a.re * b.im)) / sum(lam) AS im FROM sdf a JOIN sdf b ON a.taper = b.taper AND a.k = b.k AND a.chan % 2 = 0 AND b.chan % 2 = 1 JOIN eig ON eig.taper = a.taper GROUP BY ALL) SELECT i, j, k, round(re * CASE WHEN k = 0 THEN 1 ELSE 2 END, 5) + 0.0 AS re, round(im * CASE WHEN k = 0 THEN 1 ELSE 2 END, 5) + 0.0 AS im FROM xy")
def csd_xy(s, d):
    """Cross spectra of one set of channels with another."""
    x = _sdf(s, d)
    c = spectral.scaled_csd(spectral.cross_csd(x.where("chan % 2 = 0"), x.where("chan % 2 = 1"), LAM))
    return c.select("i", "j", "k", R("re", 5).alias("re"), R("im", 5).alias("im"))


@query(f"WITH {_RAW} SELECT chan, k, round(k / {float(N)}, 9) + 0.0 AS freq, round(p, 6) + 0.0 AS p, round(p * {_LO!r}::DOUBLE, 5) + 0.0 AS lo, round(p * {_HI!r}::DOUBLE, 5) + 0.0 AS hi FROM psd")
def psd_one_call(s, d):
    e = multitaper.Estimator(N, nw=NW, low_bias=0.9)
    return e.psd(tables.samples(s, d), ci=0.95).select("chan", "k", R("freq", 9).alias("freq"), R("p").alias("p"), R("lo", 5).alias("lo"), R("hi", 5).alias("hi"))


@query(f"WITH {_CSD} SELECT i, j, cr.k, round(greatest((a.p + b.p) / 2 - abs(re), 0.0), 5) + 0.0 AS s FROM cr JOIN own a ON a.c = i AND a.k = cr.k JOIN own b ON b.c = j AND b.k = cr.k WHERE i < j")
def semiherence(s, d):
    return spectral.semiherence(spectral.csd(_sdf(s, d), LAM)).select("i", "j", "k", R("s", 5).alias("s"))


@query(f"WITH {_SDF} SELECT a.k AS f1, b.k AS f2, round((power(sum(a.re * b.re + a.im * b.im), 2) + power(sum(a.im * b.re - a.re * b.im), 2)) / (sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im)), 6) + 0.0 AS msc FROM sdf a JOIN sdf b ON a.taper = b.taper AND a.chan = 0 AND b.chan = 1 GROUP BY ALL")
def dual_spectrum(s, d):
    return spectral.dual_spectrum(_sdf(s, d), 0, 1).select("f1", "f2", R("msc").alias("msc"))


_STEP = int(N // (2 * NW))
_G = ", ".join(f"({i}, {pt}, {float(V[i, int((pt + 0.5) * _STEP)] * math.sqrt(LAM[i]))!r}::DOUBLE)" for i in range(K) for pt in range(N // _STEP))
_DM = f"{_SDF}, g(taper, pt, g) AS (VALUES {_G}), dm AS (SELECT chan, k, pt, sum(re * g) AS re, sum(im * g) AS im FROM sdf JOIN g USING (taper) GROUP BY ALL)"
_D = V * np.sqrt(LAM)[:, None]
_SCALE = float(N / (np.einsum("im,jm,km->ijk", _D, _D, _D) ** 2).sum())
_BI = f"{_DM}, tp AS (SELECT a.chan, a.k AS f1, b.k AS f2, {_SCALE!r}::DOUBLE * ((a.re * b.re - a.im * b.im) * c.re + (a.re * b.im + a.im * b.re) * c.im) AS re, {_SCALE!r}::DOUBLE * ((a.re * b.im + a.im * b.re) * c.re - (a.re * b.re - a.im * b.im) * c.im) AS im FROM dm a JOIN dm b ON a.chan = b.chan AND a.pt = b.pt AND b.k <= a.k AND a.k + b.k < {N // 2 + 1} JOIN dm c ON c.chan = a.chan AND c.pt = a.pt AND c.k = a.k + b.k WHERE a.k > 0 AND b.k > 0)"


def _demod(s, d):
    return spectral.demodulate(_sdf(s, d), LAM, V, _STEP)


def _bispectrum(s, d):
    return spectral.bispectrum(spectral.triple_products(_demod(s, d).where("k > 0"), N // 2 + 1, _SCALE))


@query(f"WITH {_DM} SELECT chan, k, pt, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM dm")
def complex_demod(s, d):
    return _demod(s, d).select("chan", "k", "pt", R("re").alias("re"), R("im").alias("im"))


@query(f"WITH {_BI} SELECT chan, f1, f2, round(avg(re), 3) + 0.0 AS re, round(avg(im), 3) + 0.0 AS im FROM tp GROUP BY ALL")
def bispectrum(s, d):
    return _bispectrum(s, d).select("chan", "f1", "f2", R("re", 3).alias("re"), R("im", 3).alias("im"))


@query(f"WITH {_BI} SELECT chan, f1, f2, round(sqrt(power(avg(re), 2) + power(avg(im), 2)) / sqrt(avg(re * re + im * im)), 6) + 0.0 AS bic FROM tp GROUP BY ALL")
def bicoherence(s, d):
    return _bispectrum(s, d).select("chan", "f1", "f2", R("bic").alias("bic"))


@query(f"WITH {_DM} SELECT chan, k, pt, round(CASE WHEN re * re + im * im > 1 THEN re / sqrt(re * re + im * im) ELSE re END, 6) + 0.0 AS re, round(CASE WHEN re * re + im * im > 1 THEN im / sqrt(re * re + im * im) ELSE im END, 6) + 0.0 AS im FROM dm WHERE k > 0")
def circ_clip(s, d):
    re, im = circular(F.col("re"), F.col("im"))
    return _demod(s, d).where("k > 0").select("chan", "k", "pt", R(re).alias("re"), R(im).alias("im"))


@query(f"SELECT f, min(k) AS k FROM (SELECT unnest(range({N // 2 + 1})) AS k) JOIN (SELECT DISTINCT l_discount * 3 AS f FROM lineitem) ON k / {float(N)} >= f GROUP BY f")
def freq_pick(s, d):
    """Left insertion into the frequency grid: the first bin at or above a frequency."""
    f = tables.load(s, d, "lineitem").select((F.col("l_discount") * 3).alias("f")).distinct()
    k = F.ceil(F.col("f") * N)
    exact = F.when((k - 1) / float(N) >= F.col("f"), k - 1).when(k / float(N) >= F.col("f"), k).otherwise(k + 1)
    return f.withColumn("k", exact).where(F.col("k") <= N // 2)


@query(f"WITH {SAMPLES}, g AS (SELECT unnest(range(-96, 239)) AS p) SELECT chan, p + 96 AS pos, round(x, 6) + 0.0 AS x FROM g JOIN samples ON t = CASE WHEN p < 0 THEN -p WHEN p > 119 THEN 238 - p ELSE p END")
def reflect_pad(s, d):
    """An exact multiple of 24 samples mirrored before, all but one after, edges once."""
    x = tables.samples(s, d)
    t = F.col("t")
    places = F.array_distinct(F.array(t, F.when(t.between(1, 96), -t), F.when(t < N - 1, 2 * (N - 1) - t)))
    return x.select("chan", "x", F.explode(F.array_compact(places)).alias("p")).select("chan", (F.col("p") + 96).alias("pos"), R("x").alias("x"))


_BL = f"{SAMPLES}, {_values(BV, BLAM)}, ov AS (SELECT chan, b AS block_id, t - 30 * b AS pos, x FROM samples, (SELECT unnest(range(3)) AS b) WHERE t >= 30 * b AND t < 30 * b + {BN}), d AS (SELECT chan, block_id, pos, x - avg(x) OVER (PARTITION BY chan, block_id) AS x FROM ov), sdf AS (SELECT chan, block_id, taper, k, sum(x * v * cos(2 * pi() * ((k * pos) % {BFFT}) / {BFFT})) AS re, -sum(x * v * sin(2 * pi() * ((k * pos) % {BFFT}) / {BFFT})) AS im FROM d JOIN tap USING (pos), (SELECT unnest(range({BFFT // 2 + 1})) AS k) GROUP BY ALL), b0 AS (SELECT chan, block_id, k, sum(lam * (re * re + im * im)) / sum(lam) AS p FROM sdf JOIN eig USING (taper) GROUP BY ALL), bp AS (SELECT chan, block_id, k, CASE WHEN k IN (0, {BFFT // 2}) THEN p ELSE 2 * p END AS p FROM b0)"
_FB = _BL.replace("t - 30 * b", f"t - {BN} * b").replace("t >= 30 * b AND t < 30 * b +", f"t >= {BN} * b AND t < {BN} * b +")


def _block_psd(s, d, hop):
    b = spectral.detrend(views.overlapped(tables.samples(s, d), BN, hop, N - 1), ["chan", "block_id"])
    return spectral.psd(numeric.direct_sdf(b, BV, BFFT, ["chan", "block_id"], "pos"), BLAM, ["chan", "block_id"], BFFT)


@query(f"WITH {_BL} SELECT chan, block_id, 30.0 * block_id + {BN / 2} AS tx, k, round(p, 6) + 0.0 AS p FROM bp")
def spectrogram_basic(s, d):
    return _block_psd(s, d, 30).select("chan", "block_id", (30.0 * F.col("block_id") + BN / 2).alias("tx"), "k", R("p").alias("p"))


@query()
def spectrogram_ola(s, d):
    """Demodulated power of overlapping blocks, added up under a Hamming window."""
    step = BN // 5
    w = np.hamming(BN // step)
    b = views.overlapped(tables.samples(s, d), BN, step * 3, N - 1)
    p = numeric.demodulated_power(b, BV, BLAM, BFFT, step)
    w_ = p.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in w]), (F.col("pos") + 1).cast("int"))).withColumn("t", F.col("block_id") * 3 + F.col("pos"))
    g = w_.groupBy("chan", "k", "t").agg(F.sum(F.col("w") * F.col("p")).alias("s"), F.sum("w").alias("w"))
    return g.select("chan", "k", "t", R(F.col("s") / F.col("w") * BFFT).alias("p"))


@query(f"WITH {SAMPLES}, w AS (SELECT chan, t, x, 0.54 - 0.46 * cos(2 * pi() * (t - 5 * b) / 9.0) AS w FROM samples, (SELECT unnest(range(23)) AS b) WHERE t >= 5 * b AND t < 5 * b + 10) SELECT chan, t, round(sum(w * x) / sum(w), 6) + 0.0 AS y FROM w GROUP BY ALL")
def overlap_add(s, d):
    b = views.overlapped(tables.samples(s, d), 10, 5, N - 1)
    return views.overlap_add(b.withColumn("w", 0.54 - 0.46 * F.cos(2 * math.pi * F.col("pos") / 9.0))).select("chan", "t", R("y").alias("y"))


@query(f"WITH {_BL}, l AS (SELECT block_id, k, ln(p) AS l FROM bp WHERE p > 0 AND k > 0), m AS (SELECT k, avg(l) m, stddev_pop(l) s FROM l WHERE block_id = 0 GROUP BY k) SELECT block_id, k, round((avg(l) - any_value(m)) / any_value(s), 6) + 0.0 AS z FROM l JOIN m USING (k) GROUP BY ALL")
def norm_spectrogram(s, d):
    return spectral.normalised(_block_psd(s, d, 30).where("k > 0"), F.col("block_id") == 0).select("block_id", "k", R("z").alias("z"))


@query(f"WITH {_FB} SELECT chan, block_id, k, round(p, 6) + 0.0 AS p FROM bp")
def block_psds(s, d):
    return _block_psd(s, d, BN).select("chan", "block_id", "k", R("p").alias("p"))


@query(f"WITH {_FB}, c AS (SELECT chan, k, avg(ln(p)) AS l FROM bp WHERE k > 0 AND p > 0 GROUP BY ALL) SELECT k, round(exp(avg(l)), 6) + 0.0 AS grand, round(exp(avg(l) - stddev_pop(l)), 6) + 0.0 AS lower, round(exp(avg(l) + stddev_pop(l)), 6) + 0.0 AS upper FROM c GROUP BY k")
def logged_est(s, d):
    _, band = robust.logged(_block_psd(s, d, BN).where("k > 0"))
    return band.select("k", *[R(c).alias(c) for c in ("grand", "lower", "upper")])


@query(f"WITH {_RAW} SELECT chan, round(sum(p * p) / {float(N)}, 4) + 0.0 AS power FROM psd WHERE k / {float(N)} < 0.2 GROUP BY chan")
def band_power(s, d):
    return robust.band_power(_psd(s, d), 0.2, 1.0 / N).select("chan", R("power", 4).alias("power"))


@query(f"WITH {_RAW} SELECT chan, round(sqrt(avg(p * p) * 0.4), 6) + 0.0 AS rms, count(*) FILTER (p < 5) AS n_off FROM psd WHERE k / {float(N)} > 0.01 AND k / {float(N)} < 0.4 GROUP BY chan")
def psd_summary(s, d):
    p = _psd(s, d).where("freq > 0.01 and freq < 0.4")
    return p.groupBy("chan").agg(R(F.sqrt(F.avg(F.col("p") * F.col("p")) * 0.4)).alias("rms"), F.count_if(F.col("p") < 5).alias("n_off"))


_OUT = f"{_RAW}, c AS (SELECT chan, avg(ln(p)) AS l FROM psd WHERE k > 0 GROUP BY chan), q AS (SELECT quantile_cont(l, 0.25) a, quantile_cont(l, 0.75) b FROM c), good AS (SELECT chan FROM c, q WHERE l BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a))"


def _good(s, d):
    c = _psd(s, d).where("k > 0").groupBy("chan").agg(F.avg(F.log("p")).alias("l"))
    return robust.fenced(c, "l", [], 0.5)


@query(f"WITH {_OUT} SELECT k, round(avg(ln(p)), 6) + 0.0 AS m, round(avg(ln(p)) - stddev_pop(ln(p)), 6) + 0.0 AS lo, round(avg(ln(p)) + stddev_pop(ln(p)), 6) + 0.0 AS hi FROM psd WHERE k > 0 AND chan IN (SELECT chan FROM good) GROUP BY k")
def psd_mean_band(s, d):
    p = _psd(s, d).where("k > 0").join(_good(s, d).where("inlier").select("chan"), "chan", "left_semi").withColumn("l", F.log("p"))
    return p.groupBy("k").agg(R(F.avg("l")).alias("m"), R(F.avg("l") - F.stddev_pop("l")).alias("lo"), R(F.avg("l") + F.stddev_pop("l")).alias("hi"))


@query(f"WITH {_OUT} SELECT chan, round(l, 6) + 0.0 AS l FROM c WHERE chan NOT IN (SELECT chan FROM good)")
def psd_outliers(s, d):
    return _good(s, d).where("not inlier").select("chan", R("l").alias("l"))
