"""Kernels that need whole series at once: FFT, adaptive weights, splines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.functions.arrow import map_arrow
from chorale.functions.columns import lcg, quantile


def packed(samples: DataFrame, keys: list[str], at: str = "t", value: str = "x") -> DataFrame:
    """One row per series, its samples in order in ``xs``."""
    s = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at, value))).alias("s"))
    return s.select(*keys, F.expr(f"transform(s, p -> p.{value})").alias("xs"))


def direct_sdf(samples: DataFrame, tapers: np.ndarray, nfft: int, keys: list[str], at: str = "t") -> DataFrame:
    """keys, taper, k, re, im: half spectra of each series under each taper.

    Every series is as long as the tapers; one of another length is an error.
    """
    n = tapers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [np.array(x, dtype=float) for x in batch.column("xs").to_pylist()]
            if not xs:
                continue
            if wrong := {len(x) for x in xs} - {n}:
                raise ValueError(f"series of {sorted(wrong)} samples, tapers of {n}")
            y = np.fft.rfft(np.stack(xs)[:, None, :] * tapers, nfft)
            m, kk, nf = y.shape
            rep = np.repeat(np.arange(m), kk * nf)
            out = {c: batch.column(c).take(pa.array(rep)) for c in keys}
            out["taper"] = pa.array(np.tile(np.repeat(np.arange(kk), nf), m).astype(np.int32))
            out["k"] = pa.array(np.tile(np.arange(nf), m * kk).astype(np.int32))
            out["re"], out["im"] = pa.array(y.real.ravel()), pa.array(y.imag.ravel())
            yield pa.RecordBatch.from_pydict(out)

    series = packed(samples, keys, at)
    types = ", ".join(f"{c} {series.schema[c].dataType.simpleString()}" for c in keys)
    return map_arrow(series, run, f"{types}, taper int, k int, re double, im double")


def adaptive(sdf: DataFrame, lam: np.ndarray, keys: list[str], rounds: int = 150) -> DataFrame:
    """keys, k, p, dof: Thomson's adaptively weighted spectrum and its degrees of freedom."""
    grouped = sdf.groupBy(*keys, "taper").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("re") ** 2 + F.col("im") ** 2).alias("p")))).alias("s"))
    series = grouped.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("taper", F.expr("transform(s, x -> x.p)").alias("p")))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in enumerate(batch.column("s").to_pylist()):
                p = np.array([r["p"] for r in s])
                lam_ = lam[: len(p), None]
                var = (2 * p[:, 1:-1].sum(axis=1) + p[:, 0] + p[:, -1]).mean() / (2 * p.shape[1] - 2)
                est = p[:2].mean(axis=0)
                for _ in range(rounds):
                    d = np.sqrt(lam_) * est / (lam_ * est + (1 - lam_) * var + 1e-300)
                    new = (d**2 * p).sum(axis=0) / (d**2).sum(axis=0)
                    if np.allclose(new, est, rtol=1e-12, atol=0):
                        break
                    est = new
                dof = 2 * (d**2).sum(axis=0) ** 2 / (d**4).sum(axis=0)
                n = len(est)
                out = {c: batch.column(c).take(pa.array([i] * n)) for c in keys}
                yield pa.RecordBatch.from_pydict(out | {"k": pa.array(np.arange(n, dtype=np.int32)), "p": pa.array(est), "dof": pa.array(dof)})

    types = ", ".join(f"{c} {series.schema[c].dataType.simpleString()}" for c in keys)
    return map_arrow(series, run, f"{types}, k int, p double, dof double")


def demodulated_power(blocks: DataFrame, tapers: np.ndarray, lam: np.ndarray, nfft: int, step: int) -> DataFrame:
    """chan, block_id, pos, k, p: power of complex demodulates at points ``step`` apart."""
    n = tapers.shape[1]
    at = ((np.arange(n // step) + 0.5) * step).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column("xs").to_pylist()):
                if len(x) != n:
                    raise ValueError(f"a block of {len(x)} samples, tapers of {n}")
                x = np.array(x) - np.mean(x)
                y = np.fft.rfft(x * tapers, nfft) * np.sqrt(lam)[:, None]
                p = 2 * np.abs(y.T @ tapers[:, at]) ** 2 / len(lam)
                nf, m = p.shape
                out = {c: batch.column(c).take(pa.array([i] * (nf * m))) for c in ("chan", "block_id")}
                yield pa.RecordBatch.from_pydict(out | {"pos": pa.array(np.tile(np.arange(m), nf)), "k": pa.array(np.repeat(np.arange(nf), m).astype(np.int32)), "p": pa.array(p.ravel())})

    series = packed(blocks, ["chan", "block_id"], "pos")
    return map_arrow(series, run, f"chan {series.schema['chan'].dataType.simpleString()}, block_id long, pos long, k int, p double")


def upsample(samples: DataFrame, factor: int) -> DataFrame:
    """chan, t, x: natural cubic spline with ``factor`` points per sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column("xs").to_pylist()):
                y = np.array(x, dtype=float)
                n = len(y)
                m = np.zeros(n)
                if n > 2:
                    # bends m[i-1] + 4 m[i] + m[i+1]: one sweep down, one back
                    bend, low = (6 * (y[2:] - 2 * y[1:-1] + y[:-2])).tolist(), [0.25] * (n - 2)
                    bend[0] /= 4
                    for j in range(1, n - 2):
                        low[j] = 1 / (4 - low[j - 1])
                        bend[j] = (bend[j] - bend[j - 1]) * low[j]
                    for j in range(n - 4, -1, -1):
                        bend[j] -= low[j] * bend[j + 1]
                    m[1:-1] = bend
                t = np.arange((n - 1) * factor + 1) / factor
                k = np.minimum(t.astype(int), max(0, n - 2))
                u = t - k
                nxt = np.minimum(k + 1, n - 1)
                v = y[k] * (1 - u) + y[nxt] * u + ((1 - u) ** 3 - (1 - u)) * m[k] / 6 + (u**3 - u) * m[nxt] / 6
                yield pa.RecordBatch.from_pydict({"chan": batch.column("chan").take(pa.array([i] * len(t))), "t": pa.array(t), "x": pa.array(v)})

    series = packed(samples, ["chan"])
    return map_arrow(series, run, f"chan {series.schema['chan'].dataType.simpleString()}, t double, x double")


def median_ci(df: DataFrame, reps: int, ci: float = 0.95) -> DataFrame:
    """g, med, lo, hi: median of each group and the interval of its bootstrap medians.

    A median only needs how often each of the sorted distinct values is drawn,
    and a draw only its rank, so draws are a few numbers per replicate: the
    median of n draws is the value at a rank that follows a beta law, here by
    its normal limit around n / 2 from a counter-based uniform.
    """
    n = df.groupBy("g").agg(F.count("x").alias("n"), quantile("x", 0.5).alias("med"))
    rep = n.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    u = (lcg(F.col("rep"), F.lit(1)) + 1) / F.lit(2147483648.0)
    v = (lcg(F.col("rep"), F.lit(2)) + 1) / F.lit(2147483648.0)
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)
    frac = F.least(F.greatest(0.5 + z / (2 * F.sqrt("n")), F.lit(0.0)), F.lit(1.0))
    ranks = rep.select("g", "rep", "n", "med", F.floor(frac * (F.col("n") - 1)).alias("r"))
    counts = df.where("x is not null").groupBy("g", "x").agg(F.count("*").alias("c"))
    upto = F.expr("sum(c) over (partition by g order by x)")
    cum = counts.withColumn("b", upto).withColumn("a", F.col("b") - F.col("c"))
    got = ranks.join(cum, "g").where("r >= a and r < b")
    return got.groupBy("g", "med").agg(quantile("x", (1 - ci) / 2).alias("lo"), quantile("x", (1 + ci) / 2).alias("hi"))
