"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int = 6) -> Column:
    """``c`` to some decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def quantile(c: str, q: float) -> Column:
    """Exact linear-interpolation quantile."""
    return F.percentile(c, F.lit(q))


def fold_nan(c: str) -> Column:
    """NaN as NULL, which aggregates skip."""
    return F.when(~F.isnan(c), F.col(c))


def nw_of(bw: Column, n: Column, fs: Column) -> Column:
    """Time-bandwidth product of a bandwidth, to the nearest half (half to even)."""
    return F.bround(n / fs * bw / 2 * 2, 0) / 2


def bw_of(nw: Column, n: Column, fs: Column) -> Column:
    """Bandwidth of a time-bandwidth product."""
    return 2 * nw * fs / n


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def circular(re: Column, im: Column) -> tuple[Column, Column]:
    """A complex value shrunk to the unit circle where it is outside."""
    size = F.sqrt(re * re + im * im)
    return F.when(size > 1, re / size).otherwise(re), F.when(size > 1, im / size).otherwise(im)


def eps_map(e: Column) -> Column:
    """Squared half-sine amplitude scaling of a slider in 0 to 1."""
    return F.pow((F.sin(F.lit(3.141592653589793) * (e - 0.5)) + 1) / 2, 2)


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * F.sqrt(F.lit(2 * 3.141592653589793)))


def lcg(rep: Column, pos: Column) -> Column:
    """A 31-bit counter-based draw, the same arithmetic in any SQL dialect."""
    m = F.lit(2147483647)
    a = (rep.cast("long") * 1_000_003 + pos.cast("long") * 7_919 + 12_345) % m
    b = (a * 48_271) % m
    return (b * 48_271 + 11) % m
