"""Multitaper estimates in one call: arguments, tapers, spectra and intervals."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.functions.special import chi2_ppf, dpss, t_ppf
from chorale.operators import numeric, spectral


def half_even(x: float) -> float:
    """To the nearest half, ties to even."""
    return round(2 * x) / 2


@dataclass
class Estimator:
    """Spectra of series of ``n`` samples at rate ``fs``.

    A bandwidth ``bw`` beats the time-bandwidth product ``nw``; ``nfft`` is
    ``n`` if None and the next power of two if "auto"; tapers stay whose
    concentration is above ``low_bias`` (True: 0.99; False: all).
    """

    n: int
    nw: float = 4.0
    bw: float | None = None
    fs: float = 1.0
    nfft: int | str | None = None
    low_bias: bool | float = True
    tapers: np.ndarray = field(init=False, repr=False)
    lam: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self.nw = half_even(self.n / self.fs * self.bw / 2 if self.bw is not None else self.nw)
        if self.nfft == "auto":
            self.nfft = 1 << (self.n - 1).bit_length()
        self.nfft = self.nfft or self.n
        least = {True: 0.99, False: -1.0}.get(self.low_bias, self.low_bias) if isinstance(self.low_bias, bool) else self.low_bias
        self.tapers, self.lam = dpss(self.n, self.nw, least)

    @property
    def bandwidth(self) -> float:
        return 2 * self.nw * self.fs / self.n

    def direct(self, samples: DataFrame, keys: list[str], detrend: str | None = "constant") -> DataFrame:
        """Direct spectra of each series, less its mean ("constant"), line ("linear") or nothing."""
        x = spectral.detrend(samples, keys, detrend) if detrend else samples
        return numeric.direct_sdf(x, self.tapers, self.nfft, keys)

    def psd(self, samples: DataFrame, keys: list[str] | None = None, detrend: str | None = "constant", adaptive: bool = False, jackknife: bool = False, ci: float | None = None) -> DataFrame:
        """keys, k, freq, p, and lo and hi with ``ci`` or ``jackknife`` (which says how; 0.95 if no ``ci``).

        Chi-squared intervals have two degrees of freedom for each taper, or
        those of the adaptive weights; jackknife ones are of the log spectrum
        over tapers, with a taper fewer degrees.
        """
        keys = keys or ["chan"]
        sdf = self.direct(samples, keys, detrend)
        at = (F.col("k") * (self.fs / self.nfft)).alias("freq")
        if adaptive:
            p = numeric.adaptive(sdf, self.lam, keys).select(*keys, "k", at, spectral.one_sided(F.col("p"), self.nfft, self.fs).alias("p"), "dof")
        else:
            p = spectral.psd(sdf, self.lam, keys, self.nfft, self.fs).withColumn("dof", F.lit(2.0 * len(self.lam)))
        level = ci or 0.95
        if jackknife:
            j = spectral.log_jackknife(sdf, self.lam, keys)
            t = t_ppf((1 + level) / 2, len(self.lam) - 1)
            edge = lambda sign: spectral.one_sided(F.exp(F.col("m") + sign * t * F.col("se")), self.nfft, self.fs)
            bounds = j.select(*keys, "k", edge(-1).alias("lo"), edge(1).alias("hi"))
            return p.join(bounds, [*keys, "k"]).select(*keys, "k", "freq", "p", "lo", "hi")
        if not ci:
            return p.select(*keys, "k", "freq", "p")
        if adaptive:
            bounds = F.pandas_udf(lambda d: d.map(lambda v: [max(1.0, v) / chi2_ppf((1 + level) / 2, max(1.0, v)), max(1.0, v) / chi2_ppf((1 - level) / 2, max(1.0, v))]), "array<double>")
            p = p.withColumn("b", bounds("dof"))
            return p.select(*keys, "k", "freq", "p", (F.col("p") * F.get("b", F.lit(0))).alias("lo"), (F.col("p") * F.get("b", F.lit(1))).alias("hi"))
        dof = 2.0 * len(self.lam)
        lo, hi = dof / chi2_ppf((1 + level) / 2, dof), dof / chi2_ppf((1 - level) / 2, dof)
        return p.select(*keys, "k", "freq", "p", (F.col("p") * lo).alias("lo"), (F.col("p") * hi).alias("hi"))

    def csd(self, x: DataFrame, y: DataFrame | None = None, detrend: str | None = "constant") -> DataFrame:
        """i, j, k, freq, re, im: of all channel pairs i <= j, or of each channel of ``x`` with each of ``y``."""
        own = self.direct(x, ["chan"], detrend)
        cross = spectral.csd(own, self.lam) if y is None else spectral.cross_csd(own, self.direct(y, ["chan"], detrend), self.lam)
        return spectral.scaled_csd(cross, self.fs).select("i", "j", "k", (F.col("k") * (self.fs / self.nfft)).alias("freq"), "re", "im")
