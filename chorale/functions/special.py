"""Numerical constants for the driver: tapers, quantiles, Bessel K."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=50)
def dpss(n: int, nw: float, low_bias: float | bool = True, kmax: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slepian tapers (K, n) of unit energy, and their energy concentrations.

    The eigenvectors of the symmetric tridiagonal operator that commutes with
    the band-limiting one; int(2 nw) - 1 of them at most, those concentrated
    above 0.99 with ``low_bias``, or above the value given.  Even orders have
    a positive mean, odd ones start upwards.
    """
    nw = round(2 * nw) / 2
    w = nw / n
    t = np.arange(n)
    off = t[1:] * (n - t[1:]) / 2.0
    matrix = np.diag(((n - 1 - 2 * t) / 2.0) ** 2 * math.cos(2 * math.pi * w)) + np.diag(off, 1) + np.diag(off, -1)
    k = max(1, int(2 * nw) - 1)
    tapers = np.linalg.eigh(matrix)[1][:, ::-1][:, :k].T.copy()
    for i, v in enumerate(tapers):
        sign = v.sum() if i % 2 == 0 else (n - 1 - 2 * t) @ v
        if sign < 0:
            v *= -1
    lag = t[:, None] - t[None, :]
    sinc = np.where(lag == 0, 2 * w, np.sin(2 * math.pi * w * lag) / np.where(lag == 0, 1, math.pi * lag))
    lam = np.einsum("ki,ij,kj->k", tapers, sinc, tapers)
    if low_bias:
        keep = lam > (0.99 if low_bias is True else low_bias)
        keep[0] = True
        tapers, lam = tapers[keep], lam[keep]
    return tapers[:kmax], lam[:kmax]


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def _bisect(f, target: float, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < target else (lo, mid)
    return (lo + hi) / 2


def chi2_ppf(p: float, dof: float) -> float:
    return _bisect(lambda x: gamma_cdf(dof / 2, x / 2), p, 0, dof + 50 * math.sqrt(dof) + 100)


def t_cdf(x: float, dof: float) -> float:
    """Student's t by Simpson's rule in the angle whose tangent is x / sqrt(dof)."""
    top = math.atan(x / math.sqrt(dof))
    a = np.linspace(0, top, 4001)
    y = np.cos(a) ** (dof - 1)
    area = (a[1] - a[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    return 0.5 + area * math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)


def t_ppf(p: float, dof: float) -> float:
    return _bisect(lambda x: t_cdf(x, dof), p, -1000, 1000)


_T = np.linspace(0, 30, 6001)


def bessel_k(nu: float, z: np.ndarray) -> np.ndarray:
    """Modified Bessel function of the second kind, by its integral."""
    z = np.atleast_1d(np.asarray(z, dtype=float))
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.exp(-z[:, None] * np.cosh(_T)) * np.cosh(nu * _T)
    y = np.nan_to_num(y)
    return (y[:, :-1] + y[:, 1:]).sum(axis=1) * (_T[1] - _T[0]) / 2


def matern(x: np.ndarray, theta: float, nu: float) -> np.ndarray:
    """Matérn correlation at distances ``x``; zeros for degenerate parameters."""
    x = np.asarray(x, dtype=float)
    if theta < 1e-6 or nu < 1e-2:
        return np.zeros_like(x)
    z = math.sqrt(2 * nu) * np.atleast_1d(x) / theta
    out = np.ones_like(z)
    on = z > 1e-12
    out[on] = 2 ** (1 - nu) / math.gamma(nu) * z[on] ** nu * bessel_k(nu, z[on])
    return out.reshape(x.shape)
