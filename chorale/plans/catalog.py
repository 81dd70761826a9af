"""All registered queries of the signal library."""

from __future__ import annotations

from chorale.plans import geostat, graphs, quality, resampling, spectra, streams, viewing  # noqa: F401
from chorale.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
