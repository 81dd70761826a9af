"""Arrow-batched functions whose code the executors import from this package."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

ROOT = str(Path(__file__).resolve().parents[2])


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow with this package on the workers' path."""
    env = df.sparkSession.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return df.mapInArrow(fn, schema)
