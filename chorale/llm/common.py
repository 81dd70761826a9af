"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset, a local
    master, as in tests, gets a temporary one; on a cluster it is an error, as
    executors would write where others cannot read.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints and read it again."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def named(column: str) -> Column:
    """The top-level column of that very name, whatever signs it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def keyed_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id and text (null: empty), whatever else ``docs`` has."""
    return docs.select(named(doc_id).alias("doc_id"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text"))


#: Bytes of an Arrow batch, about; a row larger than that is a batch of its own.
BATCH_BYTES = 2 << 20

#: By module, how to let go of what it keeps in a Python worker from one task to the next.
_keepers: dict[str, Callable[[], None]] = {}


def keeps(module: str, forget: Callable[[], None]) -> None:
    """Have ``forget`` drop what ``module`` keeps in a Python worker, once a task of another module runs there."""
    _keepers[module] = forget


def make_room(module: str) -> None:
    """Drop what modules other than ``module`` keep in this process, and give free memory back to the system.

    Workers go from one operator to the next, and share an executor's memory
    with each other and its JVM.
    """
    for owner, forget in _keepers.items():
        if owner != module:
            forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with this package importable on the executors.

    Batches are bounded in bytes, by the session's setting, as texts are of
    very different lengths; both sides of the pipe hold whole batches.  Before
    and after a task the worker lets go of what it does not need.
    """
    module = fn.__module__

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(module)
        yield from fn(batches)
        make_room(module)

    spark = df.sparkSession
    workers_import(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(lean, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with about ``most`` bytes of text, and their texts as bytes.

    One text longer than that makes a run of its own.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).cast(pa.large_binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at), texts.slice(at, to - at).to_pylist()
            at = to
