"""What the operators share: the shared folder, lineage cuts, worker paths and text views."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import fresh_path, kept, shared_dir  # noqa: F401  for the operators

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *have])


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a restart point that
    outlives any executor, and the end of the lineage before it."""
    return kept(df, name)


def input_bytes(df: DataFrame, column: str) -> int:
    """Catalyst's estimate of the size of ``df`` (file sizes for a scan); where
    it has none, the bytes in ``column``, counted."""
    plan = getattr(df, "_jdf", None)  # a session by Connect has none
    if plan is not None:
        told = int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if told < 1 << 60:
            return told
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))


def release_memory() -> None:
    """Gives freed memory back to the system, so that a worker that is kept for
    other stages does not hold what it needed for one."""
    import ctypes
    import gc
    import sys

    gc.collect()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def string_parts(col) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of an Arrow string column; nulls have length 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    n = len(col)
    if n == 0 or col.buffers()[1] is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))
