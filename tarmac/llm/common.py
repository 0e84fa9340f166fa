"""What the training-text operators share: reading, checkpoints, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators.graph import checkpoint as cut_lineage
from tarmac.operators.graph import shared_folder

__all__ = ["STEP_BYTES", "cut_lineage", "raw_bytes", "read_documents", "same", "shared_folder", "steps", "text_column"]

#: Bytes of text that one vectorised step takes; a longer document is a step of its own.
STEP_BYTES = 1 << 20


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column with null as the empty string."""
    return pc.fill_null(batch.column(name), "")


def steps(sizes: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Split rows into runs (from, to) of at most ``limit`` bytes, or of a single row."""
    ends = np.cumsum(sizes)
    start, n = 0, len(sizes)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, end to end, and the n+1 offsets into them."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[ends[0] : ends[-1]], ends - ends[0]


def same(left: str, right: str) -> F.Column:
    """Null-safe equality of two aliased columns."""
    return F.col(left).eqNullSafe(F.col(right))
