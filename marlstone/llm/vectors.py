"""Vectors as rows of float64 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches


def rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector in double precision; None where it is null, empty, zero or not all finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values
    flat = np.asarray(values.fill_null(float("nan")).to_numpy(zero_copy_only=False) if values.null_count else values.to_numpy(zero_copy_only=False), np.float64)
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for i in range(len(column)):
        v = flat[offsets[i] : offsets[i + 1]] if valid[i] else None
        out.append(v if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def _bytes(unit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in rows_of(batch.column("embedding")):
                if v is not None and unit:
                    v = v / np.abs(v).max()
                    v = v / np.sqrt(v @ v)
                out.append(None if v is None else (v + 0.0).tobytes())
            v = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v], names=["vec_id", "v"])

    return run


def as_bytes(table: DataFrame, unit: bool) -> DataFrame:
    """``(vec_id, v)`` of ``table(vec_id, embedding)``: v null where the vector takes no part, else its
    float64 bytes, scaled to length 1 if ``unit``."""
    small_batches(table.sparkSession, 4096)
    table = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return table.mapInArrow(_bytes(unit), "vec_id long, v binary")


def matrix(values) -> np.ndarray:
    """Rows of equal length from their bytes."""
    values = list(values)
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)
