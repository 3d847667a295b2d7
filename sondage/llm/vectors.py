"""Vectors as packed integers: what the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond this would let sums of squares leave a long.
MOST = 1 << 27


def packed_vectors(rows: DataFrame, keep: Sequence[Column], vector_col: str, scale: int, dims: int) -> DataFrame:
    """`keep` and x, the vector's components as floor(scale * component) in little-endian 32-bit integers.

    Rows whose vector is null, has another number of components, or a null or non-finite one, are left out.
    """
    v = F.col(vector_col).cast("array<double>")
    some = F.size(v) == dims
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(some & whole).select(*keep, v.alias("__vector"))
    types = {f.name: f.dataType for f in kept.schema.fields if f.name != "__vector"}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.floor(scale * batch.column("__vector").flatten().to_numpy(zero_copy_only=False))
            if len(flat) and np.abs(flat).max() > MOST:
                raise ValueError(f"a component times {scale} is beyond {MOST}")
            data = flat.astype("<i4")
            raw = pa.Array.from_buffers(pa.binary(4 * dims), batch.num_rows, [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in types), raw], [*types, "x"])

    schema = ", ".join(f"`{n}` {t.simpleString()}" for n, t in types.items())
    return kept.mapInArrow(packed, f"{schema}, x binary")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Packed vectors as rows of 64-bit integers."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<i4").reshape(-1, dims).astype(np.int64)
