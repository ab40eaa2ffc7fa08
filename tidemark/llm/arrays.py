"""Arrays of fixed size that tasks fill and the cluster folds into one.

The arrays move in chunks, so that no task holds all of them from all tasks.
Only the folded array, whose size the caller fixes, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 14


def summed(rows: DataFrame, bits: int, width: str, fold) -> np.ndarray:
    """Fold the fixed-size arrays that tasks return in chunks, then fetch the one array."""
    size = 1 << bits
    chunk = min(size, CHUNK)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = np.frombuffer(v, width)
                sums[c] = fold(sums[c], a) if c in sums else a
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "part"])

    out = np.zeros(size, width)
    for c, part in rows.repartition("chunk").mapInArrow(join, "chunk int, part binary").collect():
        out[c * chunk : (c + 1) * chunk] = np.frombuffer(part, width)
    return out


def chunks(a: np.ndarray) -> pa.RecordBatch:
    parts = [(i, a[i * CHUNK : (i + 1) * CHUNK]) for i in range(-(-len(a) // CHUNK))]
    parts = [(i, p) for i, p in parts if p.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p.tobytes() for _, p in parts], pa.binary())], names=["chunk", "part"])
