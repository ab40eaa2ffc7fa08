"""Ordered folds whose memory does not grow with a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Rows:
    """Consecutive rows of one key, by column: lists, and matrices for columns of number lists."""

    def __init__(self, columns: dict[str, list | np.ndarray], lo: int, hi: int) -> None:
        self.columns, self.lo, self.hi = columns, lo, hi

    def __len__(self) -> int:
        return self.hi - self.lo

    def __getitem__(self, name: str) -> list | np.ndarray:
        return self.columns[name][self.lo : self.hi]


def _column(c: pa.Array) -> list | np.ndarray:
    if pa.types.is_list(c.type) and pa.types.is_floating(c.type.value_type) and not c.null_count:
        flat = c.flatten().to_numpy(zero_copy_only=False)
        if len(c) and len(flat) % len(c) == 0 and (np.diff(c.offsets.to_numpy()) == len(flat) // len(c)).all():
            return flat.reshape(len(c), -1)
    return c.to_pylist()


def folded(df: DataFrame, key: str, order: list[str | Column], schema: str, start: Callable[[], dict], step: Callable[[str, dict, Rows], list[tuple] | None], finish: Callable[[str, dict], list[tuple]] | None = None) -> DataFrame:
    """Fold each key's rows in order, batch by batch; rows without key drop out.

    Rows are shuffled by key and sorted on disk as far as needed. A task reads
    each Arrow batch by column once, hands every key its rows of the batch, and
    keeps only the fold's state. ``step`` gets key, state and the next rows and
    may return output rows; ``finish`` may add some after the last row of a key.
    Output leaves the task in one batch for each batch read.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            out: list[tuple] = []
            columns = {n: _column(b.column(n)) for n in b.schema.names}
            keys = columns[key]
            code = b.column(key).dictionary_encode().indices.to_numpy()
            edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if state is None or keys[lo] != now:
                    if state is not None and finish:
                        out += finish(now, state)
                    now, state = keys[lo], start()
                out += step(now, state, Rows(columns, lo, hi)) or ()
            if out:
                yield batch(out)
        if state is not None and finish:
            yield batch(finish(now, state))

    return df.where(f"{key} is not null").repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
