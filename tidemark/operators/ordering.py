"""Numbers and running sums in order, for groups of any size.

A window over a group sorts the whole group in one task. Here the rows are
range-partitioned by group and order, so that a large group spreads over many
tasks; each task numbers its range, and the ranges' totals are added up after.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written


def numbered(df: DataFrame, group: str, order: list[str | Column], amount: str | None = None, rank: str = "rank", before: str = "before") -> DataFrame:
    """Adds the number of every row in its group, from 1, and the sum of ``amount`` (bigint) over the rows before it.

    ``order`` must leave no ties within a group. Null groups are a group. The
    parts of groups that begin in an earlier range number less than the ranges,
    so their totals are broadcast.
    """
    names = [*df.columns, "_r", "_s", "_p"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        part = pyspark.TaskContext.get().partitionId()
        last, rows, total = None, 0, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = b.column(group)
            code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            each = np.diff(np.r_[start, n])
            value = b.column(amount).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) if amount else np.zeros(n, np.int64)
            sums = np.cumsum(value) - value
            place = np.arange(n) - np.repeat(start, each) + 1
            sums = sums - np.repeat(sums[start], each)
            if last is not None and keys[0].as_py() == last[0]:
                place[: each[0]] += rows
                sums[: each[0]] += total
            last, rows, total = (keys[n - 1].as_py(),), int(place[-1]), int(sums[-1] + value[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(sums), pa.array(np.full(n, part, np.int32))], names=names)

    rows = written(df, "unordered")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    ranges = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    local = written(ranges.mapInArrow(number, kinds + ", _r bigint, _s bigint, _p int"), "ranges")
    end = F.coalesce(F.col(amount), F.lit(0)) if amount else F.lit(0)
    parts = local.groupBy(group, "_p").agg(F.max("_r").alias("n"), F.max(F.struct("_r", (F.col("_s") + end).alias("s")))["s"].alias("s"))
    w = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), F.sum("n").over(w).alias("_n"), F.sum("s").over(w).alias("_t")).where("_n is not null")
    out = local.join(F.broadcast(ahead), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")), "left")
    out = out.withColumn(rank, F.col("_r") + F.coalesce("_n", F.lit(0)))
    out = out.withColumn(before, (F.col("_s") + F.coalesce("_t", F.lit(0))).cast("bigint")) if amount else out
    return out.drop("_r", "_s", "_p", "_g", "_q", "_n", "_t")
