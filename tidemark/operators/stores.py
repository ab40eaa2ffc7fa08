"""Store operations: scans, upserts, deletes, logs, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASK_ID = r"^[A-Za-z0-9_-]{1,128}$"


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both, the highest version of each key; at equal versions the new row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def delete(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def append_log(entries: DataFrame, task: str, *order: Column) -> DataFrame:
    """Entries with a per-task sequence from 1; malformed task ids drop out."""
    w = Window.partitionBy(task).orderBy(*order)
    return entries.where(F.col(task).rlike(TASK_ID)).withColumn("sequence_number", F.row_number().over(w).cast("bigint"))


def truncate_log(log: DataFrame, points: DataFrame) -> DataFrame:
    """Entries beyond their task's truncation point (``task_id, point``); tasks without one stay whole."""
    return log.join(points, "task_id", "left").where(F.col("point").isNull() | (F.col("seq") > F.col("point"))).drop("point")


def pending(tasks: DataFrame, done: DataFrame, key: str, *order: Column) -> DataFrame:
    """First task of every key that isn't done yet."""
    first = tasks.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    return first.join(done.select(key), key, "left_anti")


def idempotency_key(namespace: Column, own_id: Column, reason: Column) -> Column:
    return F.concat_ws(":", namespace, own_id, F.replace(F.lower(reason), F.lit(" "), F.lit("-")))


def retry_outcome(succeeded: Column, attempts: Column, most: int = 5) -> Column:
    """``recovered``, ``discarded`` when the next attempt would reach the limit, else ``retried``."""
    return F.when(succeeded, "recovered").when(attempts + 1 >= most, "discarded").otherwise("retried")


def newest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in this order, found by a distributed top-n."""
    return df.orderBy(*order).limit(n)


def checkpoint_listing(meta: DataFrame, payloads: DataFrame) -> DataFrame:
    """Metadata rows, with a bare row for every payload (``task_id, checkpoint_id``) that has none."""
    bare = payloads.join(meta, ["task_id", "checkpoint_id"], "left_anti")
    return meta.unionByName(bare, allowMissingColumns=True)


def warm_rows(df: DataFrame) -> DataFrame:
    """Rows for the vector store with ``vector``: ``l2_embedding``, else ``embedding``; rows with neither drop out."""
    return df.withColumn("vector", F.coalesce("l2_embedding", "embedding")).where("vector is not null")


def search_limits(k: Column) -> dict[str, Column]:
    """Sizes of the vector search, its fallback, the keyword pool and the keyword hits for a recall of ``k``."""
    vector = F.greatest(F.lit(16), 4 * k)
    return {"vector_limit": vector, "fallback_limit": F.greatest(vector, 8 * k), "keyword_pool": F.greatest(F.lit(32), 8 * k, F.lit(256)), "keyword_hits": vector}


def retries(queue: DataFrame, key: str, succeeds, most: int = 5) -> DataFrame:
    """Every attempt of the entries of a queue: a failed one comes back with one attempt more, up to ``most``.

    ``succeeds`` makes a condition of the attempt. Adds ``attempt`` and ``outcome``
    (``recovered``, ``retried``, ``discarded``).
    """
    tries = queue.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("_ok", succeeds(F.col("attempt")))
    first = F.min(F.when(F.col("_ok"), F.col("attempt"))).over(Window.partitionBy(key))
    tries = tries.withColumn("_first", F.coalesce(first, F.lit(most))).where(F.col("attempt") <= F.col("_first"))
    return tries.withColumn("outcome", F.when(F.col("_ok"), "recovered").when(F.col("attempt") == most, "discarded").otherwise("retried")).drop("_ok", "_first")


def log_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed JSON lines of ``task_id, line_no, line``; blank lines are skipped.

    A broken last line of a task is ignored, a broken earlier one fails the query.
    """
    parsed = lines.where(F.trim("line") != "").withColumn("e", F.from_json("line", schema, {"mode": "PERMISSIVE"}))
    bad = F.col("e").isNull() | F.coalesce(F.get_json_object("line", "$"), F.lit("")).eqNullSafe("")
    parsed = parsed.withColumn("_bad", bad)
    # judged for each task by itself, so that no filter on entries runs before it
    ends = parsed.groupBy("task_id").agg(F.max("line_no").alias("_last"), F.min(F.when(F.col("_bad"), F.col("line_no"))).alias("_first_bad"))
    fatal = F.when(F.col("_first_bad") < F.col("_last"), F.raise_error(F.concat(F.lit("broken log line in "), "task_id")).cast("boolean")).otherwise(F.lit(False))
    return parsed.where("not _bad").join(ends.where(~fatal).select("task_id"), "task_id").select("task_id", "line_no", "e.*")


def resolve_tiers(ids: DataFrame, tiers: list[DataFrame], key: str = "id") -> DataFrame:
    """Row of the first tier that holds the id, with its ``tier_no``; unknown ids drop out."""
    found = None
    for i, t in enumerate(tiers):
        t = t.join(ids.select(key), key, "left_semi").withColumn("tier_no", F.lit(i))
        found = t if found is None else found.unionByName(t)
    w = Window.partitionBy(key).orderBy("tier_no")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
