"""Sinks: archives, checkpoints, dead letters, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def archive(df: DataFrame, path: str, mode: str = "append") -> None:
    """Fragments as JSON lines, in a folder per namespace hash bucket."""
    df.withColumn("bucket", F.pmod(F.xxhash64("namespace"), F.lit(256))).write.partitionBy("bucket").mode(mode).option("compression", "gzip").json(path)


def checkpoint(df: DataFrame, path: str, mode: str = "append") -> None:
    """Checkpoint rows as Parquet by kind."""
    df.write.partitionBy("kind").mode(mode).parquet(path)


def action_log(df: DataFrame, path: str, mode: str = "append") -> None:
    """Entries as JSON lines, each task's in one file in order."""
    df.repartition("task_id").sortWithinPartitions("task_id", "seq").write.partitionBy("task_id").mode(mode).json(path)


def report(summary: DataFrame, path: str, title: str, limit: int = 10_000) -> str:
    """Write a small summary as JSON and return it as a Markdown table."""
    summary.coalesce(1).write.mode("overwrite").json(path)
    rows = summary.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report holds at most {limit} rows")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    head = [f"| {' | '.join(summary.columns)} |", f"|{' --- |' * len(summary.columns)}"]
    return "\n".join([f"# {title}", "", *head, *(f"| {' | '.join(map(cell, r))} |" for r in rows), ""])
