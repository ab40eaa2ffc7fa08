"""Best items of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import clean_name, finite


def top_n(df: DataFrame, group: Column, item: Column, score: Column, n: int = 5) -> DataFrame:
    """The ``n`` items of highest score in each group: ``grp, item, score, rank``.

    An item offered several times counts once, with its highest score. Equal
    scores are ordered by item, bytewise, so the result never depends on row
    order. Rows whose group or item is null, or whose score is null, NaN or
    infinite, take no part; an empty table gives an empty result. Other columns
    of ``df`` are not read, whatever their names.

    The maximum is combined before its shuffle. The rank filter becomes a group
    limit on both sides of the second shuffle, so a group of any size sends at
    most ``n`` rows from each task.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(group.alias("grp"), item.alias("item"), score.cast("double").alias("score"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("item").isNotNull() & finite(F.col("score")))
    best = rows.groupBy("grp", "item").agg((F.max("score") + F.lit(0.0)).alias("score"))
    order = Window.partitionBy("grp").orderBy(F.col("score").desc(), F.col("item"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_fragments(candidates: DataFrame, n: int = 5) -> DataFrame:
    """``top_n`` of recall candidates by namespace."""
    top = top_n(candidates, clean_name(F.col("namespace")), F.col("fragment_id"), F.col("score"), n)
    return top.select(F.col("grp").alias("namespace"), F.col("item").alias("fragment_id"), "score", "rank")
