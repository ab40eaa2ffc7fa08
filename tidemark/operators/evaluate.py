"""Retrieval evaluation: metrics, summaries, comparisons, gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio


def ideal_gain(n: Column, most: int) -> Column:
    """Sum of the gains of ``least(n, most)`` relevant items at the head."""
    gains = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda r: F.when(r <= n, 1 / F.log2(r + 1)).otherwise(F.lit(0.0)))
    return F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)


def metrics(df: DataFrame, k: int) -> DataFrame:
    """Adds the metrics at ``k`` from ``matched, n_expected, first_rank, dcg``; all 0 without expectations."""
    none = F.col("n_expected") == 0
    out = df.withColumn("recall_hit", F.col("matched") > 0).withColumn("all_expected", ~none & (F.col("matched") == F.col("n_expected")))
    out = out.withColumn("recall", F.when(none, 0.0).otherwise(F.col("matched") / F.col("n_expected"))).withColumn("precision", F.when(none, 0.0).otherwise(F.col("matched") / k))
    out = out.withColumn("reciprocal_rank", F.when(none | F.col("first_rank").isNull(), 0.0).otherwise(1 / F.col("first_rank")))
    return out.withColumn("ndcg", F.when(none, 0.0).otherwise(F.col("dcg") / ideal_gain(F.col("n_expected"), k)))


def mode_summary(m: DataFrame, *keys: str) -> DataFrame:
    ms = "latency_ms"
    return m.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.sum(F.col("failed").cast("bigint")).alias("errors"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg(F.col("recall_hit").cast("double")), 6).alias("hit_rate"),
        F.round(F.avg(ms), 6).alias("avg_ms"), *(F.expr(f"percentile_disc({p}) within group (order by {ms})").cast("double").alias(f"p{n}_ms") for n, p in (("50", 0.5), ("95", 0.95), ("99", 0.99))),
    )


def series_summary(df: DataFrame, keys: list[str], series: list[str]) -> DataFrame:
    """One row for each key and series of latencies: samples, mean, extremes and nearest-rank percentiles; nulls are left out."""
    each = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(s).alias("series"), F.col(s).cast("double").alias("ms")) for s in series))).alias("x")).select(*keys, "x.series", "x.ms").where("ms is not null")
    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by ms)")
    g = each.groupBy(*keys, "series").agg(F.count("*").alias("samples"), F.round(F.avg("ms"), 4).alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), disc(0.5).alias("p50_ms"), disc(0.95).alias("p95_ms"), disc(0.99).alias("p99_ms"), F.round(F.expr("percentile(ms, 0.95)"), 7).alias("p95_linear"))
    return g


def result_checks(results: DataFrame, cases: DataFrame, modes: list[str]) -> DataFrame:
    """``check, n``: results of unknown cases, results listed twice for a case and mode, and cases without a mode."""
    known = cases.select("case_id").distinct()
    unknown = results.join(known, "case_id", "left_anti").select("case_id", "mode").distinct()
    twice = results.groupBy("case_id", "mode", "fragment_id").count().where("count > 1")
    have = results.select("case_id", "mode").distinct()
    lacking = known.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).join(have, ["case_id", "mode"], "left_anti")
    each = [t.agg(F.count("*").alias("n")).select(F.lit(c).alias("check"), "n") for c, t in (("unknown_case", unknown), ("duplicate_result", twice), ("missing_mode", lacking))]
    return each[0].unionByName(each[1]).unionByName(each[2])


def lift(summary: DataFrame, baseline: str, *values: str) -> DataFrame:
    """Absolute and relative difference to the baseline mode; relative is 0 for a baseline of 0."""
    base = summary.where(F.col("mode") == baseline).select(*(F.col(c).alias(f"_{c}") for c in values))
    out = summary.join(F.broadcast(base))  # one row
    cols = []
    for c in values:
        cols += [F.round(F.col(c) - F.col(f"_{c}"), 6).alias(f"{c}_lift"), F.round(ratio(F.col(c) - F.col(f"_{c}"), F.col(f"_{c}")), 6).alias(f"{c}_relative")]
    return out.select("mode", *cols)


def paired(m: DataFrame, left: str, right: str) -> DataFrame:
    """Per case, the metrics of two modes side by side."""
    cols = ["recall", "ndcg", "reciprocal_rank", "latency_ms"]
    of = lambda mode, c, name: F.max(F.when(F.col("mode") == mode, F.col(c))).alias(name)
    both = m.where(F.col("mode").isin(left, right)).groupBy("case_id").agg(*(of(left, c, f"l_{c}") for c in cols), *(of(right, c, f"r_{c}") for c in cols), F.countDistinct("mode").alias("_n"))
    return both.where("_n = 2").drop("_n")


def win_tie_loss(pairs: DataFrame) -> DataFrame:
    d = F.col("l_recall") - F.col("r_recall")
    return pairs.agg(
        F.sum((d > 0).cast("bigint")).alias("wins"), F.sum((d == 0).cast("bigint")).alias("ties"), F.sum((d < 0).cast("bigint")).alias("losses"),
        F.round(F.avg(d), 6).alias("recall_delta"), F.round(F.avg(F.col("l_ndcg") - F.col("r_ndcg")), 6).alias("ndcg_delta"), F.round(F.avg(F.col("l_reciprocal_rank") - F.col("r_reciprocal_rank")), 6).alias("mrr_delta"))


def bootstrap_interval(values: DataFrame, value: str, key: str, resamples: int = 20_000, seed: int = 20260728) -> DataFrame:
    """``mean, low, high``: 95 % interval of the mean over paired resamples.

    Each row has in each resample a Poisson weight, drawn from a generator that
    seed and key start, so a resample needs no shuffle of rows and comes out the
    same for any partitioning. Every task adds its rows into one weight and one
    sum for each resample; only these leave it. Rows without key or value drop out.
    """

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(resamples), np.zeros(resamples)
        for b in batches:
            for h, x in zip(b.column("h").to_pylist(), b.column("x").to_pylist()):
                w = np.random.Generator(np.random.Philox(key=h & (2**64 - 1))).poisson(1.0, resamples)
                n += w
                total += w * x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples, dtype=np.int32)), pa.array(n), pa.array(total)], names=["b", "n", "total"])

    rows = values.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.xxhash64(F.lit(seed), key).alias("h"), F.col(value).cast("double").alias("x"))
    means = rows.mapInArrow(weighted, "b int, n double, total double").groupBy("b").agg((F.sum("total") / F.sum("n")).alias("m"))
    ci = means.agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))
    return values.agg(F.avg(value).alias("mean")).join(F.broadcast(ci)).select(*(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


def rolling(df: DataFrame, key: list[str], order: list[Column], value: str, window: int = 512) -> DataFrame:
    """Nearest-rank percentiles of the newest ``window`` samples of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    last = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= window)
    return last.groupBy(*key).agg(F.count("*").alias("samples"), *(F.expr(f"percentile_disc({p}) within group (order by {value})").alias(n) for n, p in (("p95", 0.95), ("p99", 0.99))))


def runs(df: DataFrame, key: list[str], order: list[Column], flag: Column) -> DataFrame:
    """Numbers the unbroken runs of ``flag`` rows: adds ``flag`` and ``run``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("flag", flag).withColumn("run", F.sum((~F.col("flag")).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rules(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per check over a one-row table: ``rule, passed``."""
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()))).alias("r")).select("r.*")


def largest_remainder(groups: DataFrame, key: str, size: str, total: int, seed: str) -> DataFrame:
    """``key, quota``: ``total`` seats in proportion to size; left seats by remainder, then hash, then key."""
    whole = groups.agg(F.sum(size).alias("_all"))
    g = groups.join(F.broadcast(whole)).withColumn("_e", F.col(size) * total / F.col("_all"))
    g = g.withColumn("_f", F.floor("_e")).withColumn("_r", F.round(F.col("_e") - F.col("_f"), 9))
    left = F.lit(total) - F.sum("_f").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.col("_r").desc(), F.sha2(F.concat_ws("|", F.lit(seed), F.col(key)), 256), key))
    return g.select(key, (F.col("_f") + (place <= left).cast("bigint")).cast("bigint").alias("quota"))
