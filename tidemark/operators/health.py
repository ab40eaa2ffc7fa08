"""Health signals and sustained alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Signal codes with severity, scope and area.
SIGNALS = [
    ("eviction_log_coverage_low", "warning", "slo", "coverage"),
    ("eviction_regret_high", "critical", "slo", "eviction"),
    ("namespace_isolation_violation", "critical", "slo", "isolation"),
    ("checkpoint_recovery_success_rate_low", "critical", "slo", "durability"),
    ("memory_persistence_success_rate_low", "critical", "slo", "durability"),
    ("store_latency_p99_high", "warning", "slo", "latency"),
    ("recall_latency_p99_high", "warning", "slo", "latency"),
    ("shadow_lift_regression", "warning", "slo", "learning"),
    ("baseline_lift_low", "critical", "slo", "learning"),
    ("baseline_lift_not_sustained", "warning", "slo", "learning"),
    ("prefetch_strategy_degraded", "warning", "diagnostic", "prefetch"),
    ("eviction_regret_mode_high", "warning", "diagnostic", "eviction"),
    ("paging_drift_high", "warning", "diagnostic", "paging"),
    ("learning_regression", "warning", "diagnostic", "learning"),
    ("diagnostic_warning", "warning", "diagnostic", "general"),
    ("healthy", "info", "status", "general"),
]
# Alert, comparison, threshold, least samples (0: none), minutes it must hold.
ALERTS = [
    ("eviction_log_coverage_low", "<", 1.0, 0, 5),
    ("eviction_regret_high", ">", 0.05, 0, 10),
    ("namespace_isolation_violation", ">", 0.0, 0, 1),
    ("checkpoint_recovery_success_rate_low", "<", 1.0, 0, 5),
    ("memory_persistence_success_rate_low", "<", 1.0, 0, 5),
    ("store_latency_p99_high", ">", 10.0, 0, 15),
    ("recall_latency_p99_high", ">", 10.0, 0, 15),
    ("shadow_lift_regression", "<", -0.05, 0, 10),
    ("baseline_lift_low", "<", 0.20, 0, 10),
    ("baseline_lift_not_sustained", "<", 0.90, 0, 30),
    ("prefetch_strategy_degraded", "<", 0.10, 20, 15),
    ("eviction_regret_mode_high", ">", 0.10, 10, 10),
    ("paging_drift_high", ">", 0.50, 20, 20),
]


def signals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNALS, "code string, severity string, scope string, area string")


def sustained(series: DataFrame) -> DataFrame:
    """``code, source, since_ms, held_ms``: stretches in which an alert's condition held for its time.

    ``series`` has ``code, source, ts_ms, n`` (order of equal times), ``value`` and ``samples``.
    """
    rules = series.sparkSession.createDataFrame(ALERTS, "code string, sign string, limit double, least int, minutes int")
    s = series.join(F.broadcast(rules), "code")
    on = F.when(F.col("sign") == "<", F.col("value") < F.col("limit")).otherwise(F.col("value") > F.col("limit")) & ((F.col("least") == 0) | (F.col("samples") > F.col("least")))
    w = Window.partitionBy("code", "source").orderBy("ts_ms", "n")
    s = s.withColumn("on", F.coalesce(on, F.lit(False)))
    s = s.withColumn("run", F.sum((~F.col("on")).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("on")
    g = s.groupBy("code", "source", "run", "minutes").agg(F.min("ts_ms").alias("since_ms"), (F.max("ts_ms") - F.min("ts_ms")).alias("held_ms"))
    return g.where(F.col("held_ms") >= F.col("minutes") * 60_000).select("code", "source", "since_ms", "held_ms")


def status(critical: Column, healthy: Column) -> Column:
    return F.when(critical, "DOWN").when(healthy, "UP").otherwise("DEGRADED")


def reranker_gate(row: DataFrame, development: bool = True, cases: int = 120) -> DataFrame:
    """Decision rules over a one-row comparison, ``rule, passed``.

    Consistency rules ask for one value each of type, pool strategy, pool limit
    and model; effect rules for the least deltas, interval bounds and latency.
    """
    from tidemark.operators.evaluate import rules

    c = F.col
    single = lambda name, want=None: (F.size(name) == 1) & (F.lit(True) if want is None else (F.element_at(name, 1) == want))
    return rules(
        row,
        {
            "case_count": c("cases") == cases,
            "run_errors": c("errors") == 0,
            "reranker_type": single("reranker_types", "CROSS_ENCODER"),
            "pool_strategy": single("pool_strategies", "VECTOR_BASELINE_TOP_40"),
            "pool_limit": single("pool_limits", 40),
            "model": single("models") & single("model_versions") & single("model_hashes"),
            "identifiable": c("identifiable"),
            "recall_delta": c("recall_delta") >= (0.02 if development else 0.015),
            "recall_interval": c("recall_low") > 0,
            "ndcg_delta": c("ndcg_delta") >= 0.01,
            "ndcg_interval": c("ndcg_low") >= 0,
            "mrr_delta": c("mrr_delta") >= -0.005,
            "changed_order": c("changed_rate") >= 0.1,
            "p95_delta": c("p95_delta_ms") <= 250,
            "p99_delta": c("p99_delta_ms") <= 500,
            "environment": c("hardware").isNotNull() & (F.trim("hardware") != ""),
        },
    )
