from pyspark.sql import functions as F

from tidemark.operators import health


def test_alerts_must_hold(spark):
    minute = 60_000
    rows = [("eviction_regret_high", "a", t * minute, t, 0.1 if t != 12 else 0.0, 0) for t in range(25)] + [("paging_drift_high", "b", t * minute, t, 0.9, 20) for t in range(60)]
    out = health.sustained(spark.createDataFrame(rows, "code string, source string, ts_ms bigint, n bigint, value double, samples int")).collect()
    assert sorted((r.source, r.since_ms // minute, r.held_ms // minute) for r in out) == [("a", 0, 11), ("a", 13, 11)]


def test_status(spark):
    r = spark.range(1).select(health.status(F.lit(True), F.lit(True)).alias("a"), health.status(F.lit(False), F.lit(True)).alias("b"), health.status(F.lit(False), F.lit(False)).alias("c")).first()
    assert tuple(r) == ("DOWN", "UP", "DEGRADED")


def test_gate(spark):
    row = dict(cases=120, errors=0, reranker_types=["CROSS_ENCODER"], pool_strategies=["VECTOR_BASELINE_TOP_40"], pool_limits=[40], models=["m"], model_versions=["1"], model_hashes=["h"], identifiable=True, recall_delta=0.03, recall_low=0.01, ndcg_delta=0.02, ndcg_low=0.0, mrr_delta=0.0, changed_rate=0.2, p95_delta_ms=10, p99_delta_ms=10, hardware="box")
    ok = health.reranker_gate(spark.createDataFrame([row])).collect()
    assert len(ok) == 16 and all(r.passed for r in ok)
    bad = health.reranker_gate(spark.createDataFrame([{**row, "recall_low": 0.0, "models": ["m", "n"]}])).where("not passed").collect()
    assert sorted(r.rule for r in bad) == ["model", "recall_interval"]


def test_catalogue(spark):
    assert health.signals(spark).count() == 16 and {a[0] for a in health.ALERTS} <= {s[0] for s in health.SIGNALS}
