"""Connectors read back, feedback signals, catalogues, learned weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import models, scalar
from tidemark.operators import evaluate, graph, health, learning
from tidemark.plans import q_evaluate, q_tasks
from tidemark.plans import views as v
from tidemark.plans.registry import query
from tidemark.plans.sqlviews import using
from tidemark.sources import payloads, readers, writers
from tidemark.sources.tiers import TierStore
from tidemark.storage import temporary


_path = temporary


@query(using("vec") + "SELECT id, len(embedding) AS width FROM vec WHERE id IN (SELECT fragment_id FROM recall_candidates WHERE tier = 'L3')")
def s5_vector_point_query(spark: SparkSession, d: str) -> DataFrame:
    wanted = v.table(spark, d, "recall_candidates").where("tier = 'L3'").select(F.col("fragment_id").alias("id"))
    return v.embeddings(spark, d).join(wanted, "id", "left_semi").select("id", F.size("embedding").cast("bigint").alias("width"))


@query(using("fragments") + "SELECT id, namespace, content, importance FROM fragments")
def s7_json_objects(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "archive")
    writers.archive(v.fragments(spark, d).select("id", "namespace", "content", "importance"), path)
    return readers.fragments(spark, path).select("id", "namespace", "content", "importance")


@query(using("checkpoints") + "SELECT task_id, count(*) AS n FROM checkpoints WHERE concat('checkpoints/', task_id, '/', checkpoint_id) LIKE 'checkpoints/1%' GROUP BY 1")
def s8_prefix_listing(spark: SparkSession, d: str) -> DataFrame:
    c = v.checkpoints(spark, d).withColumn("key", F.concat(F.lit("checkpoints/"), "task_id", F.lit("/"), "checkpoint_id"))
    return c.where(F.col("key").startswith("checkpoints/1")).groupBy("task_id").agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS caseId, o_orderpriority AS question FROM orders")
def s13_dataset_scan(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "dataset")
    v.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("caseId"), F.col("o_orderpriority").alias("question")).write.json(path)
    return readers.records(spark, path, "caseId string, question string")


@query("SELECT p_type AS namespace, count(*) AS cases, count(DISTINCT p_brand) AS tags FROM part GROUP BY 1")
def s15_case_sets(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "cases")
    p = v.table(spark, d, "part")
    p.select(F.col("p_partkey").cast("string").alias("caseId"), F.col("p_type").alias("namespace"), F.array("p_brand").alias("tags")).write.json(path)
    c = readers.case_set(spark, path)
    return c.groupBy("namespace").agg(F.count("*").alias("cases"), F.countDistinct(F.col("tags")[0]).alias("tags"))


@query(using("checkpoints") + "SELECT kind, count(*) AS n, round(sum(size), 2) AS size FROM checkpoints GROUP BY 1")
def k12_checkpoint_write(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "checkpoints")
    writers.checkpoint(v.checkpoints(spark, d), path)
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("size"), 2).alias("size"))


@query("SELECT mode, rerank, CASE WHEN rerank AND reranker = 'NONE' THEN 'INVALID' WHEN NOT rerank THEN 'NONE' ELSE coalesce(reranker, 'LINEAR') END AS resolved FROM (SELECT unnest(['VECTOR_ONLY', 'KEYWORD_ONLY', 'HYBRID']) AS mode), (SELECT unnest([true, false]) AS rerank), (SELECT unnest(['NONE', 'LINEAR', 'CROSS_ENCODER', NULL]) AS reranker)")
def pred9_mode_resolution(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame([(a, b, c) for a in ("VECTOR_ONLY", "KEYWORD_ONLY", "HYBRID") for b in (True, False) for c in ("NONE", "LINEAR", "CROSS_ENCODER", None)], "mode string, rerank boolean, reranker string")
    out = F.when(F.col("rerank") & F.coalesce(F.col("reranker") == "NONE", F.lit(False)), "INVALID").when(~F.col("rerank"), "NONE").otherwise(F.coalesce("reranker", F.lit("LINEAR")))
    return m.select("mode", "rerank", out.alias("resolved"))


_RANKED = """, r AS (SELECT recall_id, relevant, profile, row_number() OVER (PARTITION BY recall_id, profile ORDER BY CASE profile WHEN 'active' THEN semantic WHEN 'shadow' THEN coalesce(keyword, 0) ELSE round(semantic + coalesce(keyword, 0), 9) END DESC, candidate_id) AS rank
  FROM pool, (SELECT unnest(['active', 'shadow', 'baseline']) AS profile)),
s AS (SELECT recall_id, profile, count(*) AS n, count(*) FILTER (relevant) AS used, count(*) FILTER (relevant AND rank <= 5) AS hit, coalesce(sum(1 / log2(rank + 1)) FILTER (relevant), 0) AS dcg FROM r GROUP BY 1, 2) """


@query(using("pool").rstrip() + _RANKED + """SELECT recall_id, profile, round(used / n, 6) AS grounding, round(hit / least(5, n), 6) AS selection_precision, round(CASE WHEN used = 0 THEN 0 ELSE hit / used END, 6)::DOUBLE AS coverage,
  round(CASE WHEN used = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, used + 1), lambda i: 1 / log2(i + 1))) END, 6)::DOUBLE AS ndcg FROM s""")
def b6_feedback_signals(spark: SparkSession, d: str) -> DataFrame:
    kw = F.coalesce("keyword", F.lit(0.0))
    by = F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), s.alias("score")) for p, s in (("active", F.col("semantic")), ("shadow", kw), ("baseline", F.round(F.col("semantic") + kw, 9)))))).alias("x")
    r = v.pool(spark, d).select("recall_id", "relevant", "candidate_id", by).select("recall_id", "relevant", "candidate_id", "x.*")
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("recall_id", "profile").orderBy(F.col("score").desc(), "candidate_id")))
    n = lambda c: F.sum(c.cast("bigint"))
    s = r.groupBy("recall_id", "profile").agg(F.count("*").alias("n"), n(F.col("relevant")).alias("used"), n(F.col("relevant") & (F.col("rank") <= 5)).alias("hit"), F.coalesce(F.sum(F.when(F.col("relevant"), scalar.gain(F.col("rank")))), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest("used", F.lit(1))), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda a, x: a + x)
    return s.select(
        "recall_id", "profile", F.round(F.col("used") / F.col("n"), 6).alias("grounding"), F.round(F.col("hit") / F.least(F.lit(5), "n"), 6).alias("selection_precision"),
        F.round(scalar.ratio(F.col("hit"), F.col("used")), 6).alias("coverage"), F.round(F.when(F.col("used") == 0, 0.0).otherwise(F.col("dcg") / ideal), 6).alias("ndcg"))


@query()
def b10_learned_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Mean gain of the relevant items under default and learned weights, per scenario."""
    best = q_tasks.b3_exp3_fold(spark, d).select(F.concat(F.lit("s"), (F.row_number().over(Window.orderBy("scenario")) - 1).cast("string")).alias("scenario"), (F.col("best_arm") + 1).alias("arm"))  # 5 rows
    w = best.join(F.broadcast(learning.arms(spark)), "arm")
    p = v.pool(spark, d).withColumn("scenario", F.concat(F.lit("s"), F.col("recall_id") % 5)).join(F.broadcast(w), "scenario")
    rec = scalar.recency(F.col("last_access_ms"), F.lit(v.NOW_MS))
    p = p.withColumn("before", 0.3 * rec + 0.5 * F.col("semantic") + 0.2 * F.col("importance")).withColumn("after", F.col("alpha") * rec + F.col("beta") * F.col("semantic") + F.col("gamma") * F.col("importance"))
    for c in ("before", "after"):
        p = p.withColumn(f"r_{c}", F.row_number().over(Window.partitionBy("recall_id").orderBy(F.round(c, 9).desc(), "candidate_id")))
    mean = lambda c: F.round(F.avg(F.when(F.col("relevant"), scalar.gain(F.col(c)))), 6)
    return p.groupBy("scenario").agg(mean("r_before").alias("gain_before"), mean("r_after").alias("gain_after"))


@query()
def f_simplex(spark: SparkSession, d: str) -> DataFrame:
    rows = [(a / 10, b / 10, *learning.simplex(a / 10, b / 10, 1 - a / 10 - b / 10)) for a in range(0, 12) for b in range(0, 12)]
    return spark.createDataFrame(rows, "alpha double, beta double, a double, b double, c double")


@query()
def v9_initial_pages(spark: SparkSession, d: str) -> DataFrame:
    f = v.fragments(spark, d, vectors=True).where("embedding is not null")
    hot = f.where("tier = 'L1'").select("namespace").distinct().withColumn("has", F.lit(True))
    f = f.join(hot, "namespace", "left").where((F.col("tier") == "L1") | (F.col("has").isNull() & (F.col("tier") == "L2")))
    return graph.cosine_pages(f, "namespace")


@query("SELECT * FROM (VALUES ('coverage', 0, 1), ('durability', 2, 0), ('eviction', 1, 1), ('general', 0, 1), ('isolation', 1, 0), ('latency', 0, 2), ('learning', 1, 3), ('paging', 0, 1), ('prefetch', 0, 1)) t(area, critical, warning)")
def h11_signal_catalogue(spark: SparkSession, d: str) -> DataFrame:
    n = lambda s: F.sum((F.col("severity") == s).cast("int"))
    return health.signals(spark).groupBy("area").agg(n("critical").cast("int").alias("critical"), n("warning").cast("int").alias("warning"))


_CODES = [a[0] for a in health.ALERTS]
# The alerts as in the survey, apart from the table that the operator reads.
_ALERT_SQL = """('eviction_log_coverage_low', '<', 1.0, 0, 5), ('eviction_regret_high', '>', 0.05, 0, 10), ('namespace_isolation_violation', '>', 0.0, 0, 1), ('checkpoint_recovery_success_rate_low', '<', 1.0, 0, 5), ('memory_persistence_success_rate_low', '<', 1.0, 0, 5),
  ('store_latency_p99_high', '>', 10.0, 0, 15), ('recall_latency_p99_high', '>', 10.0, 0, 15), ('shadow_lift_regression', '<', -0.05, 0, 10), ('baseline_lift_low', '<', 0.20, 0, 10), ('baseline_lift_not_sustained', '<', 0.90, 0, 30), ('prefetch_strategy_degraded', '<', 0.10, 20, 15),
  ('eviction_regret_mode_high', '>', 0.10, 10, 10), ('paging_drift_high', '>', 0.50, 20, 20)"""
_SERIES = f""", se AS (SELECT list_extract({_CODES}, CAST(user_id % 13 + 1 AS INTEGER)) AS code, CAST(user_id AS VARCHAR) AS source, ts_ms, event_id AS n, value / 20 - CASE user_id % 13 WHEN 7 THEN 3 ELSE 0 END AS value, k AS samples FROM ev),
al AS (SELECT * FROM (VALUES {_ALERT_SQL}) t(code, sign, lim, least, minutes)),
co AS (SELECT se.*, minutes, CASE sign WHEN '<' THEN value < lim::DOUBLE ELSE value > lim::DOUBLE END AND (least = 0 OR samples > least) AS f FROM se JOIN al USING (code)),
ru AS (SELECT *, count(*) FILTER (NOT f) OVER (PARTITION BY code, source ORDER BY ts_ms, n ROWS UNBOUNDED PRECEDING) AS run FROM co)
SELECT code, source, min(ts_ms) AS since_ms, max(ts_ms) - min(ts_ms) AS held_ms FROM ru WHERE f GROUP BY code, source, run, minutes HAVING max(ts_ms) - min(ts_ms) >= minutes * 60000"""


@query(using("ev").rstrip() + _SERIES)
def h10_alert_rules(spark: SparkSession, d: str) -> DataFrame:
    """All alerts over series of their own."""
    e = v.events(spark, d)
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("user_id") % 13 + 1).cast("int"))
    value = F.col("value") / 20 - F.when(F.col("user_id") % 13 == 7, 3).otherwise(0)
    return health.sustained(e.select(code.alias("code"), F.col("user_id").cast("string").alias("source"), "ts_ms", F.col("event_id").alias("n"), value.alias("value"), F.col("k").alias("samples")))


@query(q_evaluate._CM + q_evaluate._STAT + "SELECT 'gate' AS rule, recall >= 0.5 AS passed FROM s UNION ALL SELECT 'shape', errors IS NOT NULL FROM s UNION ALL SELECT 'ndcg', ndcg + 1e-9 >= 0.4 FROM s")
def h7b_report_verifier(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return evaluate.rules(q_evaluate._stats(spark, d), {"gate": c("recall") >= 0.5, "shape": c("errors").isNotNull(), "ndcg": c("ndcg") + 1e-9 >= 0.4})


@query(using("checkpoints") + "SELECT CASE WHEN checkpoint_id % 11 = 0 THEN 'unknown' WHEN checkpoint_id % 4 = 0 THEN 'json' ELSE 'gzip' END AS format, CASE WHEN checkpoint_id % 11 <> 0 THEN kind END AS body_kind, count(*) AS n, round(sum(CASE WHEN checkpoint_id % 11 <> 0 THEN size END), 2) AS size, count(CASE WHEN checkpoint_id % 11 <> 0 THEN base_id END) AS bases FROM checkpoints GROUP BY 1, 2")
def s17_checkpoint_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Full and delta payloads written as bytes, most of them packed, and read back by their format."""
    path = _path(spark, "payloads")
    c = v.checkpoints(spark, d).withColumn("body", F.to_json(F.struct("kind", "size", "base_id")))
    packed = payloads.packed(c.select("task_id", "checkpoint_id", "body"))
    plain = c.select("checkpoint_id", "body")
    rows = packed.join(plain, "checkpoint_id").select("task_id", "checkpoint_id", F.when(F.col("checkpoint_id") % 11 == 0, F.encode(F.lit("?"), "utf-8")).when(F.col("checkpoint_id") % 4 == 0, F.encode("body", "utf-8")).otherwise(F.col("payload")).alias("payload"))
    rows.write.parquet(path)
    body = F.from_json("body", "kind string, size double, base_id bigint")
    back = payloads.unpacked(spark.read.parquet(path)).withColumn("b", body)
    return back.groupBy("format", F.col("b.kind").alias("body_kind")).agg(F.count("*").alias("n"), F.round(F.sum("b.size"), 2).alias("size"), F.count("b.base_id").alias("bases"))


@query("""SELECT namespace, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens FROM (SELECT o_custkey % 50 AS namespace, o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 1 END AS token_count FROM orders WHERE o_orderkey % 10 <> 0) GROUP BY 1""")
def e5_tier_store(spark: SparkSession, d: str) -> DataFrame:
    """A tier store: rows put, some replaced, some deleted, then its usage."""
    store = TierStore(spark, _path(spark, "tier"), "id bigint, namespace bigint, token_count bigint")
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("namespace"), F.lit(1).cast("bigint").alias("token_count"))
    store.put(o)
    store.put(o.where("id % 6 = 0").withColumn("token_count", F.lit(2).cast("bigint")))
    store.delete(o.where("id % 10 = 0"))
    return store.usage()


@query(using("fragments") + "SELECT id, CASE WHEN length(content) % 7 = 0 THEN 'fallback' ELSE 'primary' END AS source, 64 AS width FROM fragments")
def f_cloud_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a remote model, and of the local one for the texts that the remote one fails on."""
    f = v.fragments(spark, d).select("id", "content")
    out = models.with_fallback(f, "content", models.failing_on_length(7, 64), lambda: models.hash_embedding_of(64), 64)
    return out.select("id", "source", F.size("embedding").alias("width"))
