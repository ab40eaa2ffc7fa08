"""Eviction, graphs, logs, learning and prefetch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import eviction, graph, learning, log, ordering
from tidemark.plans import views as v
from tidemark.plans.registry import query
from tidemark.plans.sqlviews import NOW, using

CAP = 1_000_000
_USED = "WITH used AS (SELECT l_suppkey AS namespace, sum(l_quantity) AS used FROM lineitem GROUP BY 1), n AS (SELECT count(*) AS n FROM used), "
_Q = f"q AS (SELECT n, CAST(least(greatest(20, floor({CAP} * 0.25)), greatest(1, floor({CAP} / n))) AS BIGINT) AS hard FROM n) "


def _used(spark: SparkSession, d: str) -> DataFrame:
    return eviction.usage(v.table(spark, d, "lineitem"), "l_suppkey", "l_quantity")


@query("SELECT l_suppkey AS namespace, sum(l_quantity) AS used FROM lineitem GROUP BY 1")
def a1_namespace_usage(spark: SparkSession, d: str) -> DataFrame:
    return _used(spark, d)


@query(_USED + _Q + f"""SELECT n, hard, CAST(greatest(1, least(hard, {int(CAP * 0.15)})) AS BIGINT) AS soft, sum(least(used, hard)) AS protected, sum(greatest(0, used - hard)) AS reclaimable, greatest(0, {CAP} - sum(least(used, hard))) AS borrow_capacity FROM used, q GROUP BY 1, 2""")
def a2_quota_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return eviction.quotas(_used(spark, d), CAP)


@query(_USED + _Q + "SELECT namespace, used - hard AS excess, row_number() OVER (ORDER BY used - hard DESC, namespace) AS priority FROM used, q WHERE namespace <> 1 AND used > hard")
def a3_eviction_priority(spark: SparkSession, d: str) -> DataFrame:
    u = _used(spark, d)
    over = u.join(F.broadcast(eviction.quotas(u, CAP).select("hard"))).where("namespace <> 1 and used > hard").select("namespace", (F.col("used") - F.col("hard")).alias("excess"))
    # namespaces over quota number at most capacity / hard
    return over.withColumn("priority", F.row_number().over(Window.orderBy(F.col("excess").desc(), "namespace")).cast("bigint"))


_SCORED = f"""scored AS (SELECT *, round(0.3::DOUBLE / (1 + ln(1 + greatest(0, ({NOW} - last_access_ms) / 86400000.0::DOUBLE))) + 0.2::DOUBLE * importance, 9) AS score,
  coalesce(reasoning_chain_id, concat('__self__:', id)) AS grp, coalesce(pinned_until_ms > {NOW}, false) AS pinned FROM fragments),
groups AS (SELECT namespace, grp, sum(token_count) AS group_tokens, round(avg(score), 9) AS group_score, max(last_access_ms) AS last_ms, round(avg(importance), 9) AS importance, round(avg(score) / greatest(1, sum(token_count)), 12) AS density, bool_or(NOT pinned) AS loose FROM scored GROUP BY 1, 2) """
_S = using("fragments").rstrip() + ", " + _SCORED


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """All fragments with score, group and pin; pinned ones count in their groups but are never released."""
    score = scalar.ALPHA * scalar.recency(F.col("last_access_ms"), F.lit(v.NOW_MS)) + scalar.GAMMA * F.col("importance")
    f = v.fragments(spark, d).withColumn("score", F.round(score, 9)).withColumn("grp", scalar.group_key(F.col("reasoning_chain_id"), F.col("id")))
    return f.withColumn("pinned", scalar.is_pinned(F.col("pinned_until_ms"), F.lit(v.NOW_MS))).select("id", "namespace", "grp", "score", "pinned", "token_count", "importance", "last_access_ms")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups with their sums; ``loose`` if some member may be released."""
    g = _scored(spark, d).groupBy("namespace", "grp").agg(
        F.sum("token_count").cast("bigint").alias("group_tokens"), F.avg("score").alias("_s"), F.max("last_access_ms").alias("last_ms"),
        F.round(F.avg("importance"), 9).alias("importance"), F.bool_or(~F.col("pinned")).alias("loose"))
    density = F.round(F.col("_s") / F.greatest(F.lit(1), F.col("group_tokens")), 12)
    return g.withColumn("density", density).withColumn("group_score", F.round("_s", 9)).drop("_s")


@query(_S + "SELECT namespace, grp, CAST(group_tokens AS BIGINT) AS group_tokens, group_score, density FROM groups")
def a5_group_density(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).select("namespace", "grp", "group_tokens", "group_score", "density")


@query(_S + "SELECT namespace, grp, max(last_access_ms) AS last_ms, round(avg(importance), 9) AS importance, max_by(id, (last_access_ms, importance, id)) AS representative FROM scored GROUP BY 1, 2")
def a6_group_ref(spark: SparkSession, d: str) -> DataFrame:
    f = _scored(spark, d)
    return f.groupBy("namespace", "grp").agg(F.max("last_access_ms").alias("last_ms"), F.round(F.avg("importance"), 9).alias("importance"), F.max_by("id", F.struct("last_access_ms", "importance", "id")).alias("representative"))


_REG = """, e AS (SELECT event_id, user_id, ts_ms, CASE WHEN k % 4 = 0 THEN 'unknown' ELSE concat('m', k % 4) END AS mode FROM ev WHERE event_type = 'error'),
hit AS (SELECT DISTINCT e.event_id FROM e JOIN ev c ON c.user_id = e.user_id AND c.event_type = 'click' AND c.ts_ms BETWEEN e.ts_ms AND e.ts_ms + 3600000) """


def _regret_modes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = v.events(spark, d)
    ev = e.where("event_type = 'error'").select("user_id", "event_id", F.col("ts_ms").alias("evict_ms"), F.when(F.col("k") % 4 == 0, "unknown").otherwise(F.concat(F.lit("m"), F.col("k") % 4)).alias("mode"))
    return ev, eviction.regrets(ev, e.where("event_type = 'click'").select("user_id", F.col("ts_ms").alias("recall_ms")), "user_id")


@query(using("ev").rstrip() + _REG + "SELECT mode, count(*) AS evictions, count(hit.event_id) AS regrets, round(count(hit.event_id) / count(*), 6) AS rate FROM e LEFT JOIN hit USING (event_id) GROUP BY 1")
def a7_regret_rate(spark: SparkSession, d: str) -> DataFrame:
    ev, hits = _regret_modes(spark, d)
    g = ev.join(hits.select("event_id").distinct().withColumn("h", F.lit(1)), "event_id", "left").groupBy("mode").agg(F.count("*").alias("evictions"), F.count("h").alias("regrets"))
    return g.withColumn("rate", F.round(scalar.ratio(F.col("regrets"), F.col("evictions")), 6))


_T = "(SELECT max(ts_ms) FROM ev)"


@query(using("ev") + f"SELECT user_id, count(*) AS hits, round((1 - least(1, ({_T} - max(ts_ms)) / 86400000.0::DOUBLE)) * greatest(0.34::DOUBLE, least(1, count(*) / 3)), 6) AS protection FROM ev WHERE event_type = 'click' GROUP BY 1")
def a8_protection(spark: SparkSession, d: str) -> DataFrame:
    e = v.events(spark, d)
    g = e.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("hits"), F.max("ts_ms").alias("last"))
    g = g.join(F.broadcast(e.agg(F.max("ts_ms").alias("now"))))
    fresh = 1 - F.least(F.lit(1.0), (F.col("now") - F.col("last")) / 86_400_000.0)
    return g.select("user_id", "hits", F.round(fresh * F.greatest(F.lit(0.34), F.least(F.lit(1.0), F.col("hits") / 3)), 6).alias("protection"))


@query(_S + "SELECT s.namespace, id, row_number() OVER (PARTITION BY s.namespace ORDER BY g.density, s.score, id) AS rank FROM scored s JOIN groups g USING (namespace, grp) WHERE NOT pinned")
def w7_eviction_rank(spark: SparkSession, d: str) -> DataFrame:
    f = _scored(spark, d).where("not pinned").join(_groups(spark, d).select("namespace", "grp", "density"), ["namespace", "grp"])
    return ordering.numbered(f.select("namespace", "id", "density", "score"), "namespace", ["density", "score", "id"]).select("namespace", "id", "rank")


_GUARD = """, hits AS (SELECT fragment_id, (1 - least(1, ((SELECT max(recalled_ms) FROM candidates) - max(recalled_ms)) / 86400000.0::DOUBLE)) * greatest(0.34::DOUBLE, least(1, count(*) / 3)) AS protection FROM candidates GROUP BY 1),
guard AS (SELECT namespace, grp, coalesce(max(protection), 0) > 0 AS kept FROM scored LEFT JOIN hits ON fragment_id = id GROUP BY 1, 2) """
_SG = using("fragments", "candidates").rstrip() + ", " + _SCORED + _GUARD


@query(_SG + "SELECT namespace, grp, row_number() OVER (PARTITION BY namespace ORDER BY kept, density, grp) AS rank FROM groups JOIN guard USING (namespace, grp) WHERE loose")
def w8_regret_order(spark: SparkSession, d: str) -> DataFrame:
    """Groups by density, those with a member protected by recent recalls last."""
    c = v.candidates(spark, d)
    hits = c.groupBy(F.col("fragment_id").alias("id")).agg(F.count("*").alias("hits"), F.max("recalled_ms").alias("last")).join(F.broadcast(c.agg(F.max("recalled_ms").alias("now"))))
    hits = hits.select("id", scalar.protection(F.col("hits"), F.col("last"), F.col("now")).alias("protection"))
    kept = _scored(spark, d).select("id", "namespace", "grp").join(hits, "id", "left").groupBy("namespace", "grp").agg((F.coalesce(F.max("protection"), F.lit(0.0)) > 0).alias("kept"))
    g = _groups(spark, d).where("loose").select("namespace", "grp", "density").join(kept, ["namespace", "grp"])
    return ordering.numbered(g, "namespace", ["kept", "density", "grp"]).select("namespace", "grp", "rank")


@query(_S + """SELECT namespace, grp, place FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY last_ms, importance, grp) AS place, coalesce(sum(group_tokens) OVER (PARTITION BY namespace ORDER BY last_ms, importance, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM groups WHERE loose) WHERE place <= 64 AND before < 500""")
def w9_cold_first(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("last_ms"), F.col("importance"), F.col("grp")]
    # the first 64 of a namespace are cut before and after the shuffle; only they are summed
    w = Window.partitionBy("namespace").orderBy(*order)
    g = _groups(spark, d).where("loose").withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 64")
    return eviction.until_target(g, ["namespace"], order, "group_tokens", 500).select("namespace", "grp", "place")


@query(using("ev") + "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k DESC, ts_ms, event_id) AS r FROM ev) WHERE r <= 500")
def w10_prefetch_queue(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.col("k").desc(), "ts_ms", "event_id")
    return v.events(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 500").select("event_type", "event_id")


@query(_S + "SELECT namespace, grp, before FROM (SELECT *, CAST(coalesce(sum(group_tokens) OVER (PARTITION BY namespace ORDER BY density, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM groups WHERE loose) WHERE before < 300")
def t2_release_target(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark, d).where("loose").select("namespace", "grp", "density", "group_tokens")
    return ordering.numbered(g, "namespace", ["density", "grp"], "group_tokens").where("before < 300").select("namespace", "grp", "before")


_FLOOR = """, o AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY density, grp) AS r, sum(group_tokens) OVER (PARTITION BY namespace) AS total FROM groups WHERE loose),
f AS (SELECT namespace, r, grp, group_tokens, total, total - group_tokens >= 200 AS taken, CASE WHEN total - group_tokens >= 200 THEN group_tokens ELSE 0 END AS done FROM o WHERE r = 1
  UNION ALL SELECT o.namespace, o.r, o.grp, o.group_tokens, o.total, f.done < 300 AND o.total - f.done - o.group_tokens >= 200, f.done + CASE WHEN f.done < 300 AND o.total - f.done - o.group_tokens >= 200 THEN o.group_tokens ELSE 0 END FROM f JOIN o ON o.namespace = f.namespace AND o.r = f.r + 1)
SELECT namespace, grp, CAST(group_tokens AS BIGINT) AS released FROM f WHERE taken"""


@query(_S.rstrip() + _FLOOR)
def t3_group_evict(spark: SparkSession, d: str) -> DataFrame:
    return eviction.evict_with_floor(_groups(spark, d).where("loose"), target=300, floor=200)


@query(using("pages") + "SELECT namespace, page_id FROM (SELECT *, sum(50 * n) OVER (PARTITION BY namespace ORDER BY last_ms, page_id ROWS UNBOUNDED PRECEDING) - 50 * n AS before FROM (SELECT namespace, page_id, count(*) AS n, max(last_access_ms) AS last_ms FROM pages GROUP BY 1, 2)) WHERE before < 400")
def t5_page_evict(spark: SparkSession, d: str) -> DataFrame:
    p = v.pages(spark, d).groupBy("namespace", "page_id").agg((50 * F.count("*")).alias("amount"), F.max("last_access_ms").alias("last_ms"))
    return eviction.until_target(p, ["namespace"], [F.col("last_ms"), F.col("page_id")], "amount", 400).select("namespace", "page_id")


@query("SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END DESC NULLS FIRST, o_orderkey LIMIT 50 OFFSET 100")
def t6_task_page(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    return o.orderBy(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).desc_nulls_first(), "o_orderkey").offset(100).limit(50).select("o_orderkey")


@query(using("ev") + "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type IN ('error', 'purchase'), ts_ms DESC, event_id DESC) AS r FROM ev) WHERE r <= 40")
def t9_status_bound(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.col("event_type").isin("error", "purchase"), F.col("ts_ms").desc(), F.col("event_id").desc())
    return v.events(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 40").select("user_id", "event_id")


@query(_S + "SELECT id, namespace, score, density, dense_rank() OVER (PARTITION BY namespace ORDER BY density, grp) AS group_rank FROM scored s JOIN groups g USING (namespace, grp) WHERE NOT pinned")
def l18_eviction_log(spark: SparkSession, d: str) -> DataFrame:
    g = ordering.numbered(_groups(spark, d).where("loose").select("namespace", "grp", "density"), "namespace", ["density", "grp"], rank="group_rank")
    return _scored(spark, d).where("not pinned").join(g, ["namespace", "grp"]).select("id", "namespace", "score", "density", "group_rank")


# graphs


@query(using("edges") + "SELECT task_id, node, 'source' AS kind FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.task_id = n.task_id AND e.dst = n.node) UNION ALL SELECT task_id, node, 'sink' FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.task_id = n.task_id AND e.src = n.node)")
def g1_sources_sinks(spark: SparkSession, d: str) -> DataFrame:
    n, e = v.nodes(spark, d), v.edges(spark, d)
    return graph.ends(n, e, "dst").withColumn("kind", F.lit("source")).unionByName(graph.ends(n, e, "src").withColumn("kind", F.lit("sink")))


_CYC = """, ring AS (SELECT task_id, src, dst FROM edges UNION SELECT task_id, 7 AS src, 2 AS dst FROM edges WHERE task_id % 4 = 1), reach AS (SELECT task_id, src, dst FROM ring UNION SELECT r.task_id, r.src, e.dst FROM reach r JOIN ring e ON e.task_id = r.task_id AND e.src = r.dst) """


@query(using("edges").rstrip() + _CYC + "SELECT DISTINCT task_id FROM reach WHERE src = dst")
def g2_cycle(spark: SparkSession, d: str) -> DataFrame:
    e = v.edges(spark, d)
    back = e.where("task_id % 4 = 1").select("task_id", F.lit(7).cast("bigint").alias("src"), F.lit(2).cast("bigint").alias("dst")).distinct()
    return graph.cyclic(e.unionByName(back))


@query(using("edges").rstrip() + ", walk AS (SELECT task_id, node, 0 AS level FROM nodes UNION SELECT w.task_id, e.dst, w.level + 1 FROM walk w JOIN edges e ON e.task_id = w.task_id AND e.src = w.node) SELECT task_id, node, CAST(max(level) AS BIGINT) AS level FROM walk GROUP BY 1, 2")
def g3_topo_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.levels(v.nodes(spark, d), v.edges(spark, d))


@query(using("closure") + "SELECT task_id, src, dst FROM closure")
def g4_reachability(spark: SparkSession, d: str) -> DataFrame:
    e = v.edges(spark, d)
    return graph.reached(e, e.select("task_id", F.col("src").alias("node"))).select("task_id", F.col("start").alias("src"), F.col("node").alias("dst"))


@query(using("closure") + """, want AS (SELECT DISTINCT task_id, node AS src, (node * 7) % 60 + 1 AS dst FROM nodes)
SELECT w.task_id, w.src, w.dst, CASE WHEN n.node IS NULL THEN 'UNKNOWN_NODE' WHEN e.src IS NOT NULL THEN 'DUPLICATE' WHEN c.src IS NOT NULL OR w.src = w.dst THEN 'CYCLE' ELSE 'OK' END AS verdict
FROM want w LEFT JOIN nodes n ON n.task_id = w.task_id AND n.node = w.dst LEFT JOIN edges e ON e.task_id = w.task_id AND e.src = w.src AND e.dst = w.dst LEFT JOIN closure c ON c.task_id = w.task_id AND c.src = w.dst AND c.dst = w.src""".replace(", want AS", ", want AS", 1))
def g5_edge_validation(spark: SparkSession, d: str) -> DataFrame:
    n, e = v.nodes(spark, d), v.edges(spark, d)
    want = n.select("task_id", F.col("node").alias("src"), (F.col("node") * 7 % 60 + 1).alias("dst")).distinct()
    return graph.valid_edges(want, n, e)


@query(using("edges") + "SELECT task_id, node, (SELECT count(*) FROM edges e WHERE e.task_id = n.task_id AND e.dst = n.node) AS n_in, (SELECT count(*) FROM edges e WHERE e.task_id = n.task_id AND e.src = n.node) AS n_out FROM nodes n")
def g6_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(v.nodes(spark, d), v.edges(spark, d))


@query(using("edges") + "SELECT task_id, src, dst FROM edges WHERE src % 5 <> 0 AND dst % 5 <> 0")
def g7_node_removal(spark: SparkSession, d: str) -> DataFrame:
    n = v.nodes(spark, d)
    return graph.without_nodes(n, v.edges(spark, d), n.where("node % 5 = 0"))[1].select("task_id", "src", "dst")


@query(using("edges") + """SELECT task_id, start, node, min(hop) AS hop FROM (SELECT task_id, src AS start, dst AS node, 1 AS hop FROM edges UNION ALL SELECT a.task_id, a.src, b.dst, 2 FROM edges a JOIN edges b ON a.task_id = b.task_id AND a.dst = b.src) WHERE start <> node GROUP BY 1, 2, 3""")
def g8_k_hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.within_hops(v.nodes(spark, d), v.edges(spark, d), 2)


@query(using("closure") + """, keep AS (SELECT task_id, node FROM nodes WHERE branch = 1 UNION SELECT c.task_id, c.src FROM closure c JOIN nodes n ON n.task_id = c.task_id AND n.node = c.dst AND n.branch = 1)
SELECT e.task_id, e.src, e.dst FROM edges e JOIN keep a ON a.task_id = e.task_id AND a.node = e.src JOIN keep b ON b.task_id = e.task_id AND b.node = e.dst""")
def g9_branch_subgraph(spark: SparkSession, d: str) -> DataFrame:
    e = v.edges(spark, d)
    return graph.branch_edges(v.nodes(spark, d).where("branch = 1"), e)


_SINK = "NOT EXISTS (SELECT 1 FROM edges e WHERE e.task_id = n.task_id AND e.src = n.node)"


@query(using("edges") + f"SELECT task_id, max_by(node, (coalesce(executed_at, 9223372036854775807), node)) AS node FROM nodes n WHERE {_SINK} GROUP BY 1")
def g10_current_node(spark: SparkSession, d: str) -> DataFrame:
    n = v.nodes(spark, d)
    sinks = graph.ends(n, v.edges(spark, d), "src").join(n.select("task_id", "node", "executed_at"), ["task_id", "node"])
    return sinks.groupBy("task_id").agg(F.max_by("node", F.struct(F.coalesce("executed_at", F.lit(2**63 - 1)), "node")).alias("node"))


@query(using("nodes") + "SELECT task_id, branch, max_by(node, (coalesce(executed_at, -1), node)) AS cursor FROM nodes GROUP BY 1, 2")
def g11_branch_cursor(spark: SparkSession, d: str) -> DataFrame:
    return v.nodes(spark, d).groupBy("task_id", "branch").agg(F.max_by("node", F.struct(F.coalesce("executed_at", F.lit(-1)), "node")).alias("cursor"))


@query(using("nodes") + "SELECT task_id, src, dst FROM (SELECT task_id, lag(node) OVER (PARTITION BY task_id ORDER BY node) AS src, node AS dst FROM nodes) WHERE src IS NOT NULL")
def g12_linear_dag(spark: SparkSession, d: str) -> DataFrame:
    return graph.chain_of(v.nodes(spark, d), F.col("node"))


@query(using("edges").rstrip() + _CYC + "SELECT task_id, CASE WHEN max((src = dst)::INT) = 1 THEN 'STRUCTURAL' ELSE 'NONE' END AS conflict FROM reach GROUP BY 1")
def g13_merge_conflict(spark: SparkSession, d: str) -> DataFrame:
    bad = g2_cycle(spark, d).withColumn("conflict", F.lit("STRUCTURAL"))
    return v.edges(spark, d).select("task_id").distinct().join(bad, "task_id", "left").na.fill("NONE", ["conflict"])


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return v.fragments(spark, d, vectors=True).where("embedding is not null")


@query()
def g14_kmeans_pages(spark: SparkSession, d: str) -> DataFrame:
    return graph.cosine_pages(_vectors(spark, d), "namespace")


@query()
def g15_incremental_pages(spark: SparkSession, d: str) -> DataFrame:
    return graph.incremental_pages(_vectors(spark, d), "namespace", "created_ms")


@query(using("pages", "vec") + """, c AS (SELECT page_id, pos, avg(x) AS m FROM (SELECT page_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(128)) AS pos FROM pages JOIN vec USING (id)) GROUP BY 1, 2)
SELECT page_id, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY page_id)), 6) AS value FROM c""")
def a33_centroid(spark: SparkSession, d: str) -> DataFrame:
    p = v.pages(spark, d).select("id", "page_id").join(v.embeddings(spark, d), "id")
    return graph.centroids(p, "page_id", "embedding").select("page_id", F.posexplode("values").alias("pos", "value")).select("page_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


# logs


def _wal(spark: SparkSession, d: str) -> DataFrame:
    return log.first_of_each_entry(v.wal(spark, d))


@query(using("log") + "SELECT task_id, key, max_by(value, seq) AS value FROM (SELECT task_id, concat('c', k % 20) AS key, CASE WHEN k % 9 = 0 THEN '' ELSE concat('v', k) END AS value, seq FROM log WHERE operation = 'UPDATE_CONTEXT') GROUP BY 1, 2 HAVING max_by(value, seq) <> ''")
def l2_context_lww(spark: SparkSession, d: str) -> DataFrame:
    w = _wal(spark, d).where("operation = 'UPDATE_CONTEXT'")
    value = F.when(F.col("k") % 9 == 0, "").otherwise(F.concat(F.lit("v"), "k"))
    return log.context(w.select("task_id", F.concat(F.lit("c"), F.col("k") % 20).alias("key"), value.alias("value"), "seq"))


_ST = "CASE k % 4 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'RECOVERING' WHEN 2 THEN 'RUNNING' ELSE 'FAILED' END"


@query(using("log") + f"SELECT task_id, CASE WHEN s IN ('COMPLETED', 'FAILED') AND NOT f THEN 'PENDING_FINALIZATION' WHEN s = 'RECOVERING' THEN 'RUNNING' ELSE s END AS status FROM (SELECT task_id, max_by({_ST}, seq) AS s, max_by(k % 3 = 0, seq) AS f FROM log WHERE operation = 'SET_STATUS' GROUP BY 1)")
def l3_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k") % 4
    s = F.when(k == 0, "COMPLETED").when(k == 1, "RECOVERING").when(k == 2, "RUNNING").otherwise("FAILED")
    return log.status(_wal(spark, d).where("operation = 'SET_STATUS'").select("task_id", "seq", s.alias("status"), (F.col("k") % 3 == 0).alias("finalized")))


@query(using("log") + "SELECT task_id, concat('v', k % 3) AS conversation_id, string_agg(concat('m', entry_id), chr(10) ORDER BY seq) AS messages, count(*) AS n, min(ts_ms) AS created_ms, max(ts_ms) AS updated_ms FROM log WHERE operation = 'UPDATE_CONTEXT' GROUP BY 1, 2")
def l4_conversations(spark: SparkSession, d: str) -> DataFrame:
    w = _wal(spark, d).where("operation = 'UPDATE_CONTEXT'")
    return log.conversations(w.select("task_id", "seq", "ts_ms", F.concat(F.lit("v"), F.col("k") % 3).alias("conversation_id"), F.concat(F.lit("m"), "entry_id").alias("message")))


_TOOL = ", t AS (SELECT task_id, concat('x', k % 25) AS execution_id, operation, seq FROM log WHERE operation LIKE '%TOOL%') "


@query(using("log").rstrip() + _TOOL + """SELECT task_id, execution_id, CASE WHEN s IS NULL OR f < s THEN 'ORPHAN' WHEN l = 'COMPLETE_TOOL_EXECUTION' THEN 'SUCCEEDED' WHEN l = 'FAIL_TOOL_EXECUTION' THEN 'FAILED' ELSE 'RUNNING' END AS state
  FROM (SELECT task_id, execution_id, min(seq) FILTER (operation = 'START_TOOL_EXECUTION') AS s, min(seq) AS f, max_by(operation, seq) AS l FROM t GROUP BY 1, 2)""")
def l5_tools(spark: SparkSession, d: str) -> DataFrame:
    w = _wal(spark, d).where("operation like '%TOOL%'").withColumn("execution_id", F.concat(F.lit("x"), F.col("k") % 25))
    return log.tools(w)


_CALL = ", c AS (SELECT task_id, concat('l', k % 12) AS call_id, CASE operation WHEN 'START_TOOL_EXECUTION' THEN 'START' WHEN 'COMPLETE_TOOL_EXECUTION' THEN 'COMPLETE' WHEN 'FAIL_TOOL_EXECUTION' THEN 'TIMEOUT' ELSE 'RETRY' END AS op, seq FROM log), s AS (SELECT task_id, call_id, max(seq) FILTER (op = 'START') AS st FROM c GROUP BY 1, 2) "


@query(using("log").rstrip() + _CALL + """SELECT task_id, call_id, CASE max_by(op, seq) WHEN 'COMPLETE' THEN 'SUCCEEDED' WHEN 'TIMEOUT' THEN 'TIMED_OUT' ELSE 'RUNNING' END AS state, 1 + count(*) FILTER (op = 'RETRY') AS attempts,
  coalesce(max(seq) FILTER (op = 'TIMEOUT') > coalesce(max(seq) FILTER (op = 'COMPLETE'), -1), false) AS retryable FROM c JOIN s USING (task_id, call_id) WHERE st IS NOT NULL AND seq >= st GROUP BY 1, 2""")
def l6_llm_calls(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("operation") == "START_TOOL_EXECUTION", "START").when(F.col("operation") == "COMPLETE_TOOL_EXECUTION", "COMPLETE").when(F.col("operation") == "FAIL_TOOL_EXECUTION", "TIMEOUT").otherwise("RETRY")
    return log.llm_calls(_wal(spark, d).select("task_id", F.concat(F.lit("l"), F.col("k") % 12).alias("call_id"), op.alias("operation"), "seq"))


_BRANCH_LOG = """, b AS (SELECT *, CASE WHEN seq = 1 THEN 'APPEND_NODE' WHEN m < 4 THEN 'CREATE_BRANCH' WHEN m < 6 THEN 'MERGE_BRANCH' WHEN m < 8 THEN 'ABANDON_BRANCH' ELSE 'SWITCH_BRANCH' END AS op FROM (SELECT *, (CAST(entry_id AS BIGINT) * 3 + k) % 9 AS m FROM log)),
c AS (SELECT *, count(*) FILTER (op = 'CREATE_BRANCH') OVER (PARTITION BY task_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS made FROM b),
f AS (SELECT task_id, seq, []::VARCHAR[] AS active, []::VARCHAR[] AS merged, []::VARCHAR[] AS left_, NULL::VARCHAR AS now, NULL::VARCHAR AS error FROM c WHERE seq = 1
  UNION ALL SELECT c.task_id, c.seq,
    CASE WHEN e IS NOT NULL THEN active WHEN op = 'CREATE_BRANCH' THEN list_append(active, concat('b', made)) WHEN op IN ('MERGE_BRANCH', 'ABANDON_BRANCH') THEN list_filter(active, lambda x: x <> a) ELSE active END,
    CASE WHEN e IS NULL AND op = 'MERGE_BRANCH' THEN list_append(merged, a) WHEN e IS NULL AND op = 'ABANDON_BRANCH' THEN list_filter(merged, lambda x: x <> a) ELSE merged END,
    CASE WHEN e IS NULL AND op = 'ABANDON_BRANCH' AND NOT list_contains(left_, a) THEN list_append(left_, a) ELSE left_ END,
    CASE WHEN e IS NOT NULL THEN now WHEN op = 'CREATE_BRANCH' THEN concat('b', made) WHEN op = 'MERGE_BRANCH' THEN t WHEN op = 'SWITCH_BRANCH' THEN a WHEN now = a THEN coalesce(list_filter(active, lambda x: x <> a)[1], now) ELSE now END, e
  FROM (SELECT f.task_id, c.seq, c.op, c.made, concat('b', c.made - c.k % 3) AS a, concat('b', c.made - (c.k + 1) % 3) AS t, active, merged, left_, now,
    CASE WHEN op = 'CREATE_BRANCH' THEN CASE WHEN len(active) >= 10 THEN 'TOO_MANY_BRANCHES' END
      WHEN op = 'MERGE_BRANCH' AND NOT (list_contains(active, concat('b', c.made - c.k % 3)) AND list_contains(active, concat('b', c.made - (c.k + 1) % 3))) THEN 'NO_ACTIVE_BRANCH'
      WHEN op = 'SWITCH_BRANCH' AND NOT list_contains(active, concat('b', c.made - c.k % 3)) THEN 'NO_ACTIVE_BRANCH'
      WHEN op = 'ABANDON_BRANCH' AND NOT list_contains(list_concat(active, list_concat(merged, left_)), concat('b', c.made - c.k % 3)) THEN 'NO_ACTIVE_BRANCH' END AS e
    FROM f JOIN c ON c.task_id = f.task_id AND c.seq = f.seq + 1 WHERE f.error IS NULL) c),
x AS (SELECT task_id, max(seq) AS seq FROM f GROUP BY 1)
SELECT task_id, '{' || coalesce((SELECT string_agg(concat('"', i, '":"', s, '"'), ',' ORDER BY i) FROM (SELECT unnest(active) AS i, 'ACTIVE' AS s UNION ALL SELECT unnest(merged), 'MERGED' UNION ALL SELECT unnest(left_), 'ABANDONED')), '') || '}' AS branches, now AS current_branch, error, CASE WHEN error IS NOT NULL THEN seq END AS error_seq FROM f JOIN x USING (task_id, seq)"""


@query(using("log").rstrip() + _BRANCH_LOG)
def l8_branches(spark: SparkSession, d: str) -> DataFrame:
    """Replay of a log of branch entries: created, merged into another, switched to, abandoned."""
    w = _wal(spark, d)
    m, k = (F.col("entry_id").cast("bigint") * 3 + F.col("k")) % 9, F.col("k")
    op = F.when(F.col("seq") == 1, "APPEND_NODE").when(m < 4, "CREATE_BRANCH").when(m < 6, "MERGE_BRANCH").when(m < 8, "ABANDON_BRANCH").otherwise("SWITCH_BRANCH")
    made = F.sum((F.col("operation") == "CREATE_BRANCH").cast("bigint")).over(Window.partitionBy("task_id").orderBy("seq"))
    w = w.withColumn("operation", op).withColumn("made", made)
    name = lambda n: F.concat(F.lit("b"), n.cast("string"))
    own, other = name(F.when(F.col("operation") == "CREATE_BRANCH", F.col("made")).otherwise(F.col("made") - k % 3)), name(F.col("made") - (k + 1) % 3)
    pairs = {"nodeId": F.lit("root"), "sourceNodeId": F.lit("root"), "type": F.lit("thought"), "branchId": own, "branchName": own, "sourceBranchId": own, "targetBranchId": other}
    payload = F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values()))
    payload = F.when(F.col("seq") == 1, F.map_filter(payload, lambda key, _: key.isin("nodeId", "type"))).otherwise(payload)
    return log.replay(w.withColumn("payload", payload)).select("task_id", "branches", "current_branch", "error", "error_seq")


_SINCE = ", i AS (SELECT *, count(*) FILTER (kind = 'FULL') OVER (PARTITION BY task_id ORDER BY created_ms, checkpoint_id ROWS UNBOUNDED PRECEDING) AS island FROM checkpoints), n AS (SELECT *, count(*) FILTER (kind <> 'FULL') OVER (PARTITION BY task_id, island ORDER BY created_ms, checkpoint_id ROWS UNBOUNDED PRECEDING) AS deltas FROM i) "


@query(using("checkpoints").rstrip() + _SINCE + "SELECT checkpoint_id, deltas FROM n")
def w11_deltas_since_full(spark: SparkSession, d: str) -> DataFrame:
    return log.since_full(v.checkpoints(spark, d)).select("checkpoint_id", "deltas")


@query(using("checkpoints").rstrip() + _SINCE + "SELECT task_id, CASE WHEN max(island) = 0 OR max_by(deltas, (created_ms, checkpoint_id)) >= 10 THEN 'FULL' ELSE 'DELTA' END AS next_kind, max_by(deltas, (created_ms, checkpoint_id)) AS deltas FROM n GROUP BY 1")
def l9_full_or_delta(spark: SparkSession, d: str) -> DataFrame:
    return log.next_kind(v.checkpoints(spark, d))


@query(using("log") + ", a AS (SELECT task_id, k, max(seq) AS s, max_by(value, seq) AS v FROM log WHERE seq <= 30 GROUP BY 1, 2), b AS (SELECT task_id, k, max_by(value, seq) AS v FROM log WHERE seq > 30 GROUP BY 1, 2) SELECT b.task_id, b.k, b.v AS value, a.k IS NOT NULL AS known FROM b LEFT JOIN a USING (task_id, k)")
def l10_delta_build(spark: SparkSession, d: str) -> DataFrame:
    w = _wal(spark, d)
    new = log.last_by(w.where("seq > 30"), ["task_id", "k"], "value")
    old = w.where("seq <= 30").select("task_id", "k", F.lit(True).alias("known")).distinct()
    return new.join(old, ["task_id", "k"], "left").na.fill(False, ["known"])


_CHAIN = ", chain AS (SELECT checkpoint_id AS id, checkpoint_id AS now_at, base_id, 0 AS depth FROM checkpoints UNION ALL SELECT c.id, p.checkpoint_id, p.base_id, c.depth + 1 FROM chain c JOIN checkpoints p ON p.checkpoint_id = c.base_id), root AS (SELECT id AS checkpoint_id, max_by(now_at, depth) AS root_id, CAST(max(depth) AS BIGINT) AS depth FROM chain GROUP BY 1) "


@query(using("checkpoints").rstrip() + _CHAIN + "SELECT r.checkpoint_id, r.root_id, r.depth, c.kind AS root_kind FROM root r JOIN checkpoints c ON c.checkpoint_id = r.root_id")
def j16_checkpoint_chain(spark: SparkSession, d: str) -> DataFrame:
    return log.base_chains(v.checkpoints(spark, d))


@query(using("checkpoints").rstrip().replace("checkpoints AS (", "whole AS (", 1) + ", checkpoints AS (SELECT * FROM whole WHERE NOT (kind = 'FULL' AND checkpoint_id % 2 = 0)) " + _CHAIN + "SELECT r.checkpoint_id, CASE WHEN c.kind = 'FULL' THEN 'OK' WHEN c.base_id IS NULL THEN 'NO_BASE' ELSE 'BASE_MISSING' END AS outcome FROM root r JOIN checkpoints c ON c.checkpoint_id = r.root_id")
def l12_chain_failure(spark: SparkSession, d: str) -> DataFrame:
    c = v.checkpoints(spark, d).where("not (kind = 'FULL' and checkpoint_id % 2 = 0)")
    named = c.select(F.col("checkpoint_id").alias("root_id"), "base_id")
    out = F.when(F.col("root_kind") == "CYCLE", "CYCLE").when(F.col("root_kind") == "FULL", "OK").when(F.col("base_id").isNull(), "NO_BASE").otherwise("BASE_MISSING")
    return log.base_chains(c).join(named, "root_id", "left").select("checkpoint_id", out.alias("outcome"))


@query(using("log") + f"SELECT task_id, max_by({_ST}, seq) AS status, bool_or({_ST} IN ('COMPLETED', 'FAILED')) AS parked FROM log WHERE operation = 'SET_STATUS' GROUP BY 1")
def l14_terminal_transition(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k") % 4
    s = F.when(k == 0, "COMPLETED").when(k == 1, "RECOVERING").when(k == 2, "RUNNING").otherwise("FAILED")
    w = _wal(spark, d).where("operation = 'SET_STATUS'").withColumn("status", s)
    return w.groupBy("task_id").agg(F.max_by("status", "seq").alias("status"), F.bool_or(F.col("status").isin(*log.TERMINAL)).alias("parked"))


_TRIGGER = """, r AS (SELECT task_id, seq, ts_ms FROM log), f AS (SELECT task_id, seq, 1 AS n, ts_ms AS since, 0 AS done, false AS fired FROM r WHERE seq = 1
  UNION ALL SELECT r.task_id, r.seq, CASE WHEN fire THEN 0 ELSE n + 1 END, CASE WHEN fire THEN NULL ELSE coalesce(since, r.ts_ms) END, done + fire::INT, fire FROM (
    SELECT r.*, f.n, f.since, f.done, f.n + 1 >= 50 OR r.ts_ms - coalesce(f.since, r.ts_ms) >= 60000 AS fire FROM f JOIN r ON r.task_id = f.task_id AND r.seq = f.seq + 1) r)
SELECT task_id, seq, CAST(done AS BIGINT) AS checkpoint_no FROM f WHERE fired"""


@query(using("log").rstrip() + _TRIGGER)
def l15_checkpoint_trigger(spark: SparkSession, d: str) -> DataFrame:
    return log.triggers(_wal(spark, d).select("task_id", "seq", "ts_ms"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    e = v.events(spark, d)
    return e.select(F.concat_ws(":", "user_id", F.col("k") % 5).alias("key"), (F.col("k") % 2).cast("string").alias("hash"), "ts_ms", F.col("event_id").alias("n"))


@query(using("ev").rstrip() + """, r AS (SELECT concat(user_id, ':', k % 5) AS key, k % 2 AS h, ts_ms, event_id, row_number() OVER (PARTITION BY concat(user_id, ':', k % 5) ORDER BY ts_ms, event_id) AS i FROM ev),
f AS (SELECT key, i, event_id AS n, ts_ms AS start, h AS held, 'NEW' AS outcome FROM r WHERE i = 1 UNION ALL
  SELECT f.key, r.i, r.event_id, CASE WHEN r.ts_ms - f.start >= 86400000 THEN r.ts_ms ELSE f.start END, CASE WHEN r.ts_ms - f.start >= 86400000 THEN r.h ELSE f.held END,
    CASE WHEN r.ts_ms - f.start >= 86400000 THEN 'NEW' WHEN r.h = f.held THEN 'REPLAY' ELSE 'CONFLICT' END FROM f JOIN r ON r.key = f.key AND r.i = f.i + 1)
SELECT key, n, outcome FROM f""")
def l16_execution_id(spark: SparkSession, d: str) -> DataFrame:
    return log.executions(_requests(spark, d))


_REFERS = ("COMPLETE_NODE", "ADD_EDGE", "COMPLETE_TOOL_EXECUTION", "FAIL_TOOL_EXECUTION", "COMPLETE_LLM_CALL", "TIMEOUT_LLM_CALL", "MARK_LLM_CALL_RETRY")
#: Operations of the replayed log by ``(13 entry + 7 k) % 30``; those that refer to others wait for the 20th entry.
_OPS = [
    *["APPEND_NODE"] * 8, *["COMPLETE_NODE"] * 2, *["ADD_EDGE"] * 2, "DELETE_NODE", *["UPDATE_CONTEXT"] * 3, *["SET_STATUS"] * 2, *["APPEND_CONVERSATION_MESSAGE"] * 2,
    *["START_TOOL_EXECUTION"] * 3, "COMPLETE_TOOL_EXECUTION", "FAIL_TOOL_EXECUTION", *["START_LLM_CALL"] * 2, "COMPLETE_LLM_CALL", "TIMEOUT_LLM_CALL", "MARK_LLM_CALL_RETRY",
]
_STATUS4 = ("COMPLETED", "RECOVERING", "RUNNING", "FAILED")


def _payload(spark: SparkSession, d: str) -> DataFrame:
    """The log with every kind of entry but those on branches; a few tasks are deleted."""
    k, entry = F.col("k"), F.col("entry_id").cast("bigint")
    op = F.element_at(F.array(*map(F.lit, _OPS)), ((entry * 13 + k * 7) % 30 + 1).cast("int"))
    op = F.when(op.isin(*_REFERS) & (F.col("seq") <= 20), "UPDATE_CONTEXT").when((op == "UPDATE_CONTEXT") & (entry % 97 == 0), "DELETE_TASK").otherwise(op)
    w = v.wal(spark, d).withColumn("operation", op)
    op, text = F.col("operation"), lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    fields = lambda *kv: F.map_from_arrays(F.array(*(F.lit(x) for x in kv[::2])), F.array(*kv[1::2]))
    node, linked = text("n", 4), (k % 3 == 0) & (k % 4 > 0)
    payload = (
        F.when((op == "APPEND_NODE") & linked, fields("nodeId", node, "type", F.lit("thought"), "targetNodeId", F.concat(F.lit("n"), (k % 4 - 1).cast("string")), "edgeType", F.lit("DATA")))
        .when(op == "APPEND_NODE", fields("nodeId", node, "type", F.lit("action"))).when(op.isin("COMPLETE_NODE", "DELETE_NODE"), fields("nodeId", node))
        .when(op == "ADD_EDGE", fields("sourceNodeId", text("n", 3), "targetNodeId", F.concat(F.lit("n"), (k % 3 + 1).cast("string")), "dependencyType", F.lit("DATA")))
        .when(op == "UPDATE_CONTEXT", fields("key", text("c", 20), "value", F.when(k % 9 == 0, "").otherwise(text("v", 100))))
        .when(op == "SET_STATUS", fields("status", F.element_at(F.array(*map(F.lit, _STATUS4)), (k % 4 + 1).cast("int")), "finalizationStatus", F.when(k % 3 == 0, "FINALIZED").otherwise(" ")))
        .when(op == "APPEND_CONVERSATION_MESSAGE", fields("conversationId", text("v", 3), "messageId", F.col("entry_id"), "role", F.lit("user"), "content", F.lit("text")))
        .when(op.contains("TOOL"), fields("executionId", text("x", 2))).when(op.contains("LLM"), fields("callId", text("l", 2)))
    )
    return w.select("task_id", "seq", "entry_id", "operation", payload.alias("payload"), "ts_ms")


_REPLAY_LOG = f""", o AS (SELECT task_id, seq, k, entry_id, CASE WHEN op IN {_REFERS} AND seq <= 20 THEN 'UPDATE_CONTEXT' WHEN op = 'UPDATE_CONTEXT' AND CAST(entry_id AS BIGINT) % 97 = 0 THEN 'DELETE_TASK' ELSE op END AS op
  FROM (SELECT *, list_extract({_OPS}, CAST((CAST(entry_id AS BIGINT) * 13 + k * 7) % 30 + 1 AS INTEGER)) AS op FROM log)),
c AS (SELECT *, op = 'UPDATE_CONTEXT' AND seq <= 20 AS early FROM o),
touch AS (SELECT task_id, seq, concat('n', k % 4) AS node, op = 'APPEND_NODE' AS alive FROM o WHERE op IN ('APPEND_NODE', 'DELETE_NODE')),
need AS (SELECT task_id, seq, concat('n', k % 4 - 1) AS node FROM o WHERE op = 'APPEND_NODE' AND k % 3 = 0 AND k % 4 > 0 UNION ALL SELECT task_id, seq, concat('n', k % 4) FROM o WHERE op = 'COMPLETE_NODE'
  UNION ALL SELECT task_id, seq, unnest([concat('n', k % 3), concat('n', k % 3 + 1)]) FROM o WHERE op = 'ADD_EDGE'),
moves AS (SELECT task_id, seq, op LIKE '%TOOL%' AS tool, k % 2 AS id, op LIKE 'START%' AS starts, op FROM o WHERE op LIKE '%TOOL%' OR op LIKE '%LLM%'),
bad AS (SELECT task_id, seq, 'TASK_DELETED' AS error FROM o WHERE op = 'DELETE_TASK'
  UNION ALL SELECT n.task_id, n.seq, 'UNKNOWN_NODE' FROM need n LEFT JOIN touch t ON t.task_id = n.task_id AND t.node = n.node AND t.seq < n.seq GROUP BY n.task_id, n.seq, n.node HAVING NOT coalesce(max_by(t.alive, t.seq), false)
  UNION ALL SELECT m.task_id, m.seq, CASE WHEN tool THEN 'UNKNOWN_EXECUTION' ELSE 'UNKNOWN_CALL' END FROM moves m WHERE NOT starts AND NOT EXISTS (SELECT 1 FROM moves s WHERE s.task_id = m.task_id AND s.tool = m.tool AND s.id = m.id AND s.starts AND s.seq < m.seq)),
stop AS (SELECT task_id, min(seq) AS error_seq, min_by(error, seq) AS error FROM bad GROUP BY 1),
a AS (SELECT o.*, s.error, s.error_seq FROM o LEFT JOIN stop s USING (task_id) WHERE o.seq < coalesce(s.error_seq, 1000000000)),
base AS (SELECT task_id, count(a.seq) AS applied, coalesce(max(a.seq), 0) AS last_seq, any_value(s.error) AS error, any_value(s.error_seq) AS error_seq FROM (SELECT DISTINCT task_id FROM o) t LEFT JOIN a USING (task_id) LEFT JOIN stop s USING (task_id) GROUP BY 1),
st AS (SELECT task_id, max_by(list_extract({list(_STATUS4)}, CAST(k % 4 + 1 AS INTEGER)), seq) AS s, max_by(k % 3 = 0, seq) AS f FROM a WHERE op = 'SET_STATUS' GROUP BY 1),
ctx AS (SELECT task_id, string_agg(concat('"', key, '":"', value, '"'), ',' ORDER BY key) AS j FROM (SELECT task_id, concat('c', k % 20) AS key, max_by(CASE WHEN k % 9 = 0 THEN '' ELSE concat('v', k % 100) END, seq) AS value FROM a WHERE op = 'UPDATE_CONTEXT' GROUP BY 1, 2) WHERE value <> '' GROUP BY 1),
am AS (SELECT m.* FROM moves m JOIN a USING (task_id, seq)),
started AS (SELECT task_id, tool, id, max(seq) AS since FROM am WHERE starts GROUP BY ALL),
run AS (SELECT task_id, tool, id, max_by(op, seq) AS last, 1 + count(*) FILTER (op = 'MARK_LLM_CALL_RETRY') AS attempts FROM am JOIN started USING (task_id, tool, id) WHERE seq >= since GROUP BY ALL),
tl AS (SELECT task_id, string_agg(concat('"x', id, '":"', CASE last WHEN 'COMPLETE_TOOL_EXECUTION' THEN 'SUCCEEDED' WHEN 'FAIL_TOOL_EXECUTION' THEN 'FAILED' ELSE 'RUNNING' END, '"'), ',' ORDER BY id) AS j FROM run WHERE tool GROUP BY 1),
cl AS (SELECT task_id, string_agg(concat('"l', id, '":"', CASE last WHEN 'COMPLETE_LLM_CALL' THEN 'COMPLETED' WHEN 'TIMEOUT_LLM_CALL' THEN 'TIMED_OUT' WHEN 'MARK_LLM_CALL_RETRY' THEN 'RETRY_PENDING' ELSE 'RUNNING' END, ' ', attempts, CASE WHEN last IN ('TIMEOUT_LLM_CALL', 'MARK_LLM_CALL_RETRY') THEN ' retryable' ELSE '' END, '"'), ',' ORDER BY id) AS j FROM run WHERE NOT tool GROUP BY 1),
own AS (SELECT task_id, concat('n', k % 4) AS node, max(seq) FILTER (op = 'APPEND_NODE') AS put, max(seq) FILTER (op = 'DELETE_NODE') AS gone, max(seq) FILTER (op = 'COMPLETE_NODE') AS done FROM a WHERE op IN ('APPEND_NODE', 'DELETE_NODE', 'COMPLETE_NODE') GROUP BY 1, 2),
nd AS (SELECT task_id, string_agg(concat('"', node, '":"', CASE WHEN done > put THEN 'COMPLETED' ELSE 'PENDING' END, '"'), ',' ORDER BY node) AS j FROM own WHERE put > coalesce(gone, 0) GROUP BY 1),
link AS (SELECT task_id, seq, CASE op WHEN 'ADD_EDGE' THEN concat('n', k % 3) ELSE concat('n', k % 4 - 1) END AS s, CASE op WHEN 'ADD_EDGE' THEN concat('n', k % 3 + 1) ELSE concat('n', k % 4) END AS d FROM a WHERE op = 'ADD_EDGE' OR op = 'APPEND_NODE' AND k % 3 = 0 AND k % 4 > 0),
last_link AS (SELECT task_id, s, d, max(seq) AS seq FROM link GROUP BY ALL),
eg AS (SELECT l.task_id, string_agg(concat('"', s, '>', d, ' DATA"'), ',' ORDER BY s, d) AS j FROM last_link l LEFT JOIN own x ON x.task_id = l.task_id AND x.node = l.s LEFT JOIN own y ON y.task_id = l.task_id AND y.node = l.d
  WHERE l.seq > greatest(coalesce(x.gone, 0), coalesce(y.gone, 0)) GROUP BY 1),
tk AS (SELECT task_id, string_agg(concat('"v', id, '":', n), ',' ORDER BY id) AS j FROM (SELECT task_id, k % 3 AS id, count(*) AS n FROM a WHERE op = 'APPEND_CONVERSATION_MESSAGE' GROUP BY 1, 2) GROUP BY 1),
state AS (SELECT b.*, CASE st.s WHEN 'RECOVERING' THEN 'RUNNING' ELSE coalesce(st.s, 'RUNNING') END AS status, CASE WHEN st.f THEN 'FINALIZED' WHEN st.s IN ('COMPLETED', 'FAILED') THEN 'PENDING_FINALIZATION' ELSE 'NONE' END AS finalization,
  concat('{{', ctx.j, '}}') AS context, concat('{{', tl.j, '}}') AS tools, concat('{{', cl.j, '}}') AS calls, concat('{{', nd.j, '}}') AS nodes, concat('[', eg.j, ']') AS edges, concat('{{', tk.j, '}}') AS conversations
  FROM base b LEFT JOIN st USING (task_id) LEFT JOIN ctx USING (task_id) LEFT JOIN tl USING (task_id) LEFT JOIN cl USING (task_id) LEFT JOIN nd USING (task_id) LEFT JOIN eg USING (task_id) LEFT JOIN tk USING (task_id)) """
_STATE = ["task_id", "applied", "last_seq", "status", "finalization", "context", "tools", "calls", "nodes", "edges", "conversations", "error", "error_seq"]


@query(using("log") + ", a AS (SELECT task_id, k, max_by(value, seq) AS v FROM log WHERE seq <= 30 GROUP BY 1, 2), b AS (SELECT task_id, k, max_by(value, seq) AS v, max_by(operation, seq) = 'FAIL_TOOL_EXECUTION' AS gone FROM log WHERE seq > 30 GROUP BY 1, 2) SELECT task_id, k, coalesce(b.v, a.v) AS value FROM a FULL JOIN b USING (task_id, k) WHERE NOT coalesce(gone, false)")
def l11_context_apply(spark: SparkSession, d: str) -> DataFrame:
    w = _wal(spark, d)
    base = log.last_by(w.where("seq <= 30"), ["task_id", "k"], "value")
    delta = log.last_by(w.where("seq > 30"), ["task_id", "k"], "value", "operation").select("task_id", "k", "value", (F.col("operation") == "FAIL_TOOL_EXECUTION").alias("deleted"))
    return log.apply_delta(base, delta, ["task_id", "k"])


_GRAPH_END = """, t AS (SELECT task_id, node, max_by(alive, seq) AS alive, max(seq) FILTER (NOT alive) AS gone FROM touch GROUP BY 1, 2),
l AS (SELECT task_id, s, d, max(seq) AS seq FROM (SELECT task_id, seq, CASE op WHEN 'ADD_EDGE' THEN concat('n', k % 3) ELSE concat('n', k % 4 - 1) END AS s, CASE op WHEN 'ADD_EDGE' THEN concat('n', k % 3 + 1) ELSE concat('n', k % 4) END AS d FROM o WHERE op = 'ADD_EDGE' OR op = 'APPEND_NODE' AND k % 3 = 0 AND k % 4 > 0) GROUP BY 1, 2, 3)
SELECT task_id, node AS a, NULL::VARCHAR AS b FROM t WHERE alive UNION ALL
SELECT l.task_id, s, d FROM l LEFT JOIN t x ON x.task_id = l.task_id AND x.node = s LEFT JOIN t y ON y.task_id = l.task_id AND y.node = d WHERE l.seq > greatest(coalesce(x.gone, 0), coalesce(y.gone, 0))"""


@query(using("log").rstrip() + _REPLAY_LOG + _GRAPH_END)
def l11_delta_apply(spark: SparkSession, d: str) -> DataFrame:
    """Graphs from a base and two deltas, each built from its stretch of the log: nodes (``a``) and edges (``a, b``)."""
    p = log.first_of_each_entry(_payload(spark, d))
    at, op = (lambda k: F.col("payload")[k]), F.col("operation")
    touches = p.where(op.isin("APPEND_NODE", "DELETE_NODE")).select("task_id", "seq", at("nodeId").alias("node"), (op == "APPEND_NODE").alias("alive"))
    links = p.where((op == "ADD_EDGE") | ((op == "APPEND_NODE") & at("targetNodeId").isNotNull())).select(
        "task_id", "seq", F.when(op == "ADD_EDGE", at("sourceNodeId")).otherwise(at("targetNodeId")).alias("src"), F.when(op == "ADD_EDGE", at("targetNodeId")).otherwise(at("nodeId")).alias("dst"))
    nodes, edges = log.apply_graph_deltas([log.graph_delta(touches.where(part), links.where(part)) for part in ("seq <= 20", "seq > 20 and seq <= 40", "seq > 40")])
    return nodes.select("task_id", F.col("node").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(edges.select("task_id", F.col("src").alias("a"), F.col("dst").alias("b")))


@query(using("log").rstrip() + _REPLAY_LOG + "SELECT task_id, nodes, edges FROM state")
def l7_nodes_edges(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges after the whole log: appended, completed, deleted with their edges."""
    return log.replay(_payload(spark, d)).select("task_id", "nodes", "edges")


@query(using("log").rstrip() + _REPLAY_LOG + "SELECT task_id, max_by(op, seq) = 'DELETE_TASK' AS tombstone FROM o GROUP BY 1")
def l13_tombstone(spark: SparkSession, d: str) -> DataFrame:
    return log.last_by(log.first_of_each_entry(_payload(spark, d)), ["task_id"], "operation").select("task_id", (F.col("operation") == "DELETE_TASK").alias("tombstone"))


@query(using("log").rstrip() + _REPLAY_LOG + f"SELECT {', '.join(_STATE)} FROM state")
def l1_replay_full(spark: SparkSession, d: str) -> DataFrame:
    return log.replay(_payload(spark, d)).select(*_STATE)


@query(using("checkpoints").rstrip() + _CHAIN + """, p AS (SELECT c.*, r.root_id, r.depth, row_number() OVER (PARTITION BY task_id ORDER BY created_ms DESC, checkpoint_id DESC) AS place, (SELECT max(created_ms) FROM checkpoints) AS now FROM checkpoints c JOIN root r USING (checkpoint_id)),
l AS (SELECT *, (now - created_ms) // 86400000 <= 400 AND place <= 3 AS live FROM p), n AS (SELECT *, max(depth) FILTER (live OR place = 1) OVER (PARTITION BY task_id, root_id) AS need FROM l), k AS (SELECT * FROM n WHERE live OR depth <= need) SELECT task_id, checkpoint_id, live, count(*) OVER (PARTITION BY task_id) AS kept FROM k""")
def t8_retention(spark: SparkSession, d: str) -> DataFrame:
    c = v.checkpoints(spark, d)
    chains = log.base_chains(c).select("checkpoint_id", "root_id", "depth")
    now = c.agg(F.max("created_ms").alias("now_ms"))
    return log.retained(c.join(F.broadcast(now)), chains, F.col("now_ms"), days=400, newest=3)


# learning


@query("""SELECT alpha, beta, round(1.0::DOUBLE - alpha - beta, 6) AS gamma, row_number() OVER (ORDER BY alpha, beta) AS arm FROM (SELECT a / 10 AS alpha, b / 10 AS beta FROM range(1, 9) x(a), range(1, 9) y(b)) WHERE round(1.0::DOUBLE - alpha - beta, 6) BETWEEN 0.05 AND 0.9""")
def b1_arms(spark: SparkSession, d: str) -> DataFrame:
    return learning.arms(spark)


@query(using("ev") + ", w AS (SELECT k % 36 AS arm, 1 + sum(value) / 1000 AS weight FROM ev GROUP BY 1) SELECT arm, round((1 - 0.3::DOUBLE) * weight / (SELECT sum(weight) FROM w) + 0.3::DOUBLE / (SELECT count(*) FROM w), 9) AS p FROM w")
def b2_exp3_distribution(spark: SparkSession, d: str) -> DataFrame:
    w = v.events(spark, d).groupBy((F.col("k") % 36).alias("arm")).agg((1 + F.sum("value") / 1000).alias("weight"))
    return learning.mixture(w, 0.3).select("arm", F.round("p", 9).alias("p"))


@query()
def b3_exp3_fold(spark: SparkSession, d: str) -> DataFrame:
    e = v.events(spark, d)
    pulls = e.select(F.col("event_type").alias("scenario"), F.col("event_id").alias("n"), "ts_ms", (F.col("k") % 36).alias("arm"), F.least(F.lit(1.0), F.col("value") / 100).alias("reward"), ((F.col("k") + 7) % 36).alias("shadow_arm"), F.least(F.lit(1.0), F.col("value") / 120).alias("shadow_reward"))
    return learning.exp3(pulls, 36)


@query(using("ev") + ", w AS (SELECT user_id, k % 36 AS arm, round(sum(value), 6) AS weight FROM ev GROUP BY 1, 2) SELECT user_id, max(arm) FILTER (r = 1) AS best, max(arm) FILTER (r = 2) AS second FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, arm) AS r FROM w) GROUP BY 1")
def b5_best_second(spark: SparkSession, d: str) -> DataFrame:
    w = v.events(spark, d).groupBy("user_id", (F.col("k") % 36).alias("arm")).agg(F.round(F.sum("value"), 6).alias("weight"))
    return learning.best_two(w, "user_id")


@query(using("ev") + "SELECT event_type AS scenario, count(*) >= 20 AND max(ts_ms) - min(ts_ms) >= 14 * 86400000 AND avg((k >= 10)::INT) >= 0.9 AND (avg(value) - 10) / 10 >= 0.2 AS eligible, avg(value) / 10 - 1 <= -0.05 AS rollback FROM ev GROUP BY 1")
def b7_eligibility(spark: SparkSession, d: str) -> DataFrame:
    g = v.events(spark, d).groupBy(F.col("event_type").alias("scenario")).agg(F.count("*").alias("samples"), (F.max("ts_ms") - F.min("ts_ms")).alias("streak_ms"), F.avg((F.col("k") >= 10).cast("double")).alias("win"), ((F.avg("value") - 10) / 10).alias("lift"))
    return g.select("scenario", learning.eligible(F.col("streak_ms"), F.col("samples"), F.col("win"), F.col("lift")).alias("eligible"), (F.col("lift") <= -0.05).alias("rollback"))


_CACHE = """, o AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS opened FROM ev WHERE event_type IN ('signup', 'click')),
s AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN (ts_ms, event_id, opened) END) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS own FROM o)
SELECT session_id, min_by(event_id, (ts_ms, event_id)) AS feedback_id FROM (SELECT *, own[2] AS session_id FROM s WHERE event_type = 'click' AND own IS NOT NULL AND ts_ms - own[1] <= 1800000 AND opened - own[3] < 10000) GROUP BY 1"""


@query(using("ev").rstrip() + _CACHE)
def b8_session_ttl(spark: SparkSession, d: str) -> DataFrame:
    """First feedback of every session: the user's newest one, no older than 30 minutes, and among the newest 10,000 of all."""
    e = v.events(spark, d).where("event_type in ('signup', 'click')").select("user_id", "event_id", "ts_ms", (F.col("event_type") == "signup").cast("bigint").alias("opens"))
    n = ordering.numbered(e.withColumn("all", F.lit(0)), "all", ["ts_ms", "event_id"], "opens")
    return learning.first_feedback(n.withColumn("opened", F.col("before") + F.col("opens")), "user_id", 1_800_000, 10_000)


@query(using("ev") + "SELECT user_id, CASE WHEN n < 8 THEN 3 WHEN h < 0.1 THEN (CASE WHEN h = 0 THEN 0 ELSE 1 END) WHEN h < 0.25 THEN 2 ELSE 3 END AS budget FROM (SELECT user_id, count(*) AS n, count(*) FILTER (k < 20) / count(*) AS h FROM ev GROUP BY 1)")
def b9_prefetch_budget(spark: SparkSession, d: str) -> DataFrame:
    g = v.events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.avg((F.col("k") < 20).cast("double")).alias("h"))
    return g.select("user_id", learning.prefetch_budget(F.col("n"), F.col("h"), 3).alias("budget"))


# prefetch


def _lookahead(spark: SparkSession, d: str) -> DataFrame:
    return graph.lookahead_pages(v.nodes(spark, d), v.edges(spark, d), v.node_pages(spark, d), hops=2, most=3)


@query(using("lookahead") + "SELECT task_id, start, page FROM lookahead")
def v1_dag_prefetch(spark: SparkSession, d: str) -> DataFrame:
    """Pages to load for every current node: of the nodes within two hops, not loaded yet, the most used three."""
    return _lookahead(spark, d)


_CENT = """, cen AS (SELECT namespace, page_id, list(m ORDER BY pos) AS e FROM (SELECT namespace, page_id, pos, avg(x) AS m FROM (SELECT namespace, page_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(128)) AS pos FROM pages JOIN vec USING (id)) GROUP BY 1, 2, 3) GROUP BY 1, 2) """


@query(using("pages", "vec").rstrip() + _CENT + "SELECT page_id, other, rank FROM (SELECT a.page_id, b.page_id AS other, row_number() OVER (PARTITION BY a.page_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.page_id) AS rank FROM cen a JOIN cen b ON a.namespace = b.namespace AND a.page_id <> b.page_id AND round(list_cosine_similarity(a.e, b.e), 6) >= 0.7) WHERE rank <= 3")
def v2_semantic_prefetch(spark: SparkSession, d: str) -> DataFrame:
    p = v.pages(spark, d).select("id", "page_id", "namespace").join(v.embeddings(spark, d), "id")
    c = graph.centroids(p, "page_id", "embedding").join(p.select("page_id", "namespace").distinct(), "page_id")
    # a namespace has at most 16 pages here, one per first digit
    a = c.select("namespace", "page_id", F.col("values").alias("x"))
    b = c.select("namespace", F.col("page_id").alias("other"), F.col("values").alias("y"))
    s = a.join(b, "namespace").where("page_id <> other").withColumn("s", F.round(scalar.dot(F.col("x"), F.col("y")), 6)).where("s >= 0.7")
    w = Window.partitionBy("page_id").orderBy(F.col("s").desc(), "other")
    return s.select("page_id", "other", F.row_number().over(w).cast("bigint").alias("rank")).where("rank <= 3")


@query(using("node_pages", "nodes") + "SELECT b.task_id, branch, source, min(page) AS page FROM (SELECT task_id, branch, min(node) AS source FROM nodes GROUP BY 1, 2) b JOIN node_pages p ON p.task_id = b.task_id AND p.node = b.source WHERE p.state = 'EVICTED' GROUP BY 1, 2, 3")
def v3_branch_prefetch(spark: SparkSession, d: str) -> DataFrame:
    """One page of the source node of every new branch, if some isn't loaded."""
    b = v.nodes(spark, d).groupBy("task_id", "branch").agg(F.min("node").alias("source"))
    p = v.node_pages(spark, d).where("state not in ('RESIDENT', 'FAULTING')").select("task_id", F.col("node").alias("source"), "page")
    return b.join(p, ["task_id", "source"]).groupBy("task_id", "branch", "source").agg(F.min("page").alias("page"))


@query(using("ev") + "SELECT l.event_id AS load_id, CASE WHEN count(a.event_id) > 0 THEN 'consumed' ELSE 'missed' END AS outcome FROM ev l LEFT JOIN ev a ON a.user_id = l.user_id AND a.event_type = 'view' AND a.ts_ms BETWEEN l.ts_ms AND l.ts_ms + 120000 WHERE l.event_type = 'signup' GROUP BY 1")
def v4_consumption(spark: SparkSession, d: str) -> DataFrame:
    e = v.events(spark, d)
    load = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("load_id"), F.col("ts_ms").alias("evict_ms"))
    used = eviction.regrets(load, e.where("event_type = 'view'").select("user_id", F.col("ts_ms").alias("recall_ms")), "user_id", 120_000).select("load_id").distinct().withColumn("outcome", F.lit("consumed"))
    return load.select("load_id").join(used, "load_id", "left").na.fill("missed", ["outcome"])


@query(using("pages") + "SELECT page_id, id, place FROM (SELECT *, row_number() OVER w AS place, sum(token_count) OVER (w ROWS UNBOUNDED PRECEDING) AS loaded FROM pages WHERE state = 'EVICTED' WINDOW w AS (PARTITION BY page_id ORDER BY last_access_ms DESC NULLS LAST, id)) WHERE place = 1 OR loaded <= 400")
def v5_fault_order(spark: SparkSession, d: str) -> DataFrame:
    # the faulting fragment first, then its page companions while there is room
    p = v.pages(spark, d).where("state = 'EVICTED'")
    w = Window.partitionBy("page_id").orderBy(F.col("last_access_ms").desc_nulls_last(), "id")
    o = p.withColumn("place", F.row_number().over(w)).withColumn("loaded", F.sum("token_count").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return o.where("place = 1 or loaded <= 400").select("page_id", "id", F.col("place").cast("bigint").alias("place"))


@query()
def v6_admission(spark: SparkSession, d: str) -> DataFrame:
    e = v.events(spark, d)
    r = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (F.col("k") + 1).cast("bigint").alias("tokens"), (F.col("event_type") == "purchase").alias("pinned"))
    return eviction.admissions(r, 1000, 400)


@query(using("fragments") + "SELECT namespace, CAST(sum(token_count) AS BIGINT) AS used, sum(token_count) / 2000 >= 0.85 AS triggered, CASE WHEN sum(token_count) / 2000 >= 0.85 THEN 200 ELSE 0 END AS target FROM fragments GROUP BY 1")
def v7_evict_trigger(spark: SparkSession, d: str) -> DataFrame:
    u = eviction.usage(v.fragments(spark, d), "namespace", "token_count")
    # a namespace of 2,000 tokens is relieved of a tenth
    return u.withColumn("triggered", F.col("used") / 2000 >= 0.85).withColumn("target", F.when(F.col("triggered"), 200).otherwise(0))


@query(using("fragments") + f"SELECT namespace, count(*) AS pinned, CAST(sum(token_count) AS BIGINT) AS tokens, min(pinned_until_ms) AS first_expiry FROM fragments WHERE pinned_until_ms > {NOW} - 5000000000 GROUP BY 1")
def v8_pin_index(spark: SparkSession, d: str) -> DataFrame:
    f = v.fragments(spark, d).where(scalar.is_pinned(F.col("pinned_until_ms"), F.lit(v.NOW_MS - 5_000_000_000)))
    return f.groupBy("namespace").agg(F.count("*").alias("pinned"), F.sum("token_count").alias("tokens"), F.min("pinned_until_ms").alias("first_expiry"))
