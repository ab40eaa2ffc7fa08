"""Scans, sinks and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar, text
from tidemark.functions.names import clean_name
from tidemark.operators import ordering, recall, stores
from tidemark.plans import views as v
from tidemark.plans.registry import query
from tidemark.plans.sqlviews import ASKS, NOW, using

HOT_NS = "atlas-frontdesk"


@query(using("fragments") + f"SELECT id, token_count, importance FROM fragments WHERE tier = 'L1' AND namespace = '{HOT_NS}'")
def s1_l1_namespace_scan(spark: SparkSession, d: str) -> DataFrame:
    return v.fragments(spark, d).where((F.col("tier") == "L1") & (F.col("namespace") == HOT_NS)).select("id", "token_count", "importance")


@query(using("fragments") + "SELECT id, namespace, token_count FROM fragments WHERE tier = 'L1'")
def s2_l1_full_scan(spark: SparkSession, d: str) -> DataFrame:
    return v.fragments(spark, d).where("tier = 'L1'").select("id", "namespace", "token_count")


@query(using("fragments") + f"SELECT id, tier, {NOW} AS last_access_ms FROM fragments WHERE id IN (SELECT min(id) FROM fragments GROUP BY namespace)")
def s3_point_lookup_touch(spark: SparkSession, d: str) -> DataFrame:
    f = v.fragments(spark, d)
    wanted = f.groupBy("namespace").agg(F.min("id").alias("id"))
    return f.join(wanted.select("id"), "id", "left_semi").select("id", "tier", F.lit(v.NOW_MS).cast("bigint").alias("last_access_ms"))


_VEC_TOPK = f"""SELECT * FROM (SELECT f.id, round(list_cosine_similarity(f.embedding::DOUBLE[], q.e), 6) AS score, token_count,
  row_number() OVER (ORDER BY round(list_cosine_similarity(f.embedding::DOUBLE[], q.e), 6) DESC, f.id) AS rank
  FROM (SELECT * FROM fragments JOIN vec USING (id)) f, (SELECT embedding::DOUBLE[] AS e FROM fragments JOIN vec USING (id) WHERE namespace = '{HOT_NS}' ORDER BY id LIMIT 1) q
  WHERE namespace = '{HOT_NS}') WHERE rank <= 20"""


@query(using("fragments", "vec") + _VEC_TOPK)
def s4_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    f = v.fragments(spark, d, vectors=True).where((F.col("namespace") == HOT_NS) & F.col("embedding").isNotNull())
    q = f.orderBy("id").limit(1).select(F.col("embedding").alias("q"))
    scored = f.join(F.broadcast(q)).select("id", "token_count", F.round(scalar.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    top = scored.orderBy(F.col("score").desc(), "id").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).cast("bigint"))


_VEC_EACH = f""", v AS (SELECT id, namespace, token_count, embedding::DOUBLE[] AS e FROM fragments JOIN vec USING (id)),
s AS (SELECT q.id AS query_id, v.id, v.token_count, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v JOIN v q USING (namespace) WHERE {ASKS.format("q.id")})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 20"""


@query(using("fragments", "vec").rstrip() + _VEC_EACH)
def s4_vector_topk_each(spark: SparkSession, d: str) -> DataFrame:
    """The search of ``s4_vector_topk`` for one id in twenty of every namespace."""
    f = v.fragments(spark, d, vectors=True).where("embedding is not null")
    found = recall.vector_search(f, f.where(v.asks(F.col("id"))), 20)
    return found.join(f.select("id", "token_count"), "id").select("query_id", "id", "token_count", "score", "rank")


@query(using("fragments") + "SELECT namespace, id, rank FROM (SELECT namespace, id, row_number() OVER (PARTITION BY namespace ORDER BY id) AS rank FROM fragments) WHERE rank <= 3")
def s6_namespace_listing(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("namespace").orderBy("id")
    return v.fragments(spark, d).select("namespace", "id", F.row_number().over(w).cast("bigint").alias("rank")).where("rank <= 3")


@query(using("checkpoints") + "SELECT task_id, checkpoint_id, kind, row_number() OVER (PARTITION BY task_id ORDER BY created_ms NULLS LAST, checkpoint_id) AS place FROM (SELECT task_id, checkpoint_id, CASE WHEN checkpoint_id % 9 <> 0 THEN kind END AS kind, CASE WHEN checkpoint_id % 9 <> 0 THEN created_ms END AS created_ms FROM checkpoints)")
def s9_checkpoint_listing(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints by time; a payload without metadata is listed bare, after the others."""
    c = v.checkpoints(spark, d)
    listed = stores.checkpoint_listing(c.where("checkpoint_id % 9 <> 0").select("task_id", "checkpoint_id", "kind", "created_ms"), c.select("task_id", "checkpoint_id"))
    w = Window.partitionBy("task_id").orderBy(F.col("created_ms").asc_nulls_last(), "checkpoint_id")
    return listed.select("task_id", "checkpoint_id", "kind", F.row_number().over(w).cast("bigint").alias("place"))


@query(using("checkpoints") + "SELECT DISTINCT split_part(concat('checkpoints/', task_id, '/', checkpoint_id, '.meta'), '/', 2) AS task FROM checkpoints")
def s10_distinct_tasks(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("checkpoints/"), "task_id", F.lit("/"), "checkpoint_id", F.lit(".meta"))
    return v.checkpoints(spark, d).select(F.split_part(key, F.lit("/"), F.lit(2)).alias("task")).distinct()


@query(using("wal") + "SELECT task_id, seq, operation FROM wal WHERE seq >= 20")
def s11_wal_from_seq(spark: SparkSession, d: str) -> DataFrame:
    return v.wal(spark, d).where("seq >= 20").select("task_id", "seq", "operation")


@query(using("wal") + "SELECT task_id, max(seq) AS seq, max_by(entry_id, seq) AS entry_id, max_by(operation, seq) AS operation FROM wal GROUP BY 1")
def s12_wal_last_entry(spark: SparkSession, d: str) -> DataFrame:
    w = v.wal(spark, d).groupBy("task_id").agg(F.max("seq").alias("seq"), F.max_by(F.struct("entry_id", "operation"), "seq").alias("e"))
    return w.select("task_id", "seq", "e.entry_id", "e.operation")


@query("SELECT fragment_id AS own_id, coalesce(nullif(trim(namespace, ' '), ''), reasoning_chain_id, fragment_id) AS owner, coalesce(content, '') = '' AS empty FROM memory_fragments")
def s14_alias_coalesce(spark: SparkSession, d: str) -> DataFrame:
    f = v.table(spark, d, "memory_fragments")
    return f.select(F.col("fragment_id").alias("own_id"), F.coalesce(F.nullif(F.trim("namespace"), F.lit("")), "reasoning_chain_id", "fragment_id").alias("owner"), (F.coalesce("content", F.lit("")) == "").alias("empty"))


@query(using("fragments") + """SELECT page_id, 'EVICTED' AS state, count(*) AS members, row_number() OVER (ORDER BY page_id) AS next_sequence FROM (
  SELECT DISTINCT concat(lower(trim(namespace, ' ')), '-', substr(fragment_id, 1, 1)) AS page_id, fragment_id FROM recall_candidates WHERE fragment_id IS NOT NULL AND trim(coalesce(namespace, ''), ' ') <> '') WHERE fragment_id IN (SELECT id FROM fragments) GROUP BY 1""")
def s16_page_table_load(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a snapshot: references to fragments that are gone are dropped, every page starts evicted."""
    c = v.table(spark, d, "recall_candidates").select(clean_name(F.col("namespace")).alias("namespace"), F.col("fragment_id").alias("id")).where("namespace is not null and id is not null")
    refs = c.select(F.concat_ws("-", "namespace", F.substring("id", 1, 1)).alias("page_id"), "id").distinct().join(v.fragments(spark, d).select("id"), "id", "left_semi")
    p = refs.groupBy("page_id").agg(F.count("*").alias("members")).withColumn("all", F.lit(0))
    return ordering.numbered(p, "all", ["page_id"], rank="next_sequence").select("page_id", F.lit("EVICTED").alias("state"), "members", "next_sequence")


@query("SELECT fragment_id AS id, max(last_access_time) AS last_access_ms, max_by(token_count, (last_access_time, epoch_us(ingested_at), coalesce(token_count, -999999))) AS token_count FROM memory_fragments WHERE fragment_id IS NOT NULL GROUP BY 1")
def k1_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    f = v.table(spark, d, "memory_fragments").where("fragment_id is not null")
    best = F.max_by("token_count", F.struct("last_access_time", F.unix_micros("ingested_at"), F.coalesce("token_count", F.lit(-999999))))
    return f.groupBy(F.col("fragment_id").alias("id")).agg(F.max("last_access_time").alias("last_access_ms"), best.alias("token_count"))


@query(using("vec") + "SELECT id, len(embedding) AS width, round(CASE WHEN id < '8' THEN 2 * embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) AS first FROM vec")
def k2_vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that go to the warm store: the second model's where there is one, else the first's."""
    e = v.embeddings(spark, d).withColumn("l2_embedding", F.when(F.col("id") < "8", F.transform("embedding", lambda x: x * 2)))
    u = stores.warm_rows(e)
    return u.select("id", F.size("vector").cast("bigint").alias("width"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query(using("fragments") + "SELECT id, namespace FROM fragments WHERE id NOT IN (SELECT fragment_id FROM recall_candidates WHERE fragment_id IS NOT NULL AND candidate_id % 10 = 0)")
def k3_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = v.table(spark, d, "recall_candidates").where("fragment_id is not null and candidate_id % 10 = 0").select(F.col("fragment_id").alias("id"))
    return stores.delete(v.fragments(spark, d), gone, "id").select("id", "namespace")


@query(using("log") + "SELECT task_id, entry_id, row_number() OVER (PARTITION BY task_id ORDER BY ts_ms, CAST(entry_id AS BIGINT)) AS sequence_number FROM log WHERE regexp_full_match(task_id, '[A-Za-z0-9_-]{1,128}')")
def k5_wal_sequence(spark: SparkSession, d: str) -> DataFrame:
    e = v.wal(spark, d, repeats=False).select("task_id", "entry_id", "ts_ms")
    return stores.append_log(e, "task_id", F.col("ts_ms"), F.col("entry_id").cast("bigint")).drop("ts_ms")


@query(using("log") + "SELECT task_id, seq, operation FROM log JOIN (SELECT task_id, max(seq) // 2 AS point FROM log GROUP BY 1) USING (task_id) WHERE seq > point")
def k6_wal_truncate(spark: SparkSession, d: str) -> DataFrame:
    log = v.wal(spark, d, repeats=False)
    points = log.groupBy("task_id").agg(F.floor(F.max("seq") / 2).alias("point"))
    return stores.truncate_log(log, points).select("task_id", "seq", "operation")


_KEY = "concat_ws(':', concat('u', user_id), CAST(k AS VARCHAR), replace(lower(concat('After ', event_type)), ' ', '-'))"


@query(using("ev") + f"SELECT key, min(event_id) AS event_id FROM (SELECT {_KEY} AS key, event_id FROM ev) WHERE key NOT IN (SELECT {_KEY} FROM ev WHERE event_id % 25 = 0) GROUP BY 1")
def k7_idempotent_persist(spark: SparkSession, d: str) -> DataFrame:
    e = v.events(spark, d)
    tasks = e.select(stores.idempotency_key(F.concat(F.lit("u"), "user_id"), F.col("k").cast("string"), F.concat(F.lit("After "), "event_type")).alias("key"), "event_id")
    return stores.pending(tasks, tasks.where("event_id % 25 = 0"), "key", F.col("event_id"))


@query(using("ev") + "SELECT CASE WHEN k % 3 = 0 THEN 'recovered' WHEN k % 7 + 1 >= 5 THEN 'discarded' ELSE 'retried' END AS outcome, count(*) AS n, max(k % 7 + 1) AS most_attempts FROM ev GROUP BY 1")
def k8_dlq_replay(spark: SparkSession, d: str) -> DataFrame:
    e = v.events(spark, d)
    out = stores.retry_outcome(F.col("k") % 3 == 0, F.col("k") % 7)
    return e.groupBy(out.alias("outcome")).agg(F.count("*").alias("n"), F.max(F.col("k") % 7 + 1).alias("most_attempts"))


@query(using("ev") + "SELECT event_id, ts_ms FROM ev ORDER BY ts_ms DESC, event_id DESC LIMIT 10000")
def k9_processed_trim(spark: SparkSession, d: str) -> DataFrame:
    return stores.newest(v.events(spark, d).select("event_id", "ts_ms"), 10_000, F.col("ts_ms").desc(), F.col("event_id").desc())


@query(using("edges") + """SELECT task_id, string_agg(concat('"', src, '" -> "', dst, '";'), chr(10) ORDER BY src, dst) AS dot, count(*) AS n_edges FROM edges GROUP BY 1""")
def k11_dot_export(spark: SparkSession, d: str) -> DataFrame:
    e = v.edges(spark, d).select("task_id", F.struct("src", "dst").alias("e"))
    line = lambda x: F.concat(F.lit('"'), x["src"], F.lit('" -> "'), x["dst"], F.lit('";'))
    g = e.groupBy("task_id").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return g.select("task_id", F.concat_ws("\n", F.transform("e", line)).alias("dot"), F.size("e").cast("bigint").alias("n_edges"))


@query(using("fragments") + "SELECT id, array_to_string(list_filter(raw_tags, lambda t, i: list_position(raw_tags, t) = i), '|') AS tags FROM fragments")
def pred1_normalize_tags(spark: SparkSession, d: str) -> DataFrame:
    return v.fragments(spark, d).select("id", F.concat_ws("|", text.normalized_tags(F.col("tags"))).alias("tags"))


@query(using("fragments") + "SELECT id FROM fragments WHERE list_contains(raw_tags, 'task:gaxgolun')")
def pred2_tag_and_filter(spark: SparkSession, d: str) -> DataFrame:
    return v.fragments(spark, d).where(text.matches_all(F.col("tags"), ["task:gaxgolun"])).select("id")


@query(using("candidates", "fragments") + "SELECT candidate_id, id FROM candidates JOIN fragments ON id = fragment_id AND fragments.namespace = candidates.namespace")
def pred3_namespace_isolation(spark: SparkSession, d: str) -> DataFrame:
    """Offers of a fragment that lies in the namespace of the recall."""
    c = v.candidates(spark, d).select("candidate_id", "namespace", F.col("fragment_id").alias("id"))
    return c.join(v.fragments(spark, d).select("id", "namespace"), ["id", "namespace"]).select("candidate_id", "id")


@query(using("fragments") + f"SELECT id, coalesce(pinned_until_ms > {NOW}, false) AS pinned, CASE WHEN pinned_until_ms > {NOW} THEN pinned_until_ms END AS pinned_until_ms FROM fragments")
def pred4_pin_expiry(spark: SparkSession, d: str) -> DataFrame:
    pinned = scalar.is_pinned(F.col("pinned_until_ms"), F.lit(v.NOW_MS))
    return v.fragments(spark, d).select("id", pinned.alias("pinned"), F.when(pinned, F.col("pinned_until_ms")).alias("pinned_until_ms"))


@query(using("ev") + "SELECT user_id, max(ts_ms) AS last_ms, (SELECT max(ts_ms) FROM ev) - max(ts_ms) <= 300000 AS hot FROM ev GROUP BY 1")
def pred5_hot_cold(spark: SparkSession, d: str) -> DataFrame:
    e = v.events(spark, d)
    now = e.agg(F.max("ts_ms").alias("now_ms"))
    last = e.groupBy("user_id").agg(F.max("ts_ms").alias("last_ms"))
    return last.join(F.broadcast(now)).select("user_id", "last_ms", scalar.is_hot(F.col("last_ms"), F.col("now_ms")).alias("hot"))


@query(using("scored_pool") + "SELECT candidate_id, round(recency, 6) AS recency, round(penalty, 6)::DOUBLE AS penalty, round(novelty, 6)::DOUBLE AS novelty, round(0.3::DOUBLE * recency + 0.5::DOUBLE * semantic + 0.2::DOUBLE * importance - penalty + novelty, 6) AS score FROM scored_pool")
def pred6_score_breakdown(spark: SparkSession, d: str) -> DataFrame:
    score = scalar.memory_score(F.col("recency"), F.col("semantic"), F.col("importance"), F.col("penalty"), F.col("novelty"))
    return v.scored_pool(spark, d).select("candidate_id", *(F.round(c, 6).alias(c) for c in ("recency", "penalty", "novelty")), F.round(score, 6).alias("score"))


@query(using("fragments") + "SELECT id, round(least(1.0, importance + (1 - importance) * 0.15), 9) AS importance FROM fragments")
def pred7_reinforce(spark: SparkSession, d: str) -> DataFrame:
    return v.fragments(spark, d).select("id", F.round(scalar.reinforced(F.col("importance")), 9).alias("importance"))


@query(using("candidates") + "SELECT recall_id, candidate_id, rank FROM (SELECT recall_id, candidate_id, row_number() OVER (PARTITION BY recall_id ORDER BY keyword DESC, candidate_id) AS rank FROM candidates WHERE keyword > 0) WHERE rank <= 8")
def pred8_positive_limit(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("recall_id").orderBy(F.col("keyword").desc(), "candidate_id")
    return v.candidates(spark, d).where("keyword > 0").select("recall_id", "candidate_id", F.row_number().over(w).cast("bigint").alias("rank")).where("rank <= 8")


@query("SELECT request_id, content IS NOT NULL AND trim(content, ' ') <> '' AND length(content) <= 20000 AS content_ok, coalesce(pin_ttl_millis >= 0, true) AS ttl_ok, length(request_id) BETWEEN 1 AND 128 AS id_ok FROM store_requests")
def pred10_request_validation(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("content").isNotNull() & (F.trim("content") != "") & (F.length("content") <= 20_000)
    return v.table(spark, d, "store_requests").select("request_id", ok.alias("content_ok"), F.coalesce(F.col("pin_ttl_millis") >= 0, F.lit(True)).alias("ttl_ok"), F.length("request_id").between(1, 128).alias("id_ok"))


@query(using("nodes") + "SELECT task_id, node FROM nodes WHERE branch = 1")
def pred12_branch_membership(spark: SparkSession, d: str) -> DataFrame:
    n = v.nodes(spark, d).withColumn("metadata", F.create_map(F.lit("branchId"), F.col("branch").cast("string")))
    return n.where(F.col("metadata")["branchId"] == "1").select("task_id", "node")


@query("SELECT o_orderkey AS task_id FROM orders WHERE o_orderstatus NOT IN ('F') AND o_orderpriority <> '5-LOW'")
def pred11_active_tasks(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    return o.where(~F.col("o_orderstatus").isin("F") & (F.col("o_orderpriority") != "5-LOW")).select(F.col("o_orderkey").alias("task_id"))


@query("SELECT k, greatest(16, 4 * k) AS vector_limit, greatest(16, 4 * k, 8 * k) AS fallback_limit, greatest(32, 8 * k, 256) AS keyword_pool, greatest(16, 4 * k) AS keyword_hits FROM range(1, 101) t(k)")
def t7_search_limits(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of the candidate pools of a recall of ``k``."""
    k = spark.range(1, 101).withColumnRenamed("id", "k")
    return k.select("k", *(c.alias(n) for n, c in stores.search_limits(F.col("k")).items()))
