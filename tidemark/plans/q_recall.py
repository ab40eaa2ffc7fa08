"""Joins, ranking, greedy selection and sets of the read path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar, text
from tidemark.operators import recall, stores
from tidemark.plans import views as v
from tidemark.plans.registry import query
from tidemark.plans.sqlviews import ASKS, NOW, using
from tidemark.storage import written

_TIERS = "CASE tier WHEN 'L1' THEN 0 WHEN 'L3' THEN 1 ELSE 2 END"


@query(using("candidates") + f"SELECT DISTINCT fragment_id AS id, min({_TIERS}) OVER (PARTITION BY fragment_id) AS tier_no FROM candidates")
def j1_tier_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = v.candidates(spark, d).select(F.col("fragment_id").alias("id"), "tier")
    held = c.distinct()
    tiers = [held.where(F.col("tier") == t).select("id") for t in ("L1", "L3", "L2")]
    return stores.resolve_tiers(c.select("id").distinct(), tiers)


@query(using("candidates", "fragments", "vec") + """SELECT candidate_id, CASE WHEN f.id IS NOT NULL AND f.tagged THEN 'resolved' WHEN c.tier <> 'L3' AND candidate_id % 3 <> 0 THEN 'candidate' WHEN w.id IS NOT NULL AND w.tagged THEN 'warm_copy' ELSE 'rejected' END AS origin
  FROM candidates c LEFT JOIN (SELECT id, namespace, len(list_filter(raw_tags, lambda t: starts_with(t, 'kind:'))) > 0 AS tagged FROM fragments) f ON f.id = c.fragment_id AND f.namespace = c.namespace
  LEFT JOIN (SELECT v.id, coalesce(contains(w.tags, 'kind:'), false) AS tagged FROM vec v JOIN (SELECT fragment_id, max(tags) AS tags FROM warm_vectors GROUP BY 1) w ON w.fragment_id = v.id) w ON w.id = c.fragment_id""")
def j2_enrich_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Where the enriched row of a candidate comes from, its tags checked at every step: the fragment, the candidate itself, the warm copy."""
    f = v.fragments(spark, d).select(F.col("id").alias("fragment_id"), "namespace", F.exists("tags", lambda t: t.startswith("kind:")).alias("resolved"))
    w = v.table(spark, d, "warm_vectors").groupBy("fragment_id").agg(F.max("tags").alias("t")).join(v.embeddings(spark, d).select(F.col("id").alias("fragment_id")), "fragment_id")
    w = w.select("fragment_id", F.coalesce(F.col("t").contains("kind:"), F.lit(False)).alias("warm"))
    c = v.candidates(spark, d).join(f, ["fragment_id", "namespace"], "left").join(w, "fragment_id", "left")
    origin = F.when(F.col("resolved"), "resolved").when((F.col("tier") != "L3") & (F.col("candidate_id") % 3 != 0), "candidate").when(F.col("warm"), "warm_copy").otherwise("rejected")
    return c.select("candidate_id", origin.alias("origin"))


@query(using("pool") + """SELECT recall_id, fragment_id, coalesce(s.semantic, 0) AS semantic, coalesce(k.keyword, 0) AS keyword
  FROM (SELECT recall_id, fragment_id, semantic FROM pool WHERE tier <> 'L3') s FULL JOIN (SELECT recall_id, fragment_id, keyword FROM pool WHERE keyword > 0) k USING (recall_id, fragment_id)""")
def j3_candidate_full_outer(spark: SparkSession, d: str) -> DataFrame:
    p = v.pool(spark, d)
    s = p.where("tier <> 'L3'").select("recall_id", "fragment_id", "semantic")
    k = p.where("keyword > 0").select("recall_id", "fragment_id", "keyword")
    return s.join(k, ["recall_id", "fragment_id"], "full_outer").na.fill(0.0, ["semantic", "keyword"])


_PEERS = """, peers AS (SELECT a.id, max(list_cosine_similarity(a.e, b.e)) AS sim FROM (SELECT id, namespace, embedding::DOUBLE[] AS e FROM fragments JOIN vec USING (id)) a
  JOIN (SELECT id, namespace, embedding::DOUBLE[] AS e FROM fragments JOIN vec USING (id)) b ON a.namespace = b.namespace AND a.id <> b.id GROUP BY 1) """


@query(using("fragments", "vec").rstrip() + _PEERS + """SELECT id, round(coalesce(sim, 0), 6) AS sim, round(CASE WHEN sim IS NULL OR sim < 0.95 THEN 0 ELSE least(0.25::DOUBLE, sim - 0.95::DOUBLE) END, 6)::DOUBLE AS penalty,
  round(CASE WHEN sim IS NULL THEN 0 ELSE least(0.15::DOUBLE, greatest(0, 1 - sim) * 0.15::DOUBLE) END, 6)::DOUBLE AS novelty FROM fragments JOIN vec USING (id) LEFT JOIN peers USING (id)""")
def j4_redundancy_theta(spark: SparkSession, d: str) -> DataFrame:
    f = v.fragments(spark, d, vectors=True).where("embedding is not null")
    p = recall.nearest_peer(f).withColumn("lone", F.col("sim").isNull())
    pen = F.when(F.col("lone"), 0.0).otherwise(scalar.redundancy_penalty(F.col("sim")))
    nov = F.when(F.col("lone"), 0.0).otherwise(scalar.novelty_bonus(F.col("sim")))
    return p.select("id", F.round(F.coalesce("sim", F.lit(0.0)), 6).alias("sim"), F.round(pen, 6).alias("penalty"), F.round(nov, 6).alias("novelty"))


@query(using("fragments", "vec").rstrip() + _PEERS + "SELECT id, round(sim, 6) AS sim FROM fragments JOIN vec USING (id) LEFT JOIN peers USING (id)")
def j5_incremental_redundancy(spark: SparkSession, d: str) -> DataFrame:
    f = v.fragments(spark, d, vectors=True).where("embedding is not null").withColumn("fresh", F.col("id") >= "c")
    old = recall.nearest_peer(f.where("not fresh"))
    return recall.add_peers(old, f, "fresh").select("id", F.round("sim", 6).alias("sim"))


@query(using("pages", "vec") + """, v AS (SELECT p.id, namespace, state, embedding::DOUBLE[] AS e FROM pages p JOIN vec USING (id))
SELECT id, peer, place FROM (SELECT a.id, b.id AS peer, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.id) AS place FROM v a JOIN v b ON a.namespace = b.namespace AND a.id <> b.id) JOIN (SELECT id FROM v WHERE state = 'EVICTED') USING (id) WHERE place <= 9""")
def j10_neighbour_group(spark: SparkSession, d: str) -> DataFrame:
    p = v.pages(spark, d)
    f = p.select("id", "namespace").join(v.embeddings(spark, d), "id")
    return recall.peer_groups(f, 9).join(p.where("state = 'EVICTED'").select("id"), "id", "left_semi").select("id", "peer", "place")


@query(using("pages", "vec").rstrip() + """, m AS (SELECT namespace, page_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(128)) AS pos FROM pages JOIN vec USING (id) WHERE id < 'c'),
cen AS (SELECT namespace, page_id, list(m ORDER BY pos) AS e, any_value(n) AS n FROM (SELECT namespace, page_id, pos, avg(x) AS m, count(*) AS n FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT id, min_by(page_id, (distance, page_id)) AS page_id, min(distance) AS distance FROM (SELECT p.id, c.page_id, round(1 - list_cosine_similarity(v.embedding::DOUBLE[], c.e), 6) AS distance FROM pages p JOIN vec v USING (id) JOIN cen c ON c.namespace = p.namespace WHERE p.id >= 'c' AND c.n < 30)
WHERE distance <= 0.30 GROUP BY 1""")
def j9_nearest_page(spark: SparkSession, d: str) -> DataFrame:
    """Page of the namespace that a new fragment joins: the nearest one with room, within reach of .30."""
    from tidemark.operators import graph

    p = v.pages(spark, d).select("id", "namespace", "page_id").join(v.embeddings(spark, d), "id")
    old = p.where("id < 'c'")
    c = graph.centroids(old, "page_id", "embedding").where("n < 30").join(old.select("page_id", "namespace").distinct(), "page_id")
    return graph.nearest_open_page(p.where("id >= 'c'").select("id", "namespace", "embedding"), c.select("namespace", "page_id", F.col("values").alias("centre")), 0.30)


@query(using("ev") + """SELECT e.event_id AS evict_id, min(c.ts_ms) AS recall_ms, count(*) AS recalls FROM ev e JOIN ev c ON c.user_id = e.user_id AND c.ts_ms >= e.ts_ms AND c.ts_ms - e.ts_ms <= 3600000
  WHERE e.event_type = 'error' AND c.event_type = 'click' GROUP BY 1""")
def j7_regret_interval(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.eviction import regrets

    e = v.events(spark, d)
    ev = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("evict_id"), F.col("ts_ms").alias("evict_ms"))
    rc = e.where("event_type = 'click'").select("user_id", F.col("ts_ms").alias("recall_ms"))
    return regrets(ev, rc, "user_id").groupBy("evict_id").agg(F.min("recall_ms").alias("recall_ms"), F.count("*").alias("recalls"))


@query(using("pages", "candidates") + "SELECT candidate_id, page_id, state FROM candidates c JOIN pages p ON p.id = c.fragment_id")
def j8_page_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = v.pages(spark, d).select(F.col("id").alias("fragment_id"), "page_id", "state")
    return v.candidates(spark, d).join(p, "fragment_id").select("candidate_id", "page_id", "state")


@query(using("pages", "vec") + "SELECT page_id, id FROM pages WHERE id NOT IN (SELECT id FROM vec)")
def j11_missing_members(spark: SparkSession, d: str) -> DataFrame:
    return v.pages(spark, d).join(v.embeddings(spark, d).select("id"), "id", "left_anti").select("page_id", "id")


@query(using("case_results", "candidates") + "SELECT case_id, mode, fragment_id FROM case_results r WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.recall_id = r.case_id AND c.fragment_id = r.fragment_id AND c.tier = 'L1')")
def j14_foreign_fragments(spark: SparkSession, d: str) -> DataFrame:
    own = v.candidates(spark, d).where("tier = 'L1'").select(F.col("recall_id").alias("case_id"), "fragment_id")
    return v.case_results(spark, d).join(own, ["case_id", "fragment_id"], "left_anti").select("case_id", "mode", "fragment_id")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size = 7) AND lower(p_brand) NOT IN (SELECT lower(p_brand) FROM part WHERE p_size = 11 AND p_partkey % 3 = 0)")
def j15_include_exclude(spark: SparkSession, d: str) -> DataFrame:
    p = v.table(spark, d, "part")
    inc = p.where("p_size = 7").select(F.lower("p_name").alias("n"))
    exc = p.where("p_size = 11 and p_partkey % 3 = 0").select(F.lower("p_brand").alias("b"))
    out = p.withColumn("n", F.lower("p_name")).withColumn("b", F.lower("p_brand"))
    return out.join(inc, "n", "left_semi").join(exc, "b", "left_anti").select("p_partkey", "p_name")


@query("""WITH n AS (SELECT lower(p_name) AS name, p_size, p_partkey FROM part), inc AS (SELECT DISTINCT name FROM n WHERE p_size = 7 UNION SELECT 'no such part'), exc AS (SELECT DISTINCT name FROM n WHERE p_size = 11 OR p_size = 7 AND p_partkey % 5 = 0)
SELECT 'overlap' AS error, name FROM inc WHERE name IN (SELECT name FROM exc) UNION ALL SELECT 'missing', name FROM inc WHERE name NOT IN (SELECT name FROM n)""")
def j15_list_errors(spark: SparkSession, d: str) -> DataFrame:
    """Names that two lists can't be used with: on both of them, or in no row."""
    n = v.table(spark, d, "part").withColumn("name", F.lower("p_name"))
    inc = n.where("p_size = 7").select("name").unionByName(spark.createDataFrame([("no such part",)], "name string")).distinct()
    exc = n.where("p_size = 11 or p_size = 7 and p_partkey % 5 = 0").select("name")
    return inc.join(exc, "name", "left_semi").select(F.lit("overlap").alias("error"), "name").unionByName(inc.join(n, "name", "left_anti").select(F.lit("missing").alias("error"), "name"))


@query(using("ev") + """, s AS (SELECT *, max(CASE WHEN event_type = 'view' THEN (ts_ms, event_id) END) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS own FROM ev WHERE event_type IN ('view', 'purchase'))
SELECT own[2] AS session_id, min_by(event_id, (ts_ms, event_id)) AS feedback_id FROM s WHERE event_type = 'purchase' AND own IS NOT NULL AND ts_ms - own[1] <= 1800000 GROUP BY 1""")
def j17_feedback_join(spark: SparkSession, d: str) -> DataFrame:
    """Feedback to the user's newest session; each session is consumed by its first feedback."""
    from tidemark.operators.learning import first_feedback

    e = v.events(spark, d).where("event_type in ('view', 'purchase')").withColumn("opens", (F.col("event_type") == "view").cast("bigint"))
    return first_feedback(e.withColumn("opened", F.lit(0).cast("bigint")), "user_id", 1_800_000, 1)


@query(using("case_results", "fragments") + "SELECT case_id, mode, rank, coalesce(f.reasoning_chain_id, r.fragment_id) AS logical_id FROM case_results r LEFT JOIN fragments f ON f.id = r.fragment_id")
def j18_id_remap(spark: SparkSession, d: str) -> DataFrame:
    m = v.fragments(spark, d).select(F.col("id").alias("fragment_id"), "reasoning_chain_id")
    return v.case_results(spark, d).join(m, "fragment_id", "left").select("case_id", "mode", "rank", F.coalesce("reasoning_chain_id", "fragment_id").alias("logical_id"))


_SPLIT = "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 < 6 THEN 'dev' WHEN p_partkey % 10 < 9 THEN 'validation' ELSE 'reserve' END AS split FROM part"


@query(f"SELECT a.split AS a, b.split AS b, count(*) FILTER (a.id = b.id) AS shared FROM (SELECT split, id FROM ({_SPLIT})) a JOIN (SELECT split, id FROM ({_SPLIT})) b ON a.split < b.split GROUP BY 1, 2")
def j19_split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 10
    s = v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(k < 6, "dev").when(k < 9, "validation").otherwise("reserve").alias("split"))
    per = s.groupBy("id").agg(F.collect_set("split").alias("splits"))
    pairs = spark.createDataFrame([("dev", "reserve"), ("dev", "validation"), ("reserve", "validation")], "a string, b string")
    both = per.where(F.size("splits") > 1).join(F.broadcast(pairs), F.array_contains("splits", F.col("a")) & F.array_contains("splits", F.col("b")))
    return pairs.join(both.groupBy("a", "b").agg(F.count("*").alias("shared")), ["a", "b"], "left").na.fill(0, ["shared"])


_W1 = """SELECT candidate_id, row_number() OVER (PARTITION BY recall_id ORDER BY a DESC, candidate_id) AS active, row_number() OVER (PARTITION BY recall_id ORDER BY s DESC, candidate_id) AS shadow,
  row_number() OVER (PARTITION BY recall_id ORDER BY semantic DESC, candidate_id) AS baseline FROM (
  SELECT *, round(0.3::DOUBLE * recency + 0.5::DOUBLE * semantic + 0.2::DOUBLE * importance - penalty + novelty, 9) AS a, round(0.1::DOUBLE * recency + 0.3::DOUBLE * semantic + 0.6::DOUBLE * importance - penalty + novelty, 9) AS s FROM scored_pool)"""


def _total(a: float = scalar.ALPHA, b: float = scalar.BETA, g: float = scalar.GAMMA) -> F.Column:
    return F.round(scalar.memory_score(F.col("recency"), F.col("semantic"), F.col("importance"), F.col("penalty"), F.col("novelty"), a, b, g), 9)


@query(using("scored_pool") + _W1)
def w1_profile_rank(spark: SparkSession, d: str) -> DataFrame:
    p = v.scored_pool(spark, d)
    for name, weights in {"active": (0.3, 0.5, 0.2), "shadow": (0.1, 0.3, 0.6)}.items():
        p = recall.ranked(p, "recall_id", _total(*weights), "candidate_id", name)
    return recall.ranked(p, "recall_id", F.col("semantic"), "candidate_id", "baseline").select("candidate_id", "active", "shadow", "baseline")


@query(using("scored_pool") + "SELECT candidate_id, round(penalty, 6)::DOUBLE AS penalty, round(novelty, 6)::DOUBLE AS novelty FROM scored_pool")
def j4_pool_redundancy(spark: SparkSession, d: str) -> DataFrame:
    """Redundancy of each candidate among the pool of its recall."""
    return v.scored_pool(spark, d).select("candidate_id", F.round("penalty", 6).alias("penalty"), F.round("novelty", 6).alias("novelty"))


@query(using("pool") + "SELECT candidate_id, row_number() OVER (PARTITION BY recall_id ORDER BY round(greatest(0, semantic) + greatest(0, coalesce(keyword, 0)), 9) DESC, candidate_id) AS rank FROM pool")
def w2_baseline_fusion(spark: SparkSession, d: str) -> DataFrame:
    s = F.greatest(F.lit(0.0), "semantic") + F.greatest(F.lit(0.0), F.coalesce("keyword", F.lit(0.0)))
    return recall.ranked(v.pool(spark, d), "recall_id", F.round(s, 9), "candidate_id").select("candidate_id", "rank")


_PROFILE = "CASE recall_id % 5 WHEN 0 THEN 'temporal-reasoning' WHEN 1 THEN 'multi-session' WHEN 2 THEN 'knowledge-update' WHEN 3 THEN 'abstention' ELSE 'default' END"
_NORM = "CASE WHEN {0} <= 0 THEN 0 WHEN {1} <= 0 THEN {0} ELSE least(1.0, {0} / {1}) END"
_FUSED = f"""(SELECT *, round(CASE p WHEN 'temporal-reasoning' THEN 0.92::DOUBLE WHEN 'multi-session' THEN 0.8::DOUBLE WHEN 'knowledge-update' THEN 0.75::DOUBLE WHEN 'abstention' THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END * {_NORM.format('semantic', 'ms')}
  + CASE p WHEN 'temporal-reasoning' THEN 0.03::DOUBLE WHEN 'multi-session' THEN 0.1::DOUBLE WHEN 'default' THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END * {_NORM.format('kw', 'mk')}
  + CASE p WHEN 'temporal-reasoning' THEN 0.05::DOUBLE WHEN 'knowledge-update' THEN 0.2::DOUBLE WHEN 'default' THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END * least(1, greatest(0, importance)), 9) AS fused FROM (
  SELECT *, {_PROFILE} AS p, coalesce(keyword, 0) AS kw, max(semantic) OVER (PARTITION BY recall_id) AS ms, max(coalesce(keyword, 0)) OVER (PARTITION BY recall_id) AS mk FROM pool))"""


def _profile() -> F.Column:
    names = ["temporal-reasoning", "multi-session", "knowledge-update", "abstention"]
    out = F.lit("default")
    for i, n in enumerate(names):
        out = F.when(F.col("recall_id") % 5 == i, n).otherwise(out)
    return out


@query(using("pool") + f"SELECT candidate_id, fused, row_number() OVER (PARTITION BY recall_id ORDER BY fused DESC, candidate_id) AS rank FROM {_FUSED}")
def w3_linear_rerank(spark: SparkSession, d: str) -> DataFrame:
    f = recall.fused(v.pool(spark, d), "recall_id", _profile()).withColumn("fused", F.round("fused", 9))
    return recall.ranked(f, "recall_id", F.col("fused"), "candidate_id").select("candidate_id", "fused", "rank")


@query(using("fragments") + """SELECT id, CASE WHEN list_bool_or(list_transform(t, x -> x = 'temporal-reasoning' OR ends_with(x, '-temporal-reasoning'))) THEN 'temporal-reasoning'
  WHEN list_bool_or(list_transform(t, x -> x = 'multi-session' OR ends_with(x, '-multi-session'))) THEN 'multi-session' ELSE 'default' END AS profile
  FROM (SELECT id, list_transform(raw_tags, x -> CASE WHEN starts_with(x, 'task:') THEN 'category-temporal-reasoning' WHEN starts_with(x, 'kind:') THEN 'multi-session' ELSE x END) AS t FROM fragments)""".replace("x -> ", "lambda x: "))
def w4_tag_profile(spark: SparkSession, d: str) -> DataFrame:
    renamed = F.transform("tags", lambda t: F.when(t.startswith("task:"), "category-temporal-reasoning").when(t.startswith("kind:"), "multi-session").otherwise(t))
    return v.fragments(spark, d).select("id", recall.tag_profile(renamed).alias("profile"))


@query(using("pool") + f"""SELECT recall_id, count(*) FILTER (a <> b) AS changed, count(*) FILTER ((a <= 5) <> (b <= 5)) AS topk_difference, count(DISTINCT fused) AS distinct_scores,
  CASE WHEN count(*) FILTER (a <> b) > 0 THEN 'ORDER_CHANGED' WHEN count(DISTINCT fused) > 1 THEN 'IDENTIFIABLE' ELSE 'NON_IDENTIFIABLE' END AS status FROM (
  SELECT recall_id, fused, row_number() OVER (PARTITION BY recall_id ORDER BY fused DESC, candidate_id) AS a, row_number() OVER (PARTITION BY recall_id ORDER BY semantic DESC, candidate_id) AS b FROM {_FUSED}) GROUP BY 1""")
def w5_rerank_effect(spark: SparkSession, d: str) -> DataFrame:
    f = recall.fused(v.pool(spark, d), "recall_id", _profile()).withColumn("fused", F.round("fused", 9))
    f = recall.ranked(recall.ranked(f, "recall_id", F.col("fused"), "candidate_id", "a"), "recall_id", F.col("semantic"), "candidate_id", "b")
    g = f.groupBy("recall_id").agg(F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("changed"), F.sum(((F.col("a") <= 5) != (F.col("b") <= 5)).cast("bigint")).alias("topk_difference"), F.countDistinct("fused").alias("distinct_scores"))
    return g.withColumn("status", recall.rerank_effect(F.col("changed"), F.col("distinct_scores")))


_BUDGET = """, ranked AS (SELECT recall_id, fragment_id, token_count, row_number() OVER (PARTITION BY recall_id ORDER BY round(0.3::DOUBLE * recency + 0.5::DOUBLE * semantic + 0.2::DOUBLE * importance - penalty + novelty, 9) DESC, candidate_id) AS r FROM scored_pool),
fold AS (
  SELECT recall_id, r, fragment_id, (token_count <= 256) AS taken, CASE WHEN token_count <= 256 THEN token_count ELSE 0 END AS used, CASE WHEN token_count <= 256 THEN 1 ELSE 0 END AS n FROM ranked WHERE r = 1
  UNION ALL
  SELECT f.recall_id, x.r, x.fragment_id, f.n < 5 AND f.used + x.token_count <= 256, CASE WHEN f.n < 5 AND f.used + x.token_count <= 256 THEN f.used + x.token_count ELSE f.used END, CASE WHEN f.n < 5 AND f.used + x.token_count <= 256 THEN f.n + 1 ELSE f.n END
  FROM fold f JOIN ranked x ON x.recall_id = f.recall_id AND x.r = f.r + 1)
SELECT recall_id, fragment_id, CAST(n AS BIGINT) AS place, CAST(used AS BIGINT) AS used FROM fold WHERE taken"""


@query(using("scored_pool").rstrip() + _BUDGET)
def t1_token_budget_recall(spark: SparkSession, d: str) -> DataFrame:
    p = recall.ranked(v.scored_pool(spark, d), "recall_id", _total(), "candidate_id")
    return recall.within_budget(p, "recall_id", "rank", "fragment_id", "token_count", k=5, budget=256)


@query(using("candidates") + """SELECT recall_id, fragment_id, min(CASE tier WHEN 'L1' THEN 0 WHEN 'L2' THEN 1 ELSE 2 END) AS source, count(*) AS offered FROM candidates GROUP BY 1, 2""")
def u1_union_distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    c = v.candidates(spark, d)
    return recall.first_source([c.where(F.col("tier") == t) for t in ("L1", "L2", "L3")], ["recall_id", "fragment_id"])


@query(using("case_results") + """SELECT case_id, count(*) AS difference FROM (SELECT case_id, fragment_id FROM case_results WHERE mode IN ('VECTOR_ONLY', 'HYBRID') AND rank <= 5 GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1""")
def u2_topk_symdiff(spark: SparkSession, d: str) -> DataFrame:
    top = v.case_results(spark, d).where("mode in ('VECTOR_ONLY', 'HYBRID') and rank <= 5").groupBy("case_id", "fragment_id").count().where("count = 1")
    return top.groupBy("case_id").agg(F.count("*").alias("difference"))


@query("(SELECT p_name FROM part WHERE p_size < 25 INTERSECT SELECT p_name FROM part WHERE p_size >= 25) EXCEPT SELECT p_name FROM part WHERE p_brand = 'Brand#1'")
def u3_set_assertions(spark: SparkSession, d: str) -> DataFrame:
    p = v.table(spark, d, "part")
    return p.where("p_size < 25").select("p_name").intersect(p.where("p_size >= 25").select("p_name")).subtract(p.where("p_brand = 'Brand#1'").select("p_name"))


@query(using("fragments") + "SELECT id, array_to_string(list_filter(l, lambda t, i: list_position(l, t) = i), '|') AS tags FROM (SELECT id, list_concat(['memory', tier], raw_tags) AS l FROM fragments)")
def u4_tag_merge(spark: SparkSession, d: str) -> DataFrame:
    return v.fragments(spark, d).select("id", F.concat_ws("|", F.array_distinct(F.concat(F.array(F.lit("memory"), F.col("tier")), "tags"))).alias("tags"))


@query(using("case_results", "pool") + """SELECT case_id, mode, count(*) FILTER (r.fragment_id IS NULL) = 0 AS all_expected FROM (SELECT recall_id AS case_id, fragment_id, mode FROM pool, (SELECT DISTINCT mode FROM case_results) WHERE relevant) w
  LEFT JOIN case_results r USING (case_id, fragment_id, mode) GROUP BY 1, 2""")
def u5_subset_test(spark: SparkSession, d: str) -> DataFrame:
    want = v.pool(spark, d).where("relevant").groupBy(F.col("recall_id").alias("case_id")).agg(F.collect_set("fragment_id").alias("expected"))
    each = want.select("case_id", "expected", F.explode(F.array(*map(F.lit, v.MODES))).alias("mode"))
    got = v.case_results(spark, d).groupBy("case_id", "mode").agg(F.collect_list("fragment_id").alias("returned"))
    out = each.join(got, ["case_id", "mode"], "left")
    return out.select("case_id", "mode", (F.size(F.array_except("expected", F.coalesce("returned", F.array().cast("array<string>")))) == 0).alias("all_expected"))


@query(using("wal") + "SELECT task_id, count(DISTINCT key) AS dirty FROM (SELECT task_id, concat('ctx:', k) AS key FROM wal WHERE operation = 'UPDATE_CONTEXT' UNION SELECT task_id, concat('tool:', k) FROM wal WHERE operation LIKE '%TOOL%') GROUP BY 1")
def u6_dirty_union(spark: SparkSession, d: str) -> DataFrame:
    w = v.wal(spark, d)
    ctx = w.where("operation = 'UPDATE_CONTEXT'").select("task_id", F.concat(F.lit("ctx:"), "k").alias("key"))
    tools = w.where("operation like '%TOOL%'").select("task_id", F.concat(F.lit("tool:"), "k").alias("key"))
    return ctx.union(tools).distinct().groupBy("task_id").agg(F.count("*").alias("dirty"))


@query(using("case_modes") + "SELECT DISTINCT case_id, mode, CASE WHEN n_returned > 0 THEN NULL WHEN mode = 'KEYWORD_ONLY' THEN 'NO_KEYWORD_MATCH' ELSE 'NO_VECTOR_MATCH' END AS reason, n_returned FROM case_modes")
def h5_empty_reason(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0)
    m = v.case_modes(spark, d)
    n = F.col("n_returned")
    why = F.when(n == 0, recall.empty_reason(F.col("mode"), zero, zero, zero, zero, zero))
    return m.select("case_id", "mode", why.alias("reason"), "n_returned")


_TOKENS = r"list_filter(list_distinct(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{Nd}}_:-]+')), lambda t: length(t) >= 2)"
_DOCS = f", docs AS (SELECT id, namespace, list_distinct(list_concat({_TOKENS.format('content')}, flatten(list_transform(raw_tags, lambda g: {_TOKENS.format('g')})))) AS tokens FROM fragments)"


@query(using("fragments").rstrip() + _DOCS + " SELECT id, len(tokens) AS n_tokens, array_to_string(list_sort(tokens), ' ') AS tokens FROM docs")
def f_tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = recall.document_tokens(F.col("content"), F.col("tags"))
    return v.fragments(spark, d).select("id", F.size(t).cast("bigint").alias("n_tokens"), F.concat_ws(" ", F.array_sort(t)).alias("tokens"))


@query(using("fragments").rstrip() + _DOCS + " SELECT namespace, term, count(*) AS df FROM (SELECT namespace, unnest(tokens) AS term FROM docs) GROUP BY 1, 2")
def a4_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    t = v.fragments(spark, d).select("namespace", F.explode(recall.document_tokens(F.col("content"), F.col("tags"))).alias("term"))
    return t.groupBy("namespace", "term").agg(F.count("*").alias("df"))


_KW = _DOCS + """, q AS (SELECT d.namespace, d.id AS query_id, d.tokens FROM docs d JOIN (SELECT namespace, min(id) AS id FROM docs GROUP BY 1) USING (namespace, id)),
terms AS (SELECT id, namespace, unnest(tokens) AS term FROM docs), n AS (SELECT namespace, count(*) AS n FROM docs GROUP BY 1), df AS (SELECT namespace, term, count(*) AS df FROM terms GROUP BY 1, 2)
SELECT query_id, id, round(sum(ln(1 + n / df)) + count(*) / any_value(nq), 6) AS score, count(*) AS matched FROM (SELECT namespace, query_id, len(tokens) AS nq, unnest(tokens) AS term FROM q) JOIN terms USING (namespace, term) JOIN df USING (namespace, term) JOIN n USING (namespace) GROUP BY 1, 2"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return written(v.fragments(spark, d).select("id", "namespace", recall.document_tokens(F.col("content"), F.col("tags")).alias("tokens")), "keyword-documents")


@query(using("fragments").rstrip() + _KW)
def f_keyword_search(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    first = docs.groupBy("namespace").agg(F.min("id").alias("id"))
    q = docs.join(first, ["namespace", "id"]).withColumnRenamed("id", "query_id")
    return recall.keyword_scores(docs, q).select("query_id", "id", F.round("score", 6).alias("score"), "matched")


@query(using("fragments").rstrip() + _DOCS + ", q AS (SELECT namespace, min(id) AS query_id FROM docs GROUP BY 1) SELECT query_id, count(DISTINCT id) AS hits FROM (SELECT q.query_id, d.namespace, unnest(d.tokens) AS term FROM q JOIN docs d ON d.id = q.query_id) JOIN (SELECT id, namespace, unnest(tokens) AS term FROM docs) USING (namespace, term) GROUP BY 1")
def j6_term_posting_join(spark: SparkSession, d: str) -> DataFrame:
    return f_keyword_search(spark, d).groupBy("query_id").agg(F.countDistinct("id").alias("hits"))


_ASKED = f"SELECT namespace, id AS query_id, tokens FROM docs WHERE {ASKS.format('id')}"
_KW_EACH = _DOCS + f""", q AS ({_ASKED}), terms AS (SELECT id, namespace, unnest(tokens) AS term FROM docs), n AS (SELECT namespace, count(*) AS n FROM docs GROUP BY 1), df AS (SELECT namespace, term, count(*) AS df FROM terms GROUP BY 1, 2)
SELECT query_id, id, round(sum(ln(1 + n / df)) + count(*) / any_value(nq), 6) AS score, count(*) AS matched FROM (SELECT namespace, query_id, len(tokens) AS nq, unnest(tokens) AS term FROM q) JOIN terms USING (namespace, term) JOIN df USING (namespace, term) JOIN n USING (namespace) GROUP BY 1, 2"""


@query(using("fragments").rstrip() + _KW_EACH)
def f_keyword_search_each(spark: SparkSession, d: str) -> DataFrame:
    """The search of ``f_keyword_search`` for one id in twenty of every namespace."""
    docs = _documents(spark, d)
    q = docs.where(v.asks(F.col("id"))).withColumnRenamed("id", "query_id")
    return recall.keyword_scores(docs, q).select("query_id", "id", F.round("score", 6).alias("score"), "matched")


@query(using("fragments").rstrip() + _DOCS + f", q AS ({_ASKED}) SELECT query_id, count(DISTINCT id) AS hits FROM (SELECT query_id, namespace, unnest(tokens) AS term FROM q) JOIN (SELECT id, namespace, unnest(tokens) AS term FROM docs) USING (namespace, term) GROUP BY 1")
def j6_term_posting_join_each(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return recall.keyword_hits(docs, docs.where(v.asks(F.col("id"))).withColumnRenamed("id", "query_id"))
