"""Canonical tables of the engine over the data folder.

Every rule is deterministic, so that the same tables can be stated in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.functions.names import clean_name, finite
from tidemark.functions.text import normalized_tags, word_count
from tidemark.operators import recall

#: The instant that counts as now.
NOW_MS = 1_784_800_000_000
MODES = ["KEYWORD_ONLY", "VECTOR_ONLY", "VECTOR_RERANK", "HYBRID", "HYBRID_RERANK"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def millis(c) -> F.Column:
    return F.unix_millis(c.cast("timestamp"))


def latest(df: DataFrame, key: str, *order) -> DataFrame:
    """Last version of every key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_v", F.row_number().over(w)).where("_v = 1").drop("_v")


def fragments(spark: SparkSession, d: str, vectors: bool = False) -> DataFrame:
    """One row per fragment with a namespace, its latest version."""
    f = table(spark, d, "memory_fragments").select(
        F.col("fragment_id").alias("id"), clean_name(F.col("namespace")).alias("namespace"), F.coalesce("content", F.lit("")).alias("content"),
        F.least(F.lit(1.0), F.coalesce("importance", F.lit(0.5))).alias("importance"), F.col("last_access_time").alias("last_access_ms"), millis(F.col("created_at")).alias("created_ms"),
        normalized_tags(F.col("tags")).alias("tags"), "reasoning_chain_id", F.col("pinned_until").alias("pinned_until_ms"), millis(F.col("ingested_at")).alias("ingested_ms"),
    )
    f = f.where("id is not null and namespace is not null")
    f = latest(f, "id", F.col("last_access_ms").desc_nulls_last(), F.col("ingested_ms").desc_nulls_last(), F.col("pinned_until_ms").desc_nulls_last(), F.col("reasoning_chain_id").desc_nulls_last())
    tier = F.when(F.col("id") < "6", "L1").when(F.col("id") < "d", "L2").otherwise("L3")
    f = f.withColumn("token_count", word_count(F.col("content")).cast("bigint")).withColumn("tier", tier)
    return f.join(embeddings(spark, d), "id", "left") if vectors else f


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """``id, embedding`` of the usable vectors, one row per id."""
    v = table(spark, d, "warm_vectors").where((F.size("embedding") == 128) & F.forall("embedding", lambda x: finite(x)) & F.exists("embedding", lambda x: x != 0))
    return v.select(F.col("fragment_id").alias("id"), "embedding").where("id is not null").dropDuplicates(["id"])


def asks(key) -> F.Column:
    """True for one id in twenty, by its MD5: the rows that searches take as queries."""
    return F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("int") % 20 == 0


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Scored offers of a fragment in a recall, each candidate once.

    ``keyword`` stands in for a keyword score; a quarter has none.
    """
    c = table(spark, d, "recall_candidates").select(
        "candidate_id", "recall_id", clean_name(F.col("namespace")).alias("namespace"), "fragment_id", F.col("score").alias("semantic"), F.coalesce("tier", F.lit("L2")).alias("tier"), millis(F.col("recalled_at")).alias("recalled_ms"))
    c = c.where(F.col("fragment_id").isNotNull() & F.col("namespace").isNotNull() & finite(F.col("semantic"))).dropDuplicates(["candidate_id"])
    keyword = F.when(F.col("candidate_id") % 4 != 0, (F.col("candidate_id") * 37 % 101) / 20.0)
    return c.withColumn("keyword", keyword).withColumn("relevant", F.col("candidate_id") % 5 == 0)


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each recall, a fragment once with its best offer, with importance and tags."""
    c = latest(candidates(spark, d).withColumn("k", F.concat_ws("|", "recall_id", "fragment_id")), "k", F.col("semantic").desc(), "candidate_id").drop("k")
    f = fragments(spark, d).select(F.col("id").alias("fragment_id"), "importance", "tags", "token_count", "last_access_ms")
    return c.join(f, "fragment_id")


def scored_pool(spark: SparkSession, d: str) -> DataFrame:
    """The pool with ``recency``, ``penalty`` and ``novelty`` of each candidate among its recall's."""
    p = pool(spark, d).join(embeddings(spark, d).withColumnRenamed("id", "fragment_id"), "fragment_id", "left")
    p = recall.pool_redundancy(p, "recall_id", "candidate_id", "embedding")
    return p.withColumn("recency", scalar.recency(F.col("last_access_ms"), F.lit(NOW_MS)))


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def wal(spark: SparkSession, d: str, repeats: bool = True) -> DataFrame:
    """Action log of one task per user; every tenth entry is logged twice."""
    e = events(spark, d)
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts_ms", "event_id")).cast("bigint")
    op = (
        F.when(F.col("event_type") == "view", "UPDATE_CONTEXT").when(F.col("event_type") == "click", "START_TOOL_EXECUTION").when(F.col("event_type") == "purchase", "COMPLETE_TOOL_EXECUTION")
        .when(F.col("event_type") == "error", "FAIL_TOOL_EXECUTION").otherwise("SET_STATUS")
    )
    w = e.select(F.concat(F.lit("t"), "user_id").alias("task_id"), seq.alias("seq"), F.col("event_id").cast("string").alias("entry_id"), op.alias("operation"), "k", "value", "ts_ms")
    if repeats:
        w = w.unionByName(w.where(F.col("entry_id").cast("bigint") % 10 == 0))
    return w


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of task graphs of 50 over the part table."""
    p = table(spark, d, "part")
    return p.select(F.floor(F.col("p_partkey") / 50).alias("task_id"), (F.col("p_partkey") % 50 + 1).alias("node"), F.col("p_name").alias("content"), F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("bigint")).alias("executed_at"), (F.col("p_size") % 4).cast("bigint").alias("branch"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """``i`` to ``2i``, ``2i + 1`` and ``i + 3`` within each task graph; the nodes are not broadcast, as they grow."""
    n = nodes(spark, d).select("task_id", "node")
    e = n.select("task_id", F.col("node").alias("src"), F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1, F.col("node") + 3)).alias("dst"))
    return e.where("dst <= 50").distinct().join(n.withColumnRenamed("node", "dst").hint("merge"), ["task_id", "dst"], "left_semi").select("task_id", "src", "dst")


def node_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of task nodes (``task_id, node, page, state, access_count``); every fifth node lies on two."""
    n = nodes(spark, d).select("task_id", "node")
    own = F.floor(F.col("node") / 4)
    p = n.withColumn("page", F.explode(F.when(F.col("node") % 5 == 0, F.array(own, own + 1)).otherwise(F.array(own))))
    turn = (F.col("task_id") * 7 + F.col("page")) % 4
    return p.withColumn("state", F.when(turn == 0, "RESIDENT").when(turn == 1, "FAULTING").otherwise("EVICTED")).withColumn("access_count", (F.col("task_id") * 31 + F.col("page") * 17) % 100)


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoint chain of one task per customer over the orders."""
    o = table(spark, d, "orders")
    w = Window.partitionBy("task_id").orderBy("created_ms", "n")
    c = o.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("n"), millis(F.col("o_orderdate")).alias("created_ms"), F.col("o_totalprice").alias("size"))
    kind = F.when((F.col("n") % 7 == 0) | (F.row_number().over(w) == 1), "FULL").otherwise("DELTA")
    c = c.withColumn("kind", kind).withColumn("before", F.lag("n").over(w))
    return c.select("task_id", F.col("n").alias("checkpoint_id"), "created_ms", "size", "kind", F.when(F.col("kind") == "DELTA", F.col("before")).alias("base_id"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """``page_id, namespace, id, last_access_ms`` of the fragments on semantic pages."""
    f = fragments(spark, d)
    return f.select(F.concat_ws("-", "namespace", F.substring("id", 1, 1)).alias("page_id"), "namespace", "id", "last_access_ms", "token_count", F.when(F.substring("id", 1, 1).isin("0", "1", "2", "3", "4"), "RESIDENT").otherwise("EVICTED").alias("state"))


def _ranked_modes(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of every candidate of a recall under each mode, and the recall's relevant ones; one shuffle by recall serves all."""
    p = pool(spark, d).withColumn("n_expected", F.sum(F.col("relevant").cast("bigint")).over(Window.partitionBy("recall_id")))
    kw, sem = F.coalesce("keyword", F.lit(0.0)), F.col("semantic")
    by = {"KEYWORD_ONLY": kw, "VECTOR_ONLY": sem, "VECTOR_RERANK": 0.8 * sem + 0.2 * F.col("importance"), "HYBRID": sem + kw, "HYBRID_RERANK": 0.6 * sem + 0.1 * kw + 0.3 * F.col("importance")}
    scores = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.round(by[m], 9).alias("score")) for m in MODES))).alias("m")
    r = p.select(F.col("recall_id").alias("case_id"), "fragment_id", "relevant", "n_expected", scores).select("case_id", "fragment_id", "relevant", "n_expected", "m.mode", "m.score")
    w = Window.partitionBy("case_id", "mode").orderBy(F.col("score").desc(), "fragment_id")
    return r.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 10")


def case_results(spark: SparkSession, d: str) -> DataFrame:
    """``case_id, mode, rank, fragment_id, relevant, score`` of the first ten of every recall under each mode."""
    return _ranked_modes(spark, d).drop("n_expected")


def case_modes(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """One row per case and mode: counts for the metrics, latency, category, error flag."""
    r = _ranked_modes(spark, d)
    hit = F.col("relevant") & (F.col("rank") <= k)
    m = r.groupBy("case_id", "mode").agg(
        F.sum(hit.cast("bigint")).alias("matched"), F.min(F.when(hit, F.col("rank"))).alias("first_rank"),
        F.coalesce(F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"), F.count("*").alias("n_returned"), F.max("n_expected").alias("n_expected"))
    mode_no = F.array_position(F.array(*map(F.lit, MODES)), F.col("mode"))
    return m.withColumn("latency_ms", (F.col("case_id") * 37 + mode_no * 113) % 500).withColumn("category", F.concat(F.lit("cat"), F.col("case_id") % 6)).withColumn("failed", F.col("case_id") % 97 == 0)
