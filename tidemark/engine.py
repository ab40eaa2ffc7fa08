"""One object over a fragment table: store, recall, evict, replay, evaluate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar, text
from tidemark.functions.names import clean_name
from tidemark.operators import evaluate, eviction, graph, log, ordering, recall, stores

VECTOR_ONLY, KEYWORD_ONLY, HYBRID = "VECTOR_ONLY", "KEYWORD_ONLY", "HYBRID"


def search_limit(k: int) -> int:
    return max(16, 4 * k)


class Engine:
    """Queries over ``fragments`` (see ``sources.readers.FRAGMENT``), as lazy plans.

    Writes are separate, explicit jobs; no method changes a table in place.
    """

    def __init__(self, spark: SparkSession, fragments: DataFrame, now_ms: int) -> None:
        self.spark, self.fragments, self.now = spark, fragments, F.lit(now_ms)

    def store(self, new: DataFrame, version: str = "last_access_ms") -> Engine:
        """An engine over the fragments with ``new`` merged in."""
        return Engine(self.spark, stores.upsert(self.fragments, new, "id", version), 0)._at(self.now)

    def forget(self, gone: DataFrame) -> Engine:
        return Engine(self.spark, stores.delete(self.fragments, gone, "id"), 0)._at(self.now)

    def _at(self, now: Column) -> Engine:
        self.now = now
        return self

    def split(self, requests: DataFrame, limit: int = 512) -> DataFrame:
        """Fragments of stored texts: paragraphs, or packed sentences of long ones."""
        return requests.select("request_id", "namespace", F.posexplode(text.split_text(F.col("content"), limit)).alias("place", "content"))

    def candidates(self, queries: DataFrame, k: int, mode: str) -> DataFrame:
        """Pool of every query: vector hits and keyword hits, each cut to the search limit before any tag filter."""
        q = queries.withColumn("namespace", clean_name(F.col("namespace")))
        f = self.fragments.withColumn("namespace", clean_name(F.col("namespace")))
        best = Window.partitionBy("query_id")
        pool = None
        if mode != KEYWORD_ONLY:
            asks = q.where("embedding is not null").select(F.col("query_id").alias("id"), "namespace", "embedding")
            hits = recall.vector_search(f.where("embedding is not null"), asks, search_limit(k))
            pool = hits.select("query_id", "id", F.col("score").alias("cosine"))
        if mode != VECTOR_ONLY:
            docs = f.select("id", "namespace", recall.document_tokens(F.col("content"), F.coalesce("tags", F.array().cast("array<string>"))).alias("tokens"))
            words = recall.keyword_scores(docs, q.select("query_id", "namespace", text.keywords(F.col("text")).alias("tokens"))).select("query_id", "id", F.col("score").alias("keyword"))
            words = words.withColumn("_r", F.row_number().over(best.orderBy(F.col("keyword").desc(), "id"))).where(F.col("_r") <= search_limit(k)).drop("_r")
            pool = words if pool is None else pool.join(words, ["query_id", "id"], "full_outer")
        for c in ("cosine", "keyword"):
            pool = pool.withColumn(c, F.coalesce(c, F.lit(0.0))) if c in pool.columns else pool.withColumn(c, F.lit(0.0))
        return pool

    def recall(self, queries: DataFrame, k: int = 5, budget: int = 2048, mode: str = VECTOR_ONLY, rerank: bool = False, tags: list[str] | None = None) -> DataFrame:
        """``query_id, id, place, used`` of the fragments returned for each query.

        ``queries`` has ``query_id, namespace, embedding, text``. Fragments are
        scored by recency, similarity, importance and redundancy within the pool,
        ranked alone or fused with keyword scores, and taken in order within the token budget.
        """
        f = self.fragments.select("id", "content", "importance", "last_access_ms", "tags", "embedding", F.coalesce("token_count", text.word_count(F.col("content"))).alias("token_count"))
        p = self.candidates(queries, k, mode).join(f, "id").where(text.matches_all(F.col("tags"), tags or []))
        p = recall.pool_redundancy(p, "query_id", "id", "embedding")
        semantic = scalar.memory_score(scalar.recency(F.col("last_access_ms"), self.now), F.col("cosine"), F.coalesce("importance", F.lit(0.5)), F.col("penalty"), F.col("novelty"))
        p = p.withColumn("semantic", semantic).withColumn("importance", F.coalesce("importance", F.lit(0.5)))
        if rerank:
            p = recall.fused(p, "query_id", recall.tag_profile(F.coalesce("tags", F.array().cast("array<string>"))))
            score = F.col("fused")
        else:
            score = F.greatest(F.lit(0.0), "semantic") + F.greatest(F.lit(0.0), "keyword")
        return recall.within_budget(recall.ranked(p, "query_id", score, "id"), "query_id", "rank", "id", "token_count", k, budget)

    def eviction_plan(self, target: int) -> DataFrame:
        """Groups of each namespace to release, least dense first, until the target."""
        score = scalar.ALPHA * scalar.recency(F.col("last_access_ms"), self.now) + scalar.GAMMA * F.coalesce("importance", F.lit(0.5))
        pinned = scalar.is_pinned(F.col("pinned_until_ms"), self.now)
        g = eviction.group_totals(self.fragments.where("namespace is not null").withColumn("score", score), scalar.group_key(F.col("reasoning_chain_id"), F.col("id")), pinned).where("loose").drop("loose")
        return ordering.numbered(g, "namespace", ["density", "grp"], "group_tokens", before="released_before").where(F.col("released_before") < target).drop("rank")

    def quota(self, capacity: int) -> DataFrame:
        return eviction.quotas(eviction.usage(self.fragments, "namespace", "token_count"), capacity)

    @staticmethod
    def replay(entries: DataFrame) -> DataFrame:
        return log.replay(entries)

    @staticmethod
    def next_checkpoint(checkpoints: DataFrame) -> DataFrame:
        return log.next_kind(checkpoints)

    @staticmethod
    def recover(checkpoints: DataFrame) -> DataFrame:
        return log.base_chains(checkpoints)

    @staticmethod
    def order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return graph.levels(nodes, edges)

    @staticmethod
    def evaluate(cases: DataFrame, k: int = 5) -> DataFrame:
        return evaluate.mode_summary(evaluate.metrics(cases, k), "mode")

    @staticmethod
    def compare(cases: DataFrame, left: str, right: str, k: int = 5) -> DataFrame:
        return evaluate.win_tie_loss(evaluate.paired(evaluate.metrics(cases, k), left, right))
