"""Queries over the problem tables; each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, neardup, neighbours, packing, pieces, topn, truncation


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_fragments(_t(spark, d, "recall_candidates")).select("namespace", "fragment_id")


def p1_top_fragments(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_fragments(_t(spark, d, "recall_candidates")).withColumn("rank", F.col("rank").cast("bigint"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.similar_pairs(_t(spark, d, "memory_fragments"))
    return pairs.select(F.col("id_a").alias("fragment_a"), F.col("id_b").alias("fragment_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(_t(spark, d, "memory_fragments")).withColumnRenamed("id", "fragment_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    store = pieces.pieces(_t(spark, d, "store_requests"), "request_id", "content", "store_request")
    return store.unionByName(pieces.pieces(_t(spark, d, "memory_fragments"), "fragment_id", "content", "fragment"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # the first of several pieces stands for its record
    return p3_pieces(spark, d).where("n_pieces > 1 and piece = 1").select("record_kind", "record_id")


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_vectors(_t(spark, d, "warm_vectors")).withColumn("rank", F.col("rank").cast("bigint"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neighbours.neighbour_pairs(neighbours.nearest_vectors(_t(spark, d, "warm_vectors"), with_rank=False))
    return pairs.select(F.col("id_a").alias("fragment_a"), F.col("id_b").alias("fragment_b"))


def p5_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_t(spark, d, "documents"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_report(p5_containers(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    # a text that fills a container and goes on has a second piece
    return p5_containers(spark, d).where("piece = 2").select("doc_id")


def p6_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_report(spark, d).where("short").select("source")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_t(spark, d, "documents")).select("doc_id")


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(_t(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_top_fragments, p2_found, p2_groups, p3_found, p3_pieces, p4_found, p4_neighbours, p5_found, p5_containers, p5_report, p6_found, p6_mix, p6_report, p7_found, p7_rates)
}
