"""Reading of fragments, logs, checkpoints and case sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.stores import log_lines
from tidemark.storage import written

FRAGMENT = "id string, namespace string, content string, embedding array<float>, l2_embedding array<float>, token_count int, importance double, last_access_ms bigint, created_at timestamp, tags array<string>, reasoning_chain_id string, pinned_until_ms bigint"
ENTRY = "sequenceNumber bigint, entryId string, operation string, payload string, timestamp timestamp"
CHECKPOINT = "checkpointId string, taskId string, sequenceNumber bigint, type string, baseCheckpointId string, nodeCount int, edgeCount int, sizeBytes bigint, branchId string, createdAt timestamp"
CASE = (
    "caseId string, namespace string, memoryFragments array<struct<fragmentId:string,content:string,tags:array<string>,reasoningChainId:string,pinTtlMillis:bigint>>, question string, expectedAnswer string, "
    "mustContain array<string>, mustNotContain array<string>, expectedFragments array<string>, failureCategories array<string>, tags array<string>, difficulty string"
)
DEAD_LETTER = "idempotencyKey string, reason string, attemptCount int, l2Persisted boolean, l3Archived boolean, lastFailure string"


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """Archived fragments, one JSON object a line."""
    return spark.read.schema(FRAGMENT).json(path)


def by_key(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    """JSON objects of the files whose path matches; adds ``object_key``."""
    return spark.read.schema(schema).json(path).withColumn("object_key", F.col("_metadata.file_path")).where(F.col("object_key").rlike(pattern))


def action_log(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """Log entries of a folder of ``<task>.jsonl`` files from a sequence on.

    A broken last line of a file is skipped, a broken earlier one is an error.
    """
    # files split into blocks; a line's place is that of its block and its number in it
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = written(spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.jsonl?$", 1).alias("task_id"), place.alias("line_no"), F.col("value").alias("line")), "log-lines")
    e = log_lines(lines, ENTRY)
    return e.select("task_id", F.col("sequenceNumber").alias("seq"), F.col("entryId").alias("entry_id"), "operation", F.from_json("payload", "map<string,string>").alias("payload"), F.col("timestamp").alias("ts")).where(F.col("seq") >= since)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character of the file."""
    head = spark.read.text(path).limit(1).collect()
    array = bool(head) and head[0][0].lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", array).json(path)


def case_set(spark: SparkSession, path: str) -> DataFrame:
    return records(spark, path, CASE)


def checkpoint_metadata(spark: SparkSession, path: str, payload_keys: DataFrame | None = None) -> DataFrame:
    """Metadata rows, with a bare row for each payload (``task_id, checkpoint_id``) that has none; oldest first, unknown times last."""
    meta = spark.read.schema(CHECKPOINT).json(path).select(F.col("taskId").alias("task_id"), F.col("checkpointId").alias("checkpoint_id"), F.col("sequenceNumber").alias("seq"), F.col("type").alias("kind"), F.col("baseCheckpointId").alias("base_id"), F.col("createdAt").alias("created_at"))
    if payload_keys is not None:
        bare = payload_keys.join(meta, ["task_id", "checkpoint_id"], "left_anti")
        meta = meta.unionByName(bare, allowMissingColumns=True)
    return meta.orderBy(F.col("created_at").asc_nulls_last(), "checkpoint_id")


def first_of(*names: str) -> Column:
    """First non-blank of several alias columns, as a string."""
    return F.coalesce(*(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names))
