"""Ingest of stored texts in stages, with the status of every request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.names import clean_name

#: Stages in order. A request that a stage refuses is FAILED there and goes no further.
STAGES = ["accept", "validate", "extract", "summarize", "split", "embed", "key", "hot", "warm"]


def staged(requests: DataFrame, limit: int = 512, embed: Column | None = None) -> DataFrame:
    """One row per request with its ``pieces`` (place, content, key, embedding), ``status``, ``stage`` and ``reason``.

    ``requests`` has ``request_id, namespace, content``; repeated requests are
    one. ``embed`` makes a vector of the column ``piece``; a null vector fails the
    request. COMPLETED requests have gone through the last stage.
    """
    r = requests.select("request_id", clean_name(F.col("namespace")).alias("namespace"), F.col("content")).where("request_id is not null").dropDuplicates(["request_id"])
    whole = text.strip(F.coalesce("content", F.lit("")))
    bad = F.when(F.col("namespace").isNull(), "no namespace").when(whole == "", "no content")
    r = r.withColumn("reason", bad).withColumn("units", text.units(F.col("content"))).withColumn("summary", text.summary(F.col("content")))
    r = r.withColumn("parts", F.when(F.col("reason").isNull(), text.split_text(F.col("content"), limit)))
    each = r.select("request_id", F.posexplode("parts").alias("place", "piece"))
    vector = F.lit(None).cast("array<float>") if embed is None else embed
    key = F.concat_ws(":", "request_id", F.sha2("piece", 256))
    each = each.withColumn("embedding", vector).withColumn("key", key)
    made = each.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("place", F.col("piece").alias("content"), "key", "embedding"))).alias("pieces"))
    out = r.join(made, "request_id", "left")
    lost = F.exists("pieces", lambda p: p["embedding"].isNull()) if embed is not None else F.lit(False)
    out = out.withColumn("lost", F.coalesce(lost, F.lit(False)))
    stage = F.when(F.col("reason").isNotNull(), "validate").when(F.size(F.coalesce("parts", F.array().cast("array<string>"))) == 0, "split").when(F.col("lost"), "embed").otherwise(STAGES[-1])
    status = F.when((stage == STAGES[-1]), "COMPLETED").otherwise("FAILED")
    reason = F.coalesce("reason", F.when(stage == "split", "no pieces").when(F.col("lost"), "no vector"))
    return out.select("request_id", "namespace", "summary", F.size("units").alias("n_units"), "pieces", status.alias("status"), stage.alias("stage"), reason.alias("reason"))


def fragments(done: DataFrame) -> DataFrame:
    """``key, request_id, namespace, place, content, embedding`` of the completed requests, each key once."""
    p = done.where("status = 'COMPLETED'").select("request_id", "namespace", F.explode("pieces").alias("p"))
    return p.select("p.key", "request_id", "namespace", "p.place", "p.content", "p.embedding").dropDuplicates(["key"])
