"""Streams run to their end; each equals its batch counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import models
from tidemark.operators import ingest, log
from tidemark.operators.stores import retries
from tidemark.plans import q_tasks
from tidemark.plans import views as v
from tidemark.plans.q_text import _PARTS
from tidemark.plans.registry import ORACLE, query
from tidemark.plans.sqlviews import using
from tidemark.streaming import operators as ops
from tidemark.streaming.runner import finished, sliced


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return v.events(spark, d).withColumn("ts", F.timestamp_millis("ts_ms"))


@query(using("ev") + "SELECT e.event_id AS evict_id, c.event_id AS recall_id FROM ev e JOIN ev c ON c.user_id = e.user_id AND c.ts_ms BETWEEN e.ts_ms AND e.ts_ms + 3600000 WHERE e.event_type = 'error' AND c.event_type = 'click'")
def x1_regret_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _timed(spark, d)
    ev = sliced(e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("evict_id"), F.col("ts").alias("evict_ts")), "evict_ts")
    rc = sliced(e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("recall_id"), F.col("ts").alias("recall_ts")), "recall_ts")
    return finished(ops.regrets(ev, rc, "user_id").select("evict_id", "recall_id"))


_ONCE = """, r AS (SELECT user_id, event_id, ts_ms, event_type = 'view' AS opens, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS i FROM ev WHERE event_type IN ('view', 'purchase')),
f AS (SELECT user_id, i, CASE WHEN opens THEN [{'t': ts_ms, 'n': event_id}] ELSE [] END AS live, NULL::BIGINT AS session_id, NULL::BIGINT AS feedback_id FROM r WHERE i = 1
  UNION ALL SELECT user_id, i, CASE WHEN opens THEN list_append(alive, {'t': ts_ms, 'n': event_id}) ELSE list_slice(alive, 2, len(alive)) END, CASE WHEN NOT opens AND len(alive) > 0 THEN alive[1].n END, CASE WHEN NOT opens AND len(alive) > 0 THEN event_id END
  FROM (SELECT r.*, list_filter(f.live, lambda x: r.ts_ms - x.t <= 1800000) AS alive FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1))
SELECT CAST(user_id AS VARCHAR) AS key, session_id, feedback_id FROM f WHERE session_id IS NOT NULL"""


@query(using("ev").rstrip() + _ONCE)
def x2_session_stream(spark: SparkSession, d: str) -> DataFrame:
    e = v.events(spark, d).where("event_type in ('view', 'purchase')")
    kind = F.when(F.col("event_type") == "view", "open").otherwise("use")
    s = sliced(e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("n"), "ts_ms", F.timestamp_millis("ts_ms").alias("ts"), kind.alias("kind")), "ts_ms")
    return finished(ops.consumed_once(s))


@query(ORACLE["l16_execution_id"])
def x3_execution_id_stream(spark: SparkSession, d: str) -> DataFrame:
    return finished(ops.executions(sliced(q_tasks._requests(spark, d).withColumn("ts", F.timestamp_millis("ts_ms")), "ts_ms")))


@query(ORACLE["l1_replay_full"])
def x4_wal_replay_stream(spark: SparkSession, d: str) -> DataFrame:
    return finished(ops.replay(sliced(q_tasks._payload(spark, d), "seq")), "update", ["task_id"]).select(*q_tasks._STATE)


@query(ORACLE["a27_rolling_p95"])
def x5_rolling_stream(spark: SparkSession, d: str) -> DataFrame:
    s = sliced(v.events(spark, d).select("event_type", F.col("event_id").alias("n"), "ts_ms", "value"), "ts_ms")
    return finished(ops.rolling(s, "event_type"), "update", ["event_type"])


@query(ORACLE["v4_consumption"])
def x6_prefetch_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _timed(spark, d)
    load = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("load_id"), F.col("ts").alias("evict_ts"))
    use = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("recall_ts"))
    hits = finished(ops.regrets(sliced(load, "evict_ts"), sliced(use, "recall_ts"), "user_id", "2 minutes").select("load_id"))
    return load.select("load_id").join(hits.distinct().withColumn("outcome", F.lit("consumed")), "load_id", "left").na.fill("missed", ["outcome"])


@query(ORACLE["l15_checkpoint_trigger"])
def x7_checkpoint_trigger_stream(spark: SparkSession, d: str) -> DataFrame:
    w = log.first_of_each_entry(v.wal(spark, d)).select("task_id", "seq", "ts_ms")
    return finished(ops.triggers(sliced(w, "seq")))


_PIPE = _PARTS + " AS parts, trim(coalesce(namespace, ''), ' ') = '' AS lost FROM store_requests WHERE request_id IS NOT NULL"
_STATUS = f"""SELECT request_id, any_value(CASE WHEN lost THEN 'FAILED' WHEN len(coalesce(parts, [])) = 0 THEN 'FAILED' ELSE 'COMPLETED' END) AS status, any_value(CASE WHEN lost OR len(coalesce(parts, [])) = 0 THEN 'validate' ELSE 'warm' END) AS stage,
  any_value(CASE WHEN lost THEN 'no namespace' WHEN len(coalesce(parts, [])) = 0 THEN 'no content' END) AS reason, any_value(CASE WHEN lost THEN 0 ELSE len(coalesce(parts, [])) END)::BIGINT AS pieces FROM (SELECT request_id, {_PIPE}) GROUP BY 1"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "store_requests").select("request_id", "namespace", "content", "received_at")


def _counted(done: DataFrame) -> DataFrame:
    return done.select("request_id", "status", "stage", "reason", F.coalesce(F.size("pieces"), F.lit(0)).cast("bigint").alias("pieces")).withColumn("pieces", F.greatest(F.col("pieces"), F.lit(0)))


@query(_STATUS)
def l17_ingest_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of every request after the ingest stages; paragraphs of any length stay whole."""
    return _counted(ingest.staged(_requests(spark, d), 1_000_000, models.hash_embedder(64)("piece")))


@query(_STATUS)
def x8_ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    """The ingest stages over a stream; a request repeated in a later batch has the same status."""
    s = sliced(_requests(spark, d), "received_at")
    return finished(s, transform=lambda b: _counted(ingest.staged(b, 1_000_000, models.hash_embedder(64)("piece")))).dropDuplicates(["request_id"])


@query(using("ev") + """SELECT event_id, a AS attempt, CASE WHEN (event_id + a + k) % 4 = 0 THEN 'recovered' WHEN a = 5 THEN 'discarded' ELSE 'retried' END AS outcome FROM ev, (SELECT unnest(range(1, 6)) AS a)
  WHERE event_type = 'error' AND a <= coalesce((SELECT min(x) FROM (SELECT unnest(range(1, 6)) AS x) WHERE (event_id + x + k) % 4 = 0), 5)""")
def x9_dead_letter_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every attempt of the entries of a dead-letter stream; failed ones come back until the fifth."""
    s = sliced(v.events(spark, d).where("event_type = 'error'").select("event_id", "k", "ts_ms"), "ts_ms")
    retry = lambda b: retries(b, "event_id", lambda n: (F.col("event_id") + n + F.col("k")) % 4 == 0).select("event_id", "attempt", "outcome")
    return finished(s, transform=retry)


@query(using("fragments") + """, c AS (SELECT namespace, max(last_access_ms) AS clock FROM fragments GROUP BY 1)
SELECT id, CAST((pinned_until_ms + 29999) // 30000 * 30000 AS BIGINT) AS sweep_ms FROM fragments JOIN c USING (namespace) WHERE pinned_until_ms IS NOT NULL AND (pinned_until_ms + 29999) // 30000 * 30000 <= clock AND last_access_ms IS NOT NULL""")
def x10_pin_sweep_stream(spark: SparkSession, d: str) -> DataFrame:
    f = v.fragments(spark, d).where("last_access_ms is not null").select(F.col("namespace").alias("key"), "id", F.col("last_access_ms").alias("ts_ms"), F.col("pinned_until_ms").alias("until_ms"))
    return finished(ops.pin_sweeps(sliced(f, "ts_ms")))


@query(using("ev", "lookahead") + "SELECT event_id, l.task_id, l.page FROM ev JOIN lookahead l ON l.task_id = ev.user_id % 40 AND l.start = ev.k % 50 + 1 WHERE event_type = 'purchase'")
def x11_dag_change_stream(spark: SparkSession, d: str) -> DataFrame:
    """Pages to load at every change of a task's current node."""
    s = sliced(v.events(spark, d).where("event_type = 'purchase'").select("event_id", "ts_ms", (F.col("user_id") % 40).alias("task_id"), (F.col("k") % 50 + 1).cast("bigint").alias("start")), "ts_ms")
    return finished(s.join(q_tasks._lookahead(spark, d), ["task_id", "start"]).select("event_id", "task_id", "page"))


_WINDOW = "SELECT epoch_ms(w) AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM ({0}) GROUP BY 1, 2"


@query(using("ev") + _WINDOW.format("SELECT time_bucket(INTERVAL 1 HOUR, make_timestamp(ts_ms * 1000)) AS w, event_type, value FROM ev"))
def x13_tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    out = finished(ops.windows(sliced(_timed(spark, d), "ts"), "ts", "tumbling"), "complete")
    return out.select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n", "total")


@query(using("ev") + _WINDOW.format("SELECT time_bucket(INTERVAL 30 MINUTE, make_timestamp(ts_ms * 1000)) - i * INTERVAL 30 MINUTE AS w, event_type, value FROM ev, (SELECT unnest([0, 1]) AS i)"))
def x14_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    out = finished(ops.windows(sliced(_timed(spark, d), "ts"), "ts", "sliding"), "complete")
    return out.select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n", "total")


@query(using("ev") + """SELECT min(ts_ms) AS start_ms, user_id, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) >= 1800000 AS gap FROM ev)) GROUP BY user_id, s""")
def x12_session_windows(spark: SparkSession, d: str) -> DataFrame:
    out = finished(ops.windows(sliced(_timed(spark, d), "ts"), "ts", "session"), "complete")
    return out.select(F.unix_millis("w.start").alias("start_ms"), "user_id", "n", "total")
