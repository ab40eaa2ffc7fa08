"""Text, evaluation text, models and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import judge, models, scalar, text
from tidemark.operators import prompts, recall
from tidemark.plans import views as v
from tidemark.plans.registry import query
from tidemark.plans.sqlviews import NOW, using

_PARTS = r"list_filter(list_transform(string_split_regex(regexp_replace(content, '^\s+|\s+$', '', 'g'), '\n{2,}'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"


@query(f"SELECT request_id, place - 1 AS place, parts[place] AS paragraph FROM (SELECT request_id, parts, unnest(range(1, len(parts) + 1)) AS place FROM (SELECT request_id, {_PARTS} AS parts FROM store_requests WHERE content IS NOT NULL))")
def f_split_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    r = v.table(spark, d, "store_requests").where("content is not null")
    return r.select("request_id", F.posexplode(text.paragraphs(F.col("content"))).alias("place", "paragraph")).withColumn("place", F.col("place").cast("bigint"))


@query()
def f_split_sentences(spark: SparkSession, d: str) -> DataFrame:
    r = v.table(spark, d, "store_requests").where("content is not null")
    return r.select("request_id", F.posexplode(text.split_text(F.col("content"), 64)).alias("place", "piece"))


_UNITS = r"""(SELECT request_id, list_slice(list_filter(flatten(list_transform(string_split_regex(content, '(\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}])+'), lambda x: string_split(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(x, '^\s*[-*\d.)]+\s*', ''), '\s+', ' ', 'g'), '^ | $', '', 'g'), '([。！？.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)))), lambda u: trim(u, ' ') <> ''), 1, 12) AS units FROM store_requests WHERE content IS NOT NULL)"""


@query(f"SELECT request_id, place - 1 AS place, units[place] AS unit FROM (SELECT *, unnest(range(1, len(units) + 1)) AS place FROM {_UNITS})")
def f_extract_units(spark: SparkSession, d: str) -> DataFrame:
    r = v.table(spark, d, "store_requests").where("content is not null")
    return r.select("request_id", F.posexplode(text.units(F.col("content"))).alias("place", "unit")).withColumn("place", F.col("place").cast("bigint"))


@query(f"""SELECT request_id, CASE WHEN length(whole) <= 1200 THEN whole ELSE regexp_replace(CASE WHEN contains(head, ' ') AND 1200 - position(' ' IN reverse(head)) >= 600 THEN substr(head, 1, 1200 - position(' ' IN reverse(head))) ELSE head END, '^\\s+|\\s+$', '', 'g') END AS summary
  FROM (SELECT request_id, whole, substr(whole, 1, 1200) AS head FROM (SELECT request_id, array_to_string(units, chr(10)) AS whole FROM {_UNITS}))""")
def f_summary_truncate(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "store_requests").where("content is not null").select("request_id", text.summary(F.col("content")).alias("summary"))


@query(r"SELECT request_id, len(regexp_extract_all(coalesce(content, ''), '\S+')) AS tokens FROM store_requests")
def f_token_count(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "store_requests").select("request_id", text.word_count(F.col("content")).cast("bigint").alias("tokens"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'recall_miss' WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'P' AND o_orderkey % 4 <> 0 THEN 'insufficient_when_memory_available' ELSE CASE o_orderstatus WHEN 'P' THEN 'insufficient_answer' ELSE 'answer_missing_fact' END END AS failure FROM orders""")
def f_failure_class(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    judged = F.when(s == "F", "correct").when(s == "P", "insufficient_answer").otherwise("answer_missing_fact")
    return v.table(spark, d, "orders").select("o_orderkey", judge.failure(F.col("o_orderkey") % 6 != 0, judged, F.col("o_orderkey") % 4 == 0).alias("failure"))


@query(r"SELECT p_partkey, regexp_replace(lower(concat(p_name, ' / ', p_type)), '[^a-z0-9]+', '-', 'g') AS slug, regexp_replace(concat(p_name, ' ', p_brand), '[^A-Za-z0-9_.-]', '-', 'g') AS safe FROM part")
def f_slug(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"), text.safe_id(F.concat_ws(" ", "p_name", "p_brand")).alias("safe"))


@query("SELECT request_id, sha256(coalesce(content, '')) AS content_hash, sha256(concat(request_id, '|', coalesce(trim(namespace, ' '), ''))) AS request_hash FROM store_requests")
def f_sha(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "store_requests").select("request_id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"), F.sha2(F.concat_ws("|", "request_id", F.coalesce(F.trim("namespace"), F.lit(""))), 256).alias("request_hash"))


@query("""SELECT event_id, concat('{"k":"', k, '","type":"', event_type, '"}') AS payload, CAST(k AS VARCHAR) AS k FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def f_json_payload(spark: SparkSession, d: str) -> DataFrame:
    e = v.events(spark, d).select("event_id", F.to_json(F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("type"), F.col("event_type"))).alias("payload"))
    return e.withColumn("k", F.from_json("payload", "map<string,string>")["k"])


@query("SELECT event_id, CAST(k AS INTEGER) AS arm, user_id / 10000 AS p FROM (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def f_profile_name(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("adaptive-arm"), "k", F.lit("-p"), "user_id")
    e = v.events(spark, d).withColumn("name", name)
    return e.select("event_id", text.profile_number(F.col("name"), "arm").alias("arm"), (text.profile_number(F.col("name"), "p") / 10_000).alias("p"))


@query("SELECT c_custkey, CASE upper(trim(c_mktsegment)) WHEN 'BUILDING' THEN 'BUILDING' WHEN 'MACHINERY' THEN 'MACHINERY' ELSE 'CHAT' END AS scenario FROM customer")
def f_enum(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "customer").select("c_custkey", text.scenario(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("scenario"))


@query(r"""SELECT p_partkey, CASE WHEN length(l) > 12 THEN concat(substr(l, 1, 9), '...') ELSE l END AS label FROM (SELECT p_partkey, regexp_replace(replace(replace(concat(p_name, chr(10), '"', p_brand), '\', '\\'), '"', '\"'), '[\r\n]+', ' ', 'g') AS l FROM part)""")
def f_mask(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "part").select("p_partkey", text.label(F.concat("p_name", F.lit('\n"'), "p_brand"), 12).alias("label"))


@query(using("fragments", "vec") + "SELECT id, pos, round(x / n, 6) AS value FROM (SELECT id, unnest(embedding::DOUBLE[]) AS x, unnest(range(128)) AS pos, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) AS n FROM fragments JOIN vec USING (id) WHERE tier = 'L3')")
def f_norm(spark: SparkSession, d: str) -> DataFrame:
    f = v.fragments(spark, d, vectors=True).where("tier = 'L3' and embedding is not null")
    return f.select("id", F.posexplode(scalar.unit(F.col("embedding"))).alias("pos", "value")).select("id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@query(using("fragments", "vec") + "SELECT id, pos, round(x / n, 6) AS value FROM (SELECT id, unnest(embedding::DOUBLE[]) AS x, unnest(range(128)) AS pos, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) AS n FROM fragments JOIN vec USING (id))")
def f_norm_all(spark: SparkSession, d: str) -> DataFrame:
    """``f_norm`` over the vectors of every tier."""
    f = v.fragments(spark, d, vectors=True).where("embedding is not null")
    return f.select("id", F.posexplode(scalar.unit(F.col("embedding"))).alias("pos", "value")).select("id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@query(using("pages").rstrip() + """, nd AS (SELECT page_id, namespace, max(last_access_ms) AS last_ms, list(DISTINCT concat(namespace, ':', substr(id, 1, 2))) AS nodes FROM pages GROUP BY 1, 2),
now AS (SELECT namespace, CASE WHEN length(namespace) % 3 = 0 THEN 'elsewhere:00' ELSE min(concat(namespace, ':', substr(id, 1, 2))) END AS node FROM pages GROUP BY 1),
dist AS (SELECT page_id, last_ms, CASE WHEN list_contains(nodes, node) THEN 0.0::DOUBLE WHEN length(node) > 8 AND len(list_filter(nodes, lambda n: length(n) > 8 AND substr(n, 1, 8) = substr(node, 1, 8))) > 0 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS dist FROM nd JOIN now USING (namespace))
""" + f"SELECT page_id, round(0.25::DOUBLE / (1 + ln(1 + greatest(0, ({NOW} - last_ms) / 86400000.0::DOUBLE))) + 0.25::DOUBLE * (1 - dist), 6) AS score, dist FROM dist")
def f_page_distance(spark: SparkSession, d: str) -> DataFrame:
    """Pages by distance to the current node of their namespace; without a query, similarity is 0."""
    p = v.pages(spark, d).withColumn("node", F.concat_ws(":", "namespace", F.substring("id", 1, 2)))
    now = p.groupBy("namespace").agg(F.min("node").alias("first")).select("namespace", F.when(F.length("namespace") % 3 == 0, "elsewhere:00").otherwise(F.col("first")).alias("current"))
    g = p.groupBy("page_id", "namespace").agg(F.max("last_access_ms").alias("last_ms"), F.collect_set("node").alias("nodes")).join(now, "namespace")
    g = g.withColumn("dist", scalar.page_distance(F.col("nodes"), F.col("current")))
    rec = scalar.recency(F.col("last_ms"), F.lit(v.NOW_MS))
    return g.select("page_id", F.round(scalar.page_score(rec, F.lit(0.0), F.col("dist")), 6).alias("score"), "dist")


@query()
def f_page_id(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.graph import centroids

    p = v.pages(spark, d).select("id", "page_id").join(v.embeddings(spark, d), "id")
    return centroids(p, "page_id", "embedding").select("page_id", F.sha2(F.to_json(F.transform("values", lambda x: F.round(x, 6))), 256).alias("stable_id"))


@query("""SELECT concat(request_id, '-turn-', printf('%04d', place)) AS turn_id, concat('role-', lower(role)) AS tag, role IN ('A', 'agent', 'worker') AS evidence FROM (
  SELECT request_id, place - 1 AS place, regexp_extract(lines[place], '^([A-Za-z]{1,12})[:：]', 1) AS role FROM (SELECT request_id, lines, unnest(range(1, len(lines) + 1)) AS place FROM (
    SELECT request_id, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^[A-Za-z]{1,12}[:：]')) AS lines FROM (SELECT DISTINCT request_id, content FROM store_requests WHERE content IS NOT NULL))))""")
def f_convert_cases(spark: SparkSession, d: str) -> DataFrame:
    r = v.table(spark, d, "store_requests").where("content is not null").select("request_id", "content").distinct()
    lines = F.filter(F.split("content", "\n"), lambda x: x.rlike(r"^[A-Za-z]{1,12}[:：]"))
    turns = r.select("request_id", F.posexplode(lines).alias("place", "line")).withColumn("role", F.regexp_extract("line", r"^([A-Za-z]{1,12})[:：]", 1))
    return turns.select(F.concat("request_id", F.lit("-turn-"), F.lpad(F.col("place").cast("string"), 4, "0")).alias("turn_id"), F.concat(F.lit("role-"), F.lower("role")).alias("tag"), F.col("role").isin("A", "agent", "worker").alias("evidence"))


@query("SELECT request_id, bool_or(has) AS evidence FROM (SELECT request_id, contains(coalesce(content, ''), 'agent:') OR coalesce(pin_ttl_millis, 0) % 3 = 1 AS has FROM store_requests) GROUP BY 1")
def f_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Records of sessions as nested JSON, flagged at two depths, with a flag quoted inside a text."""
    content = F.coalesce("content", F.lit(""))
    turn = F.struct(F.concat(F.lit('said "has_answer": true, '), content).alias("text"), F.struct(content.contains("agent:").alias("has_answer")).alias("meta"))
    record = F.struct(F.array(F.array(turn)).alias("sessions"), F.when(F.coalesce("pin_ttl_millis", F.lit(0)) % 3 == 1, "True").otherwise("no").alias("isEvidence"))
    r = v.table(spark, d, "store_requests").select("request_id", F.to_json(record).alias("record"))
    return r.groupBy("request_id").agg(F.bool_or(text.has_evidence(F.col("record"))).alias("evidence"))


@query()
def f_judge(spark: SparkSession, d: str) -> DataFrame:
    f = v.fragments(spark, d).where("content <> ''")
    first = F.regexp_extract("content", r"^(\w+(?: \w+){0,2})", 1)
    f = f.select("id", first.alias("expected"), F.array(F.element_at(F.split("content", " "), 1)).alias("must"), F.array(F.lit("dead letter")).alias("must_not"), F.col("content").alias("answer"))
    return f.select("id", judge.judge("expected", "must", "must_not", "answer").alias("verdict"))


@query()
def f_hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return v.fragments(spark, d).select("id", models.hash_embedder(64)("content").alias("embedding"))


_OVERLAP = r""", r AS (SELECT p.recall_id, p.candidate_id, rank, list_distinct(regexp_extract_all(lower(f.content), '[\p{L}\p{N}_]+')) AS words FROM (SELECT *, row_number() OVER (PARTITION BY recall_id ORDER BY semantic DESC, candidate_id) AS rank FROM pool) p
  JOIN fragments f ON f.id = p.fragment_id), q AS (SELECT recall_id, words AS asked FROM r WHERE rank = 1)
SELECT recall_id, candidate_id, rank, row_number() OVER (PARTITION BY recall_id ORDER BY CASE WHEN len(asked) = 0 THEN 0 ELSE len(list_intersect(asked, words)) / len(asked) END DESC, rank) AS reranked FROM r JOIN q USING (recall_id) WHERE rank <= 40"""


@query(using("pool", "fragments").rstrip() + _OVERLAP)
def w6_cross_encoder(spark: SparkSession, d: str) -> DataFrame:
    p = recall.ranked(v.pool(spark, d), "recall_id", F.col("semantic"), "candidate_id")
    c = v.fragments(spark, d).select(F.col("id").alias("fragment_id"), "content")
    p = p.join(c, "fragment_id")
    top = p.where("rank = 1").select("recall_id", F.col("content").alias("question"))
    out = models.rerank(p.join(top, "recall_id"), "recall_id", "rank", "question", "content", models.overlap_scorer)
    return out.select("recall_id", "candidate_id", "rank", F.col("reranked").cast("bigint").alias("reranked"))


# 5 words of the question, 2 of the header and 3 of the task stand in every prompt; a block has 2 more than its content
_PACK = """, b AS (SELECT recall_id, 2 + f.token_count AS n, row_number() OVER (PARTITION BY recall_id ORDER BY rank) AS i FROM (SELECT *, row_number() OVER (PARTITION BY recall_id ORDER BY semantic DESC, candidate_id) AS rank FROM pool) p
  JOIN fragments f ON f.id = p.fragment_id WHERE rank <= 20 AND trim(f.content, ' ') <> ''),
p AS (SELECT recall_id, i, CASE WHEN 10 + n <= 200 THEN 10 + n ELSE 10 END AS used, (10 + n <= 200)::INT AS inc, (10 + n > 200)::INT AS om FROM b WHERE i = 1
  UNION ALL SELECT b.recall_id, b.i, CASE WHEN p.used + n <= 200 THEN p.used + n ELSE p.used END, inc + (p.used + n <= 200)::INT, om + (p.used + n > 200)::INT FROM p JOIN b ON b.recall_id = p.recall_id AND b.i = p.i + 1)
SELECT recall_id, CAST(max_by(used, i) + CASE WHEN max(inc) = 0 THEN 1 ELSE 0 END AS BIGINT) AS prompt_tokens, max(inc) AS included, max(om) AS omitted, true AS kept_task FROM p GROUP BY 1"""


@query(using("pool", "fragments").rstrip() + _PACK)
def t4_prompt_pack(spark: SparkSession, d: str) -> DataFrame:
    p = recall.ranked(v.pool(spark, d), "recall_id", F.col("semantic"), "candidate_id").where("rank <= 20")
    p = p.join(v.fragments(spark, d).select(F.col("id").alias("fragment_id"), "content"), "fragment_id")
    out = prompts.assemble(p, "recall_id", "rank", "fragment_id", "content", F.lit("Which memory answers the question?"), F.lit("Task context: recall"), 200)
    return out.select("recall_id", "prompt_tokens", F.size("included").alias("included"), F.size("omitted").alias("omitted"), "kept_task")


@query(using("pool") + f"""SELECT recall_id, count(*) AS recalled, max(CASE WHEN r = 1 THEN fragment_id END) AS first_id, round(sum(CASE WHEN r <= 5 THEN semantic ELSE 0 END), 6) AS top_score FROM (
  SELECT *, row_number() OVER (PARTITION BY recall_id ORDER BY semantic DESC, candidate_id) AS r FROM pool WHERE ({NOW} - last_access_ms) >= 0) GROUP BY 1""")
def e7_recall_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("recall_id").orderBy(F.col("semantic").desc(), "candidate_id")
    p = v.pool(spark, d).where(F.col("last_access_ms") <= v.NOW_MS).withColumn("r", F.row_number().over(w))
    return p.groupBy("recall_id").agg(F.count("*").alias("recalled"), F.max(F.when(F.col("r") == 1, F.col("fragment_id"))).alias("first_id"), F.round(F.sum(F.when(F.col("r") <= 5, F.col("semantic")).otherwise(0.0)), 6).alias("top_score"))
