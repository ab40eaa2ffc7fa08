"""Evaluation, aggregates, gates and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import evaluate, recall
from tidemark.plans import views as v
from tidemark.plans.registry import query
from tidemark.plans.sqlviews import using


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics(v.case_modes(spark, d), 5)


_IDCG = "list_sum(list_transform(range(1, 6), lambda r: CASE WHEN r <= n_expected THEN 1 / log2(r + 1) ELSE 0 END))"
_M = f""", m AS (SELECT *, matched > 0 AS recall_hit, n_expected > 0 AND matched = n_expected AS all_expected, CASE WHEN n_expected = 0 THEN 0 ELSE matched / n_expected END AS recall,
  CASE WHEN n_expected = 0 THEN 0 ELSE matched / 5 END AS precision, CASE WHEN n_expected = 0 OR first_rank IS NULL THEN 0 ELSE 1 / first_rank END AS reciprocal_rank,
  CASE WHEN n_expected = 0 THEN 0 ELSE dcg / {_IDCG} END AS ndcg FROM case_modes) """
_CM = using("case_modes").rstrip() + _M
_SUM = """SELECT {0} count(*) AS cases, count(*) FILTER (failed) AS errors, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
  round(avg(CASE WHEN recall_hit THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate, round(avg(latency_ms), 6) AS avg_ms, quantile_disc(latency_ms, 0.5)::DOUBLE AS p50_ms, quantile_disc(latency_ms, 0.95)::DOUBLE AS p95_ms, quantile_disc(latency_ms, 0.99)::DOUBLE AS p99_ms FROM m GROUP BY ALL"""


@query(_CM + "SELECT case_id, mode, matched, recall_hit, all_expected, round(recall, 6) AS recall, round(precision, 6)::DOUBLE AS precision, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM m")
def a13_metrics_at_k(spark: SparkSession, d: str) -> DataFrame:
    rounded = (F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank", "ndcg"))
    return _metrics(spark, d).select("case_id", "mode", "matched", "recall_hit", "all_expected", *rounded)


@query(_CM + _SUM.format("mode,"))
def a14_mode_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.mode_summary(_metrics(spark, d), "mode")


@query(_CM + f", s AS ({_SUM.format('mode,')}) SELECT s.mode, round(s.recall - b.recall, 6) AS recall_lift, round(CASE WHEN b.recall = 0 THEN 0 ELSE (s.recall - b.recall) / b.recall END, 6) AS recall_relative, round(s.ndcg - b.ndcg, 6) AS ndcg_lift, round(CASE WHEN b.ndcg = 0 THEN 0 ELSE (s.ndcg - b.ndcg) / b.ndcg END, 6) AS ndcg_relative FROM s, (SELECT * FROM s WHERE mode = 'VECTOR_RERANK') b")
def a15_lift(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.lift(a14_mode_summary(spark, d), "VECTOR_RERANK", "recall", "ndcg")


@query(_CM + """SELECT mode, round(avg(CASE WHEN all_expected AND NOT failed THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN recall_hit THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate,
  round(avg(CASE WHEN all_expected THEN 1.0::DOUBLE ELSE 0 END) FILTER (case_id % 4 = 0), 6) AS recovered_accuracy, round(avg(latency_ms) FILTER (NOT failed), 6) AS avg_ms, count(*) FILTER (case_id % 3 = 0) AS feedback FROM m GROUP BY 1""")
def a16_answer_summary(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    one = lambda c: c.cast("double")
    return m.groupBy("mode").agg(
        F.round(F.avg(one(F.col("all_expected") & ~F.col("failed"))), 6).alias("accuracy"), F.round(F.avg(one(F.col("recall_hit"))), 6).alias("hit_rate"), F.round(F.avg(F.when(F.col("case_id") % 4 == 0, one(F.col("all_expected")))), 6).alias("recovered_accuracy"),
        F.round(F.avg(F.when(~F.col("failed"), F.col("latency_ms"))), 6).alias("avg_ms"), F.sum((F.col("case_id") % 3 == 0).cast("bigint")).alias("feedback"))


_SERIES6 = ["queue", "extract", "embed", "hot", "warm", "cold"]
_STAGES = """SELECT concat(l_linestatus, l_linenumber % 3) AS mode, l_quantity AS queue, l_extendedprice / 100 AS extract, CASE WHEN l_linenumber < 6 THEN l_discount * 1000 END AS embed, l_tax * 1000 AS hot, CAST(l_partkey % 500 AS DOUBLE) AS warm, CAST(l_suppkey % 300 AS DOUBLE) AS cold,
  l_returnflag <> 'R' AS ok, greatest(0, l_quantity - 30) AS lag FROM lineitem"""


def _stages(spark: SparkSession, d: str) -> DataFrame:
    li = v.table(spark, d, "lineitem")
    c = F.col
    return li.select(
        F.concat("l_linestatus", (c("l_linenumber") % 3).cast("string")).alias("mode"), c("l_quantity").alias("queue"), (c("l_extendedprice") / 100).alias("extract"), F.when(c("l_linenumber") < 6, c("l_discount") * 1000).alias("embed"), (c("l_tax") * 1000).alias("hot"),
        (c("l_partkey") % 500).cast("double").alias("warm"), (c("l_suppkey") % 300).cast("double").alias("cold"), (c("l_returnflag") != "R").alias("ok"), F.greatest(F.lit(0), c("l_quantity") - 30).alias("lag"))


@query(f"""SELECT mode, series, count(*) AS samples, round(avg(ms), 4) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms, quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms, quantile_disc(ms, 0.99) AS p99_ms, round(quantile_cont(ms, 0.95), 7) AS p95_linear
  FROM (UNPIVOT (SELECT mode, {", ".join(f"{x}::DOUBLE AS {x}" for x in _SERIES6)} FROM ({_STAGES})) ON {", ".join(_SERIES6)} INTO NAME series VALUE ms) GROUP BY 1, 2""")
def a17_latency_summary(spark: SparkSession, d: str) -> DataFrame:
    """Six latency series for each mode."""
    return evaluate.series_summary(_stages(spark, d), ["mode"], _SERIES6)


@query(f"SELECT mode, count(*) AS samples, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END), 6) AS success_rate, count(embed) AS embedded, round(avg(lag), 6) AS lag, round(1000 / avg(extract), 6) AS throughput FROM ({_STAGES}) GROUP BY 1")
def a17_mode_rates(spark: SparkSession, d: str) -> DataFrame:
    """Success rate, stage count, mean lag and throughput for each mode."""
    g = _stages(spark, d).groupBy("mode").agg(F.count("*").alias("samples"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"), F.count("embed").alias("embedded"), F.round(F.avg("lag"), 6).alias("lag"), F.round(1000 / F.avg("extract"), 6).alias("throughput"))
    return g


_QUEUE = "SELECT *, greatest(0, coalesce(runs - lag(runs) OVER (PARTITION BY day ORDER BY l_orderkey, l_linenumber, runs), 0)) AS grown FROM (SELECT l_shipdate::DATE::VARCHAR AS day, l_quantity, l_orderkey, l_linenumber, l_suppkey % 50 AS runs, l_extendedprice AS p, l_returnflag FROM lineitem)"


@query(f"""SELECT day, max(l_quantity) AS max_queue, CAST(coalesce(sum(grown), 0) AS BIGINT) AS caller_runs, max(l_quantity) >= 50 AS saturated,
  round(CASE WHEN coalesce(avg(p) FILTER (l_returnflag = 'N'), 0) = 0 THEN 0 ELSE (avg(p) FILTER (l_returnflag = 'N') - coalesce(avg(p) FILTER (l_returnflag <> 'N'), 0)) / avg(p) FILTER (l_returnflag = 'N') END, 6)::DOUBLE AS relative_reduction FROM ({_QUEUE}) GROUP BY 1""")
def a18_backpressure(spark: SparkSession, d: str) -> DataFrame:
    """Longest queue, growth of the caller-runs counter, saturation, and how far one series lies below the other."""
    li = v.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("day"), "l_quantity", "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 50).alias("runs"), F.col("l_extendedprice").alias("p"), "l_returnflag")
    w = Window.partitionBy("day").orderBy("l_orderkey", "l_linenumber", "runs")
    li = li.withColumn("grown", F.greatest(F.lit(0), F.col("runs") - F.lag("runs").over(w)))
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("p"))), F.lit(0.0))
    g = li.groupBy("day").agg(F.max("l_quantity").alias("max_queue"), F.coalesce(F.sum("grown"), F.lit(0)).cast("bigint").alias("caller_runs"), mean(F.col("l_returnflag") == "N").alias("a"), mean(F.col("l_returnflag") != "N").alias("b"))
    return g.select("day", "max_queue", "caller_runs", (F.col("max_queue") >= 50).alias("saturated"), F.round(scalar.ratio(F.col("a") - F.col("b"), F.col("a")), 6).alias("relative_reduction"))


@query(using("case_modes") + "SELECT category, count(*) AS cases, count(*) FILTER (NOT failed) AS passed, round(avg(latency_ms), 6) AS avg_ms FROM case_modes GROUP BY 1")
def a19_category_recovery(spark: SparkSession, d: str) -> DataFrame:
    return v.case_modes(spark, d).groupBy("category").agg(F.count("*").alias("cases"), F.sum((~F.col("failed")).cast("bigint")).alias("passed"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"))


@query(_CM + """, x AS (SELECT *, coalesce(first_rank, n_returned + 1) AS r FROM m) SELECT x.mode, quantile_cont(x.r, 0.5)::DOUBLE AS median_rank, round(avg(x.ndcg), 6) AS ndcg, count(*) FILTER (x.r < b.r) AS improved, count(*) FILTER (x.r > b.r) AS worsened,
  round(avg(CASE WHEN x.all_expected THEN 1.0::DOUBLE ELSE 0 END), 6) AS all_relevant_rate FROM x JOIN (SELECT case_id, r FROM x WHERE mode = 'VECTOR_ONLY') b USING (case_id) GROUP BY 1""")
def a20_learning_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of the first relevant item against those of the plain vector mode."""
    m = _metrics(spark, d).withColumn("r", F.coalesce("first_rank", F.col("n_returned") + 1))
    m = m.withColumn("base", F.max(F.when(F.col("mode") == "VECTOR_ONLY", F.col("r"))).over(Window.partitionBy("case_id"))).where("base is not null")
    n = lambda c: F.sum(c.cast("bigint"))
    return m.groupBy("mode").agg(F.expr("percentile(r, 0.5)").alias("median_rank"), F.round(F.avg("ndcg"), 6).alias("ndcg"), n(F.col("r") < F.col("base")).alias("improved"), n(F.col("r") > F.col("base")).alias("worsened"), F.round(F.avg(F.col("all_expected").cast("double")), 6).alias("all_relevant_rate"))


@query(_CM + _SUM.format("category, mode,"))
def a21_category_mode(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.mode_summary(_metrics(spark, d), "category", "mode")


@query(using("case_results") + """SELECT mode, count(*) FILTER (c > 0) AS order_changed, count(*) FILTER (c = 0 AND scores > 1) AS identifiable, count(*) FILTER (c = 0 AND scores <= 1) AS non_identifiable, sum(c)::BIGINT AS changed_places, round(avg(CASE WHEN c > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS changed_rate,
  array_to_string(list_sort(list(DISTINCT concat('cat', case_id % 6))), ',') AS categories FROM (
  SELECT a.case_id, a.mode, count(*) FILTER (a.fragment_id <> b.fragment_id) AS c, count(DISTINCT a.score) AS scores FROM case_results a JOIN case_results b ON a.case_id = b.case_id AND a.rank = b.rank AND b.mode = 'VECTOR_ONLY' GROUP BY 1, 2) GROUP BY 1""")
def a22_rerank_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    r = v.case_results(spark, d)
    w = Window.partitionBy("case_id", "rank")
    r = r.withColumn("base", F.max(F.when(F.col("mode") == "VECTOR_ONLY", F.col("fragment_id"))).over(w)).where("base is not null")
    c = r.groupBy("case_id", "mode").agg(F.sum((F.col("fragment_id") != F.col("base")).cast("bigint")).alias("c"), F.countDistinct("score").alias("scores"))
    c = c.withColumn("status", recall.rerank_effect(F.col("c"), F.col("scores")))
    n = lambda x: F.sum((F.col("status") == x).cast("bigint"))
    return c.groupBy("mode").agg(
        n("ORDER_CHANGED").alias("order_changed"), n("IDENTIFIABLE").alias("identifiable"), n("NON_IDENTIFIABLE").alias("non_identifiable"), F.sum("c").alias("changed_places"), F.round(F.avg((F.col("c") > 0).cast("double")), 6).alias("changed_rate"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.concat(F.lit("cat"), F.col("case_id") % 6)))).alias("categories"))


_PAIRED = ", a AS (SELECT * FROM m WHERE mode = 'HYBRID'), b AS (SELECT * FROM m WHERE mode = 'VECTOR_ONLY') "


@query(_CM + _PAIRED + "SELECT case_id, round(a.recall - b.recall, 6) AS recall_delta, round(a.ndcg - b.ndcg, 6) AS ndcg_delta, a.latency_ms - b.latency_ms AS latency_delta FROM a JOIN b USING (case_id)")
def j12_paired_modes(spark: SparkSession, d: str) -> DataFrame:
    p = evaluate.paired(_metrics(spark, d), "HYBRID", "VECTOR_ONLY")
    return p.select("case_id", F.round(F.col("l_recall") - F.col("r_recall"), 6).alias("recall_delta"), F.round(F.col("l_ndcg") - F.col("r_ndcg"), 6).alias("ndcg_delta"), (F.col("l_latency_ms") - F.col("r_latency_ms")).alias("latency_delta"))


@query(using("case_results", "candidates") + "SELECT r.case_id, concat('cat', r.case_id % 6) AS category, count(*) AS n FROM case_results r JOIN (SELECT DISTINCT recall_id FROM candidates) c ON c.recall_id = r.case_id GROUP BY 1, 2")
def j13_result_dataset(spark: SparkSession, d: str) -> DataFrame:
    known = v.candidates(spark, d).select(F.col("recall_id").alias("case_id"), F.concat(F.lit("cat"), F.col("recall_id") % 6).alias("category")).distinct()
    return v.case_results(spark, d).join(known, "case_id").groupBy("case_id", "category").agg(F.count("*").alias("n"))


_FLAWED = """, cs AS (SELECT DISTINCT recall_id AS case_id FROM candidates WHERE recall_id % 50 <> 0), rs AS (SELECT case_id, mode, fragment_id FROM case_results WHERE NOT (mode = 'HYBRID' AND case_id % 77 = 0) UNION ALL SELECT case_id, mode, fragment_id FROM case_results WHERE case_id % 91 = 0 AND rank = 1) """


@query(using("case_results", "candidates").rstrip() + _FLAWED + f"""SELECT 'unknown_case' AS "check", count(*) AS n FROM (SELECT DISTINCT case_id, mode FROM rs WHERE case_id NOT IN (SELECT case_id FROM cs)) UNION ALL
  SELECT 'duplicate_result', count(*) FROM (SELECT case_id, mode, fragment_id FROM rs GROUP BY ALL HAVING count(*) > 1) UNION ALL
  SELECT 'missing_mode', count(*) FROM (SELECT case_id, mode FROM cs, (SELECT unnest({v.MODES}) AS mode) EXCEPT SELECT case_id, mode FROM rs)""")
def j13_result_checks(spark: SparkSession, d: str) -> DataFrame:
    """What makes a set of results unfit: unknown cases, repeats, missing modes."""
    r = v.case_results(spark, d).select("case_id", "mode", "fragment_id", "rank")
    flawed = r.where("not (mode = 'HYBRID' and case_id % 77 = 0)").unionByName(r.where("case_id % 91 = 0 and rank = 1"))
    return evaluate.result_checks(flawed, v.candidates(spark, d).where("recall_id % 50 <> 0").select(F.col("recall_id").alias("case_id")), v.MODES)


@query(_CM + _PAIRED + """SELECT count(*) FILTER (a.recall > b.recall) AS wins, count(*) FILTER (a.recall = b.recall) AS ties, count(*) FILTER (a.recall < b.recall) AS losses, round(avg(a.recall - b.recall), 6) AS recall_delta,
  round(avg(a.ndcg - b.ndcg), 6) AS ndcg_delta, round(avg(a.reciprocal_rank - b.reciprocal_rank), 6) AS mrr_delta FROM a JOIN b USING (case_id)""")
def a23_win_tie_loss(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.win_tie_loss(evaluate.paired(_metrics(spark, d), "HYBRID", "VECTOR_ONLY"))


@query()
def a24_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    p = evaluate.paired(_metrics(spark, d), "HYBRID", "VECTOR_ONLY").select("case_id", (F.col("l_recall") - F.col("r_recall")).alias("delta"))
    return evaluate.bootstrap_interval(p, "delta", "case_id")


@query(using("case_modes") + "SELECT category, count(DISTINCT case_id) AS cases FROM case_modes GROUP BY 1")
def a25_category_counts(spark: SparkSession, d: str) -> DataFrame:
    return v.case_modes(spark, d).groupBy("category").agg(F.countDistinct("case_id").alias("cases"))


@query("SELECT round(count(*) FILTER (o_orderstatus <> 'F') / count(*), 6) AS log_coverage, round(count(*) FILTER (o_orderstatus = 'O') / count(*) FILTER (o_orderpriority = '1-URGENT'), 6) AS checkpoint_success, CASE WHEN count(*) FILTER (o_orderstatus = 'X') = 0 THEN 1.0::DOUBLE ELSE 0 END AS durability, round(count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice > 1000) / count(*) FILTER (o_totalprice > 1000), 6) AS persistence FROM orders")
def a26_slo_rates(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.sum(c.cast("bigint"))
    s = F.col("o_orderstatus")
    g = v.table(spark, d, "orders").agg(F.count("*").alias("n"), n(s != "F").alias("a"), n(s == "O").alias("b"), n(F.col("o_orderpriority") == "1-URGENT").alias("c"), n(s == "X").alias("x"), n(F.col("o_totalprice") > 1000).alias("tried"), n((s != "P") & (F.col("o_totalprice") > 1000)).alias("kept"))
    return g.select(F.round(scalar.ratio(F.col("kept"), F.col("tried"), 1.0), 6).alias("persistence"), F.round(scalar.ratio(F.col("a"), F.col("n"), 1.0), 6).alias("log_coverage"), F.round(scalar.ratio(F.col("b"), F.col("c"), 1.0), 6).alias("checkpoint_success"), scalar.ratio(F.lit(0.0), F.col("x"), 1.0).alias("durability"))


@query(using("ev") + "SELECT event_type, count(*) AS samples, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts_ms DESC, event_id DESC) AS r FROM ev) WHERE r <= 512 GROUP BY 1")
def a27_rolling_p95(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.rolling(v.events(spark, d), ["event_type"], [F.col("ts_ms").desc(), F.col("event_id").desc()], "value")


@query(using("ev") + "SELECT event_type AS source, count(*) AS requested, count(*) FILTER (k < 30) AS consumed, count(*) FILTER (k >= 60) AS missed, round(count(*) FILTER (k < 30) / count(*), 6) AS hit_rate FROM ev GROUP BY 1")
def a28_prefetch_stats(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.sum(c.cast("bigint"))
    g = v.events(spark, d).groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("requested"), n(F.col("k") < 30).alias("consumed"), n(F.col("k") >= 60).alias("missed"))
    return g.withColumn("hit_rate", F.round(scalar.ratio(F.col("consumed"), F.col("requested")), 6))


@query(using("pages") + """, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY last_access_ms NULLS LAST, id) AS r FROM pages)
SELECT state, count(DISTINCT page_id) AS pages, count(*) AS assignments, count(*) FILTER (r > 1) AS reused, count(*) FILTER (r = 1) AS opened, round(count(*) FILTER (r > 1) / count(*), 6) AS reuse_ratio, round(count(*) FILTER (r = 1) / count(*), 6) AS new_page_ratio FROM o GROUP BY 1""")
def a29_page_stats(spark: SparkSession, d: str) -> DataFrame:
    """Assignments that opened a page and those that found one, by state of the page."""
    per = v.pages(spark, d).groupBy("state", "page_id").agg(F.count("*").alias("n"))
    g = per.groupBy("state").agg(F.count("*").alias("pages"), F.sum("n").alias("assignments"), F.sum(F.col("n") - 1).alias("reused"), F.count("*").alias("opened"))
    return g.withColumn("reuse_ratio", F.round(scalar.ratio(F.col("reused"), F.col("assignments")), 6)).withColumn("new_page_ratio", F.round(scalar.ratio(F.col("opened"), F.col("assignments")), 6))


@query(_CM + ", r AS (SELECT mode, case_id % 5 AS round, avg(recall) AS a FROM m GROUP BY 1, 2) SELECT mode, count(*) AS rounds, round(avg(a), 6) AS mean_accuracy, round(max(a), 6) AS best, count(DISTINCT round(a, 6)) = 1 AS stable, avg(a) + 1e-7 >= 0.3 AS passed FROM r GROUP BY 1")
def a30_audit_gate(spark: SparkSession, d: str) -> DataFrame:
    r = _metrics(spark, d).groupBy("mode", (F.col("case_id") % 5).alias("round")).agg(F.avg("recall").alias("a"))
    return r.groupBy("mode").agg(F.count("*").alias("rounds"), F.round(F.avg("a"), 6).alias("mean_accuracy"), F.round(F.max("a"), 6).alias("best"), (F.countDistinct(F.round("a", 6)) == 1).alias("stable"), (F.avg("a") + 1e-7 >= 0.3).alias("passed"))


@query(using("pool") + "SELECT recall_id, count(DISTINCT semantic + 0.0) AS scores FROM pool GROUP BY 1")
def a31_distinct_scores(spark: SparkSession, d: str) -> DataFrame:
    return v.pool(spark, d).groupBy("recall_id").agg(F.countDistinct(F.col("semantic") + F.lit(0.0)).alias("scores"))


@query(using("candidates", "pages") + ", p AS (SELECT DISTINCT recall_id, page_id FROM candidates c JOIN pages p ON p.id = c.fragment_id) SELECT a.page_id, b.page_id AS other, count(*) AS together FROM p a JOIN p b ON a.recall_id = b.recall_id AND a.page_id < b.page_id GROUP BY 1, 2")
def a32_co_access(spark: SparkSession, d: str) -> DataFrame:
    # a recall offers a bounded number of candidates, so its pages are a short list
    p = v.pages(spark, d).select(F.col("id").alias("fragment_id"), "page_id")
    per = v.candidates(spark, d).join(p, "fragment_id").groupBy("recall_id").agg(F.sort_array(F.collect_set("page_id")).alias("pages"))
    pairs = per.select(F.posexplode("pages").alias("i", "page_id"), "pages").select("page_id", F.explode(F.expr("slice(pages, i + 2, size(pages))")).alias("other"))
    return pairs.groupBy("page_id", "other").agg(F.count("*").alias("together"))


@query(_CM + "SELECT case_id, mode, n_expected - matched AS missing, CASE WHEN failed THEN 'error' WHEN matched = 0 THEN 'recall_miss' ELSE 'partial' END AS reason FROM m WHERE mode <> 'VECTOR_ONLY' AND NOT all_expected")
def a34_case_failures(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d).where("mode <> 'VECTOR_ONLY' and not all_expected")
    reason = F.when(F.col("failed"), "error").when(F.col("matched") == 0, "recall_miss").otherwise("partial")
    return m.select("case_id", "mode", (F.col("n_expected") - F.col("matched")).alias("missing"), reason.alias("reason"))


@query(_CM + """SELECT case_id // 5 AS case_no, mode, count(*) AS rounds, count(*) FILTER (NOT all_expected) AS failures, sum(n_expected - matched)::BIGINT AS missing, coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN failed THEN 'error' WHEN matched = 0 THEN 'recall_miss' ELSE 'partial' END) FILTER (NOT all_expected)), ','), '') AS reasons,
  count(DISTINCT concat(matched, '/', n_returned)) AS outcomes FROM m WHERE mode <> 'VECTOR_ONLY' GROUP BY 1, 2 HAVING count(*) FILTER (NOT all_expected) > 0""")
def a34_failure_summary(spark: SparkSession, d: str) -> DataFrame:
    """Failures of a case under a mode over its five rounds."""
    m = _metrics(spark, d).where("mode <> 'VECTOR_ONLY'").withColumn("bad", ~F.col("all_expected"))
    reason = F.when(F.col("failed"), "error").when(F.col("matched") == 0, "recall_miss").otherwise("partial")
    g = m.groupBy(F.floor(F.col("case_id") / 5).alias("case_no"), "mode").agg(
        F.count("*").alias("rounds"), F.sum(F.col("bad").cast("bigint")).alias("failures"), F.sum(F.col("n_expected") - F.col("matched")).alias("missing"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("bad"), reason)))).alias("reasons"), F.countDistinct(F.concat_ws("/", "matched", "n_returned")).alias("outcomes"))
    return g.where("failures > 0")


_ROUND = "SELECT mode, case_id % 5 AS round, round(avg(latency_ms), 6) AS mean_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, sum(latency_ms) AS total FROM case_modes GROUP BY 1, 2"


@query(using("case_modes") + f"SELECT * EXCLUDE (total) FROM ({_ROUND})")
def a35_runtime_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return v.case_modes(spark, d).groupBy("mode", (F.col("case_id") % 5).alias("round")).agg(F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"))


@query(using("case_modes") + f"SELECT mode, count(*) AS rounds, round(avg(total), 4)::DOUBLE AS mean_ms, min(total)::BIGINT AS min_ms, max(total)::BIGINT AS max_ms FROM ({_ROUND}) GROUP BY 1")
def a35_run_telemetry(spark: SparkSession, d: str) -> DataFrame:
    """Elapsed time of whole rounds."""
    r = v.case_modes(spark, d).groupBy("mode", (F.col("case_id") % 5).alias("round")).agg(F.sum("latency_ms").alias("total"))
    return r.groupBy("mode").agg(F.count("*").alias("rounds"), F.round(F.avg("total"), 4).alias("mean_ms"), F.min("total").alias("min_ms"), F.max("total").alias("max_ms"))


# Retrieval and answer modes that an ablation runs.
RECALL_MODES = ["KEYWORD_ONLY", "VECTOR_ONLY", "VECTOR_RERANK", "VECTOR_CROSS_ENCODER", "HYBRID", "HYBRID_RERANK", "HYBRID_CROSS_ENCODER"]
ANSWER_MODES = ["NO_MEMORY", "MEMORY", "RECOVERED", "RERANKED"]


@query(using("case_results", "candidates") + f"""SELECT g.case_id, g.kind, g.mode, coalesce(r.n, 0) AS returned FROM (SELECT recall_id AS case_id, kind, mode FROM (SELECT DISTINCT recall_id FROM candidates), (SELECT unnest({RECALL_MODES}) AS mode, 'recall' AS kind UNION ALL SELECT unnest({ANSWER_MODES}), 'answer')) g
  LEFT JOIN (SELECT case_id, mode, count(*) AS n FROM case_results WHERE rank <= 5 GROUP BY 1, 2) r ON r.case_id = g.case_id AND r.mode = g.mode""")
def a36_ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every case under seven recall and four answer modes, with what the mode returned among the first 5."""
    modes = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(m).alias("mode")) for k, ms in (("recall", RECALL_MODES), ("answer", ANSWER_MODES)) for m in ms))).alias("m")
    g = v.candidates(spark, d).select(F.col("recall_id").alias("case_id")).distinct().select("case_id", modes).select("case_id", "m.kind", "m.mode")
    n = v.case_results(spark, d).where("rank <= 5").groupBy("case_id", "mode").agg(F.count("*").alias("returned"))
    return g.join(n, ["case_id", "mode"], "left").select("case_id", "kind", "mode", F.coalesce("returned", F.lit(0)).alias("returned"))


_SESS = """, sess AS (SELECT recall_id, concat('s', recall_id % 4) AS scenario, coalesce(sum(1 / log2(a + 1)) FILTER (relevant), 0) / s.i AS active, coalesce(sum(1 / log2(b + 1)) FILTER (relevant), 0) / s.i AS shadow, 1 - count(*) FILTER (relevant AND a > 5) / count(*) AS utility FROM (
  SELECT *, row_number() OVER (PARTITION BY recall_id ORDER BY semantic DESC, candidate_id) AS a, row_number() OVER (PARTITION BY recall_id ORDER BY coalesce(keyword, 0) DESC, candidate_id) AS b FROM pool) JOIN (
  SELECT recall_id, list_sum(list_transform(range(1, n + 1), lambda r: 1 / log2(r + 1))) AS i FROM (SELECT recall_id, count(*) FILTER (relevant) AS n FROM pool GROUP BY 1) WHERE n > 0) s USING (recall_id) GROUP BY recall_id, s.i) """
_SE = using("pool").rstrip() + _SESS


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    p = v.pool(spark, d)
    by = lambda c: Window.partitionBy("recall_id").orderBy(c.desc(), "candidate_id")
    p = p.withColumn("a", F.row_number().over(by(F.col("semantic")))).withColumn("b", F.row_number().over(by(F.coalesce("keyword", F.lit(0.0)))))
    gained = lambda c: F.coalesce(F.sum(F.when(F.col("relevant"), scalar.gain(F.col(c)))), F.lit(0.0))
    g = p.groupBy("recall_id").agg(F.sum(F.col("relevant").cast("bigint")).alias("n"), F.count("*").alias("all"), gained("a").alias("ga"), gained("b").alias("gb"), F.sum((F.col("relevant") & (F.col("a") > 5)).cast("bigint")).alias("late"))
    g = g.where("n > 0")
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("n")), lambda r: 1 / F.log2(r + 1)), F.lit(0.0), lambda s, x: s + x)
    return g.select("recall_id", F.concat(F.lit("s"), F.col("recall_id") % 4).alias("scenario"), (F.col("ga") / ideal).alias("active"), (F.col("gb") / ideal).alias("shadow"), (1 - F.col("late") / F.col("all")).alias("utility"))


@query(_SE + """SELECT scenario, count(*) AS samples, round(avg(active), 6) AS active, round(avg(shadow), 6) AS shadow, round(avg(utility), 6) AS utility, round(CASE WHEN avg(active) = 0 THEN 0 ELSE (avg(shadow) - avg(active)) / avg(active) END, 6) AS lift,
  round(avg(CASE WHEN shadow > active * 1.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_ratio FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY recall_id DESC) AS r FROM sess) WHERE r <= 2048 GROUP BY 1""")
def a9_shadow_snapshot(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("scenario").orderBy(F.col("recall_id").desc())
    s = _sessions(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 2048")
    g = s.groupBy("scenario").agg(F.count("*").alias("samples"), F.avg("active").alias("active"), F.avg("shadow").alias("shadow"), F.avg("utility").alias("utility"), F.avg((F.col("shadow") > F.col("active") * 1.05).cast("double")).alias("win_ratio"))
    return g.select("scenario", "samples", *(F.round(c, 6).alias(c) for c in ("active", "shadow", "utility")), F.round(scalar.ratio(F.col("shadow") - F.col("active"), F.col("active")), 6).alias("lift"), F.round("win_ratio", 6).alias("win_ratio"))


@query(_SE + "SELECT recall_id, round(0.7::DOUBLE * active + 0.3::DOUBLE * utility, 6) AS composite FROM sess")
def a10_eviction_composite(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("recall_id", F.round(0.7 * F.col("active") + 0.3 * F.col("utility"), 6).alias("composite"))


@query(_CM + "SELECT case_id, mode, round(matched / least(5, n_returned), 6) AS selection_precision, round(CASE WHEN n_expected = 0 THEN 0 ELSE matched / n_expected END, 6)::DOUBLE AS coverage FROM m")
def a11_precision_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("case_id", "mode", F.round(F.col("matched") / F.least(F.lit(5), "n_returned"), 6).alias("selection_precision"), F.round(scalar.ratio(F.col("matched"), F.col("n_expected")), 6).alias("coverage"))


@query(_CM + """SELECT case_id, mode, round(least(1, greatest(0, 0.15::DOUBLE * (NOT failed)::INT + 0.15::DOUBLE * (1 - (case_id % 10) / 10) + 0.25::DOUBLE * ndcg + 0.1::DOUBLE * (1 - least(1, (n_expected - matched) / n_returned)) + 0.1::DOUBLE * (matched / n_returned)
  + 0.15::DOUBLE * (matched / least(5, n_returned)) + 0.1::DOUBLE * recall)), 6) AS reward FROM m""")
def a12_reward(spark: SparkSession, d: str) -> DataFrame:
    """Answer, regret, gain, eviction utility, grounding, precision and coverage in one score."""
    c = F.col
    terms = {
        0.15: [F.when(c("failed"), 0.0).otherwise(1.0), 1 - (c("case_id") % 10) / 10, c("matched") / F.least(F.lit(5), "n_returned")], 0.25: [c("ndcg")],
        0.10: [1 - F.least(F.lit(1.0), (c("n_expected") - c("matched")) / c("n_returned")), c("matched") / c("n_returned"), c("recall")],
    }
    total = sum((w * t for w, ts in terms.items() for t in ts), F.lit(0.0))
    return _metrics(spark, d).select("case_id", "mode", F.round(scalar.clamp(total, 0.0, 1.0), 6).alias("reward"))


@query(_SE + "SELECT scenario, max(recall_id) FILTER (shadow >= active * 1.05) AS last_win, count(*) FILTER (recall_id > coalesce(l, -1)) AS streak FROM sess JOIN (SELECT scenario, max(recall_id) FILTER (shadow < active * 1.05) AS l FROM sess GROUP BY 1) USING (scenario) GROUP BY 1")
def w13_promotion_streak(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.runs(_sessions(spark, d), ["scenario"], [F.col("recall_id")], F.col("shadow") >= F.col("active") * 1.05)
    last = F.max("run").over(Window.partitionBy("scenario"))
    r = r.withColumn("now", F.col("flag") & (F.col("run") == last))
    return r.groupBy("scenario").agg(F.max(F.when(F.col("flag"), F.col("recall_id"))).alias("last_win"), F.sum(F.col("now").cast("bigint")).alias("streak"))


@query(_SE + "SELECT scenario, count(*) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY recall_id DESC) AS r FROM sess) WHERE r <= 2048 GROUP BY 1")
def w12_sample_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("scenario").orderBy(F.col("recall_id").desc())
    return _sessions(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 2048").groupBy("scenario").agg(F.count("*").alias("samples"))


_CUT = "CASE WHEN r <= 0.5 * n THEN 'dev' WHEN r <= 0.8 * n THEN 'validation' ELSE 'reserve' END"


@query(f"SELECT p_partkey, {_CUT} AS split FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY sha256(concat('20260728|case|', p_partkey)), p_partkey) AS r, count(*) OVER (PARTITION BY p_type) AS n FROM part)")
def w14_stratified_split(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_type").orderBy(F.sha2(F.concat(F.lit("20260728|case|"), "p_partkey"), 256), "p_partkey")
    p = v.table(spark, d, "part").select("p_partkey", F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy("p_type")).alias("n"))
    return p.select("p_partkey", F.when(F.col("r") <= 0.5 * F.col("n"), "dev").when(F.col("r") <= 0.8 * F.col("n"), "validation").otherwise("reserve").alias("split"))


@query("""SELECT p_brand, CAST(f + CASE WHEN row_number() OVER (ORDER BY r DESC, sha256(concat('seed|', p_brand)), p_brand) <= 100 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (
  SELECT p_brand, floor(e) AS f, round(e - floor(e), 9) AS r FROM (SELECT p_brand, count(*) * 100 / (SELECT count(*) FROM part) AS e FROM part GROUP BY 1))""")
def w15_largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    sizes = v.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return evaluate.largest_remainder(sizes, "p_brand", "n", 100, "seed")


@query("SELECT p_type, p_partkey FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part) WHERE r <= 5")
def w16_first_n_per_category(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_type").orderBy("p_partkey")
    return v.table(spark, d, "part").withColumn("r", F.row_number().over(w)).where("r <= 5").select("p_type", "p_partkey")


@query(using("case_modes") + "SELECT mode, quantile_cont(coalesce(first_rank, n_returned + 1), 0.5)::DOUBLE AS median_rank FROM case_modes GROUP BY 1")
def w17_median_relevant_rank(spark: SparkSession, d: str) -> DataFrame:
    return v.case_modes(spark, d).withColumn("r", F.coalesce("first_rank", F.col("n_returned") + 1)).groupBy("mode").agg(F.expr("percentile(r, 0.5)").alias("median_rank"))


_STAT = ", s AS (SELECT avg(recall) AS recall, avg(ndcg) AS ndcg, quantile_disc(latency_ms, 0.95) AS p95, count(*) FILTER (failed) / count(*) AS errors FROM m) "


@query(_CM + _STAT + "SELECT CASE WHEN errors > 0.05 THEN 'DOWN' WHEN recall >= 0.6 AND ndcg >= 0.5 AND p95 <= 480 THEN 'UP' ELSE 'DEGRADED' END AS status, round(recall, 6) AS recall, p95::DOUBLE AS p95 FROM s")
def h1_health_status(spark: SparkSession, d: str) -> DataFrame:
    s = _stats(spark, d)
    ok = (F.col("recall") >= 0.6) & (F.col("ndcg") >= 0.5) & (F.col("p95") <= 480)
    return s.select(F.when(F.col("errors") > 0.05, "DOWN").when(ok, "UP").otherwise("DEGRADED").alias("status"), F.round("recall", 6).alias("recall"), F.col("p95").cast("double").alias("p95"))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).agg(F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"), F.expr("percentile_disc(0.95) within group (order by latency_ms)").alias("p95"), F.avg(F.col("failed").cast("double")).alias("errors"))


_FIND = """(SELECT 1 AS rank, 'RECALL_LOW' AS code, recall < 0.6 AS fired FROM s UNION ALL SELECT 2, 'NDCG_LOW', ndcg < 0.5 FROM s UNION ALL SELECT 3, 'LATENCY_P95', p95 > 480 FROM s UNION ALL SELECT 4, 'ERRORS', errors > 0.001 FROM s)"""


@query(_CM + _STAT + f"SELECT rank, code FROM {_FIND} WHERE fired")
def h2_findings(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    each = [(1, "RECALL_LOW", c("recall") < 0.6), (2, "NDCG_LOW", c("ndcg") < 0.5), (3, "LATENCY_P95", c("p95") > 480), (4, "ERRORS", c("errors") > 0.001)]
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(n).alias("code"), f.alias("fired")) for r, n, f in each))).alias("f")
    return _stats(spark, d).select(rows).where("f.fired").select("f.rank", "f.code")


@query(_CM + _STAT + f"SELECT rank, code FROM (SELECT DISTINCT rank, code FROM {_FIND} WHERE fired) ORDER BY rank, code LIMIT 3")
def w18_top_findings(spark: SparkSession, d: str) -> DataFrame:
    return h2_findings(spark, d).distinct().orderBy("rank", "code").limit(3)


_HIT = "count(*) FILTER (k < 30) / count(*)"


@query(using("ev") + f"SELECT event_type, CASE WHEN count(*) >= 10 AND {_HIT} < 0.3 THEN 'PREFETCH_HIT_RATE' WHEN avg(value) > 50 THEN 'PAGING_DRIFT' ELSE 'NONE' END AS signal FROM ev GROUP BY 1")
def h3_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    g = v.events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.avg((F.col("k") < 30).cast("double")).alias("hit"), F.avg("value").alias("drift"))
    return g.select("event_type", F.when((F.col("n") >= 10) & (F.col("hit") < 0.3), "PREFETCH_HIT_RATE").when(F.col("drift") > 50, "PAGING_DRIFT").otherwise("NONE").alias("signal"))


@query(using("ev") + "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS p FROM ev) WHERE p IS DISTINCT FROM event_type")
def h4_state_changes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts_ms", "event_id")
    e = v.events(spark, d).withColumn("p", F.lag("event_type").over(w))
    return e.where(~F.col("p").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", "event_type")


_GATE = ", l AS (SELECT mode, avg(recall) AS recall, avg(ndcg) AS ndcg, avg(reciprocal_rank) AS mrr, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99 FROM m GROUP BY 1), g AS (SELECT a.recall - b.recall AS dr, a.ndcg - b.ndcg AS dn, a.mrr - b.mrr AS dm, a.p95 - b.p95 AS d95, a.p99 - b.p99 AS d99 FROM l a, l b WHERE a.mode = 'HYBRID_RERANK' AND b.mode = 'VECTOR_ONLY') "


def _gate(spark: SparkSession, d: str) -> DataFrame:
    pc = lambda p: F.expr(f"percentile_disc({p}) within group (order by latency_ms)")
    s = _metrics(spark, d).groupBy("mode").agg(F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"), F.avg("reciprocal_rank").alias("mrr"), pc(0.95).alias("p95"), pc(0.99).alias("p99"))
    of = lambda c, m: F.max(F.when(F.col("mode") == m, F.col(c)))
    diff = lambda c: of(c, "HYBRID_RERANK") - of(c, "VECTOR_ONLY")
    return s.agg(diff("recall").alias("dr"), diff("ndcg").alias("dn"), diff("mrr").alias("dm"), diff("p95").alias("d95"), diff("p99").alias("d99"))


@query(_CM + _GATE + "SELECT 'recall_delta' AS rule, dr >= 0.02 AS passed FROM g UNION ALL SELECT 'ndcg_delta', dn >= 0.01 FROM g UNION ALL SELECT 'mrr_delta', dm >= -0.005 FROM g UNION ALL SELECT 'p95_delta', d95 <= 250 FROM g UNION ALL SELECT 'p99_delta', d99 <= 500 FROM g")
def h8_reranker_gate(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return evaluate.rules(_gate(spark, d), {"recall_delta": c("dr") >= 0.02, "ndcg_delta": c("dn") >= 0.01, "mrr_delta": c("dm") >= -0.005, "p95_delta": c("d95") <= 250, "p99_delta": c("d99") <= 500})


@query(_CM + _STAT + "SELECT 'recall' AS rule, recall >= 0.5 AS passed FROM s UNION ALL SELECT 'ndcg', ndcg >= 0.4 FROM s UNION ALL SELECT 'errors', errors <= 0.02 FROM s")
def h6_learning_gate(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return evaluate.rules(_stats(spark, d), {"recall": c("recall") >= 0.5, "ndcg": c("ndcg") >= 0.4, "errors": c("errors") <= 0.02})


@query(_CM + ", got AS (SELECT mode, count(*) FILTER (all_expected) AS correct, count(*) AS total FROM m GROUP BY 1) SELECT coalesce(e.mode, g.mode) AS mode, e.least AS expected_total, g.total AS actual_total, e.least IS DISTINCT FROM g.total AS drift FROM (SELECT unnest(['VECTOR_ONLY', 'HYBRID', 'ORACLE']) AS mode, 1000 AS least) e FULL JOIN got g USING (mode)")
def h7_baseline_drift(spark: SparkSession, d: str) -> DataFrame:
    want = spark.createDataFrame([("VECTOR_ONLY", 1000), ("HYBRID", 1000), ("ORACLE", 1000)], "mode string, expected_total int")
    got = _metrics(spark, d).groupBy("mode").agg(F.count("*").alias("actual_total"))
    out = want.join(got, "mode", "full_outer")
    return out.withColumn("drift", ~F.col("expected_total").eqNullSafe(F.col("actual_total")))


@query(_CM + _GATE + "SELECT CASE WHEN dr > 0.02 THEN 'IMPROVES' WHEN dr < -0.02 THEN 'HARMS' WHEN abs(dn) > 0.01 THEN 'REORDERS' ELSE 'NEUTRAL' END AS assessment FROM g")
def h9_rerank_assessment(spark: SparkSession, d: str) -> DataFrame:
    return _gate(spark, d).select(F.when(F.col("dr") > 0.02, "IMPROVES").when(F.col("dr") < -0.02, "HARMS").when(F.abs("dn") > 0.01, "REORDERS").otherwise("NEUTRAL").alias("assessment"))


_SUST = """, b AS (SELECT user_id, ts_ms, event_id, value > 20 AS f FROM ev), r AS (SELECT *, count(*) FILTER (NOT f) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT user_id, run, min(ts_ms) AS since_ms, max(ts_ms) - min(ts_ms) AS held_ms FROM r WHERE f GROUP BY 1, 2 HAVING max(ts_ms) - min(ts_ms) >= 3600000"""


@query(using("ev").rstrip() + _SUST)
def h10_sustained_alerts(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.runs(v.events(spark, d), ["user_id"], [F.col("ts_ms"), F.col("event_id")], F.col("value") > 20).where("flag")
    g = r.groupBy("user_id", "run").agg(F.min("ts_ms").alias("since_ms"), (F.max("ts_ms") - F.min("ts_ms")).alias("held_ms"))
    return g.where("held_ms >= 3600000")
