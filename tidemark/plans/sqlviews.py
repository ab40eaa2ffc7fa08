"""The canonical tables in SQL, as common table expressions."""

from tidemark.plans.views import MODES, NOW_MS

_MODE_LIST = ", ".join(f"'{m}'" for m in MODES)
NOW = str(NOW_MS)
#: One id in twenty, as in ``views.asks``.
ASKS = "('0x' || substr(md5({0}), 1, 6))::INT % 20 = 0"

DEFINITIONS: dict[str, tuple[list[str], str]] = {
    "vec": ([], """SELECT fragment_id AS id, any_value(embedding) AS embedding FROM warm_vectors
      WHERE fragment_id IS NOT NULL AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1"""),
    "fragments": ([], r"""SELECT * EXCLUDE (v), len(regexp_extract_all(content, '\S+')) AS token_count,
        CASE WHEN id < '6' THEN 'L1' WHEN id < 'd' THEN 'L2' ELSE 'L3' END AS tier FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_access_ms DESC NULLS LAST, ingested_ms DESC NULLS LAST, pinned_until_ms DESC NULLS LAST, reasoning_chain_id DESC NULLS LAST) AS v FROM (
        SELECT fragment_id AS id, lower(trim(namespace, ' ')) AS namespace, coalesce(content, '') AS content, least(1.0, coalesce(importance, 0.5)) AS importance,
          last_access_time AS last_access_ms, epoch_us(created_at) // 1000 AS created_ms,
          list_filter(list_transform(coalesce(tags, []), lambda t: trim(t, ' ')), lambda t: t IS NOT NULL AND t <> '') AS raw_tags,
          reasoning_chain_id, pinned_until AS pinned_until_ms, epoch_us(ingested_at) // 1000 AS ingested_ms
        FROM memory_fragments WHERE fragment_id IS NOT NULL AND trim(coalesce(namespace, ''), ' ') <> '')) WHERE v = 1"""),
    "candidates": ([], """SELECT candidate_id, any_value(recall_id) AS recall_id, any_value(lower(trim(namespace, ' '))) AS namespace, any_value(fragment_id) AS fragment_id,
        any_value(score) AS semantic, coalesce(any_value(tier), 'L2') AS tier, any_value(epoch_us(recalled_at) // 1000) AS recalled_ms,
        CASE WHEN candidate_id % 4 <> 0 THEN (candidate_id * 37 % 101) / 20.0 END::DOUBLE AS keyword, candidate_id % 5 = 0 AS relevant
      FROM recall_candidates WHERE fragment_id IS NOT NULL AND trim(coalesce(namespace, ''), ' ') <> '' AND score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) GROUP BY 1"""),
    "pool": (["fragments", "candidates"], """SELECT c.*, f.importance, f.raw_tags, f.token_count, f.last_access_ms FROM (
        SELECT *, row_number() OVER (PARTITION BY recall_id, fragment_id ORDER BY semantic DESC, candidate_id) AS v FROM candidates) c JOIN fragments f ON f.id = c.fragment_id WHERE v = 1"""),
    "scored_pool": (["pool", "vec"], f"""SELECT p.*, 1 / (1 + ln(1 + greatest(0, ({NOW} - last_access_ms) / 86400000.0::DOUBLE))) AS recency,
        CASE WHEN s.sim IS NULL OR s.sim < 0.95 THEN 0 ELSE least(0.25::DOUBLE, s.sim - 0.95::DOUBLE) END AS penalty,
        CASE WHEN s.sim IS NULL THEN 0 ELSE least(0.15::DOUBLE, greatest(0, 1 - s.sim) * 0.15::DOUBLE) END AS novelty FROM pool p LEFT JOIN (
        SELECT a.candidate_id, max(round(CASE WHEN x.embedding IS NULL OR y.embedding IS NULL THEN 0 ELSE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) END, 9)) AS sim
        FROM pool a JOIN pool b ON a.recall_id = b.recall_id AND a.candidate_id <> b.candidate_id LEFT JOIN vec x ON x.id = a.fragment_id LEFT JOIN vec y ON y.id = b.fragment_id GROUP BY 1) s USING (candidate_id)"""),
    "ev": ([], "SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"),
    "log": (["ev"], """SELECT concat('t', user_id) AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS seq, CAST(event_id AS VARCHAR) AS entry_id,
        CASE event_type WHEN 'view' THEN 'UPDATE_CONTEXT' WHEN 'click' THEN 'START_TOOL_EXECUTION' WHEN 'purchase' THEN 'COMPLETE_TOOL_EXECUTION' WHEN 'error' THEN 'FAIL_TOOL_EXECUTION' ELSE 'SET_STATUS' END AS operation, k, value, ts_ms FROM ev"""),
    "wal": (["log"], "SELECT * FROM log UNION ALL SELECT * FROM log WHERE CAST(entry_id AS BIGINT) % 10 = 0"),
    "nodes": ([], "SELECT p_partkey // 50 AS task_id, p_partkey % 50 + 1 AS node, p_name AS content, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS BIGINT) END AS executed_at, CAST(p_size % 4 AS BIGINT) AS branch FROM part"),
    "edges": (["nodes"], "SELECT DISTINCT a.task_id, a.node AS src, b.node AS dst FROM nodes a JOIN nodes b ON a.task_id = b.task_id AND b.node IN (2 * a.node, 2 * a.node + 1, a.node + 3)"),
    "node_pages": (["nodes"], """SELECT task_id, node, page, CASE (task_id * 7 + page) % 4 WHEN 0 THEN 'RESIDENT' WHEN 1 THEN 'FAULTING' ELSE 'EVICTED' END AS state, (task_id * 31 + page * 17) % 100 AS access_count
        FROM (SELECT task_id, node, unnest(CASE WHEN node % 5 = 0 THEN [node // 4, node // 4 + 1] ELSE [node // 4] END) AS page FROM nodes)"""),
    "lookahead": (["edges", "node_pages"], """SELECT task_id, start, page FROM (SELECT *, row_number() OVER (PARTITION BY task_id, start ORDER BY access_count DESC, page) AS r FROM (SELECT DISTINCT h.task_id, h.start, p.page, p.access_count FROM (
        SELECT task_id, src AS start, dst AS node FROM edges UNION SELECT a.task_id, a.src, b.dst FROM edges a JOIN edges b ON a.task_id = b.task_id AND a.dst = b.src) h JOIN node_pages p USING (task_id, node) WHERE p.state = 'EVICTED' AND h.node <> h.start)) WHERE r <= 3"""),
    "closure": (["edges"], "SELECT task_id, src, dst FROM edges UNION SELECT c.task_id, c.src, e.dst FROM closure c JOIN edges e ON e.task_id = c.task_id AND e.src = c.dst"),
    "checkpoints": ([], """SELECT task_id, n AS checkpoint_id, created_ms, size, kind, CASE WHEN kind = 'DELTA' THEN lag(n) OVER (PARTITION BY task_id ORDER BY created_ms, n) END AS base_id FROM (
        SELECT o_custkey AS task_id, o_orderkey AS n, epoch_us(o_orderdate) // 1000 AS created_ms, o_totalprice AS size,
          CASE WHEN o_orderkey % 7 = 0 OR row_number() OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) // 1000, o_orderkey) = 1 THEN 'FULL' ELSE 'DELTA' END AS kind FROM orders)"""),
    "pages": (["fragments"], "SELECT concat(namespace, '-', substr(id, 1, 1)) AS page_id, namespace, id, last_access_ms, token_count, CASE WHEN substr(id, 1, 1) IN ('0', '1', '2', '3', '4') THEN 'RESIDENT' ELSE 'EVICTED' END AS state FROM fragments"),
    "case_results": (["pool"], f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, mode ORDER BY score DESC, fragment_id) AS rank FROM (
        SELECT recall_id AS case_id, fragment_id, relevant, m AS mode, round(CASE m WHEN 'KEYWORD_ONLY' THEN coalesce(keyword, 0) WHEN 'VECTOR_ONLY' THEN semantic WHEN 'VECTOR_RERANK' THEN 0.8::DOUBLE * semantic + 0.2::DOUBLE * importance
          WHEN 'HYBRID' THEN semantic + coalesce(keyword, 0) ELSE 0.6::DOUBLE * semantic + 0.1::DOUBLE * coalesce(keyword, 0) + 0.3::DOUBLE * importance END, 9) AS score
        FROM pool, (SELECT unnest([{_MODE_LIST}]) AS m))) WHERE rank <= 10"""),
    "case_modes": (["case_results"], f"""SELECT c.*, w.n_expected, (c.case_id * 37 + list_position([{_MODE_LIST}], mode) * 113) % 500 AS latency_ms, concat('cat', c.case_id % 6) AS category, c.case_id % 97 = 0 AS failed FROM (
        SELECT case_id, mode, count(*) FILTER (relevant AND rank <= 5) AS matched, min(rank) FILTER (relevant AND rank <= 5) AS first_rank,
          coalesce(sum(1 / log2(rank + 1)) FILTER (relevant AND rank <= 5), 0) AS dcg, count(*) AS n_returned FROM case_results GROUP BY 1, 2) c
      JOIN (SELECT recall_id AS case_id, count(*) FILTER (relevant) AS n_expected FROM pool GROUP BY 1) w USING (case_id)"""),
}


def using(*names: str) -> str:
    """``WITH`` clause that defines these views and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in DEFINITIONS[n][0]:
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({DEFINITIONS[n][1]})" for n in order) + "\n"
