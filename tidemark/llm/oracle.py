"""Independent SQL for the problem queries that SQL can express."""

_BEST = """
SELECT grp, fragment_id, max(score) AS score FROM (
  SELECT lower(trim(namespace, ' ')) AS grp, fragment_id, score FROM recall_candidates
  WHERE namespace IS NOT NULL AND trim(namespace, ' ') <> '' AND fragment_id IS NOT NULL
    AND score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score)
) GROUP BY ALL
"""

_TOP = f"""
SELECT grp AS namespace, fragment_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, fragment_id) AS rank FROM ({_BEST})
) WHERE rank <= 5
"""

_GRAMS = r"""
terms AS (
  SELECT fragment_id AS id, any_value(lower(trim(namespace, ' '))) AS ns,
         regexp_extract_all(lower(any_value(content)), '[a-z0-9]+|[\x{4e00}-\x{9fff}]') AS t
  FROM memory_fragments
  WHERE fragment_id IS NOT NULL AND content IS NOT NULL AND trim(coalesce(namespace, ''), ' ') <> '' GROUP BY 1
),
grams AS (
  SELECT DISTINCT id, ns, concat(t[i], ' ', t[i + 1]) AS g
  FROM (SELECT id, ns, t, unnest(range(1, len(t))) AS i FROM terms WHERE len(t) > 1)
),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY 1)
"""

_TOKENS = r"len(regexp_extract_all(content, '[\x{4e00}-\x{9fff}]|[^ \t\n\r\x{4e00}-\x{9fff}]+'))"

ORACLE: dict[str, str] = {
    "p1_found": f"SELECT namespace, fragment_id FROM ({_TOP})",
    "p1_top_fragments": _TOP,
    "p2_found": f"""
WITH {_GRAMS},
common AS (
  SELECT a.id AS x, b.id AS y, count(*) AS k FROM grams a JOIN grams b ON a.ns = b.ns AND a.g = b.g AND a.id < b.id GROUP BY 1, 2
)
SELECT x AS fragment_a, y AS fragment_b FROM common JOIN sizes s ON s.id = x JOIN sizes u ON u.id = y
WHERE k >= 0.6 * (s.n + u.n - k) - 1e-9""",
    "p3_found": f"""
SELECT DISTINCT 'store_request' AS record_kind, request_id AS record_id FROM store_requests WHERE request_id IS NOT NULL AND {_TOKENS} > 512
UNION ALL
SELECT DISTINCT 'fragment', fragment_id FROM memory_fragments WHERE fragment_id IS NOT NULL AND {_TOKENS} > 512""",
}

_NEAR = """
WITH v AS (
  SELECT fragment_id AS id, any_value(lower(trim(namespace, ' '))) AS ns, any_value(embedding)::DOUBLE[] AS e
  FROM warm_vectors
  WHERE fragment_id IS NOT NULL AND trim(coalesce(namespace, ''), ' ') <> '' AND len(embedding) = 128
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY 1
),
near AS (
  SELECT a.id, b.id AS neighbour, round(list_cosine_similarity(a.e, b.e), 6) AS cosine
  FROM v a JOIN v b ON a.ns = b.ns AND a.id <> b.id
),
top AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour) AS rank FROM near
)
"""
ORACLE["p4_found"] = f"{_NEAR} SELECT DISTINCT least(id, neighbour) AS fragment_a, greatest(id, neighbour) AS fragment_b FROM top WHERE rank <= 5"
ORACLE["p4_neighbours"] = f"{_NEAR} SELECT id, neighbour, cosine, rank FROM top WHERE rank <= 5"
ORACLE["p2_groups"] = f"""
WITH RECURSIVE pairs AS ({ORACLE["p2_found"]}),
{_GRAMS},
classes AS (SELECT id, md5(concat(any_value(ns), chr(0), string_agg(g, chr(1) ORDER BY g))) AS cls FROM grams GROUP BY 1),
edges AS (SELECT fragment_a AS a, fragment_b AS b FROM pairs UNION SELECT fragment_b, fragment_a FROM pairs),
reach AS (SELECT id, id AS other FROM classes UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
links AS (SELECT a AS id, count(DISTINCT y.cls) AS n FROM edges JOIN classes x ON x.id = a JOIN classes y ON y.id = b WHERE x.cls <> y.cls GROUP BY 1)
SELECT r.id AS fragment_id, min(other) AS group_id, coalesce(any_value(n), 0) AS n_links FROM reach r LEFT JOIN links l ON l.id = r.id GROUP BY 1"""
