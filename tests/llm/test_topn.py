import math

from tidemark.llm.topn import top_fragments

SCHEMA = "candidate_id bigint, namespace string, fragment_id string, score double, rank string"


def run(spark, rows, n=2):
    return sorted((r.namespace, r.rank, r.fragment_id, r.score) for r in top_fragments(spark.createDataFrame(rows, SCHEMA), n).collect())


def test_best_score_ties_and_spelling(spark):
    rows = [(1, " A ", "f1", 0.5, "x"), (2, "a", "f1", 0.9, "x"), (3, "a", "f2", 0.9, "x"), (4, "A", "f0", 0.9, "x"), (5, "b", "f1", 0.1, None), (5, "b", "f1", 0.1, None)]
    assert run(spark, rows) == [("a", 1, "f0", 0.9), ("a", 2, "f1", 0.9), ("b", 1, "f1", 0.1)]


def test_dirty_rows_take_no_part(spark):
    rows = [(1, None, "f", 1.0, ""), (2, "  ", "f", 1.0, ""), (3, "a", None, 1.0, ""), (4, "a", "f", None, ""), (5, "a", "f", math.nan, ""), (6, "a", "f", math.inf, ""), (7, "a", "g", -0.0, ""), (8, "a", "h", 0.0, "")]
    assert [r[2] for r in run(spark, rows)] == ["g", "h"]


def test_empty(spark):
    assert run(spark, []) == []


def test_group_limit_prunes_before_the_shuffle(spark):
    df = top_fragments(spark.createDataFrame([(1, "a", "f", 1.0, "")], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
