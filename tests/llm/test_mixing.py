from tidemark.llm import mixing as m

TARGETS = "source string, target_share double, max_repeats int"


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_budgets_are_met(spark):
    rows = [(i, "big" if i % 4 else "small", 50 + i * 7 % 90) for i in range(4000)] + [(9000 + i, "other", 100) for i in range(500)]
    targets = spark.createDataFrame([("BIG ", 0.5, 3), ("small", 0.4, 4), ("none", 0.1, 2)], TARGETS)
    total = sum(r[2] for r in rows)
    got = {}
    for r in m.mix(sizes(spark, rows), targets).collect():
        assert 1 <= r.copies <= {"big": 3, "small": 4}[r.source]
        got[r.source] = got.get(r.source, 0) + r.copies * r.n_tokens
    assert set(got) == {"big", "small"}
    assert all(abs(got[s] - w * total) <= 140 for s, w in (("big", 0.5), ("small", 0.4)))


def test_short_sources_are_used_whole(spark):
    docs = spark.createDataFrame([(1, "one two three", "a", 1), (2, "x " * 400, " B", 1), (3, None, "a", 1), (4, "lost", None, 1)], "doc_id bigint, text string, source string, below int")
    targets = spark.createDataFrame([("a", 0.9, 2), ("b", 0.1, 1), (None, 0.5, 1)], TARGETS)
    r = {x.source: x for x in m.mix_report(docs, targets).collect()}
    assert r["a"].short and r["a"].reached_tokens == 2 * r["a"].available_tokens and r["a"].most_copies == 2
    assert not r["b"].short
    assert abs(sum(x.reached_share for x in r.values()) - 1) < 1e-5


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    r = m.mix_report(docs, targets).first()
    assert r.reached_tokens == 0 and not r.short
    assert m.mix_documents(docs, targets).count() == 0
    assert m.mix(sizes(spark, [(1, "a", 5)]), targets.limit(0)).count() == 0
