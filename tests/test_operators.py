import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.engine import HYBRID, KEYWORD_ONLY, Engine
from tidemark.functions import judge, models, scalar, text
from tidemark.operators import evaluate, eviction, graph, learning, log, prompts, recall, stores, ordering
from tidemark.sources import readers, writers


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_scalar_rules(spark):
    day = 86_400_000
    r = one(
        spark, **{f"r{d}": scalar.recency(F.lit(0), F.lit(d * day)) for d in (0, 1, 2, 14)}, **{f"p{i}": scalar.redundancy_penalty(F.lit(s)) for i, s in enumerate((0.90, 0.97, 1.0))},
        **{f"n{i}": scalar.novelty_bonus(F.lit(s)) for i, s in enumerate((0.90, 0.97, 1.0))}, up=scalar.reinforced(F.lit(0.5)), same=scalar.cosine(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(4.0))),
        odd=scalar.cosine(F.array(F.lit(1.0)), F.array(F.lit(2.0), F.lit(4.0))), nought=scalar.cosine(F.array(F.lit(0.0)), F.array(F.lit(0.0))), none=scalar.cosine(F.lit(None).cast("array<double>"), F.array(F.lit(1.0))))
    assert [round(r[f"r{d}"], 6) for d in (0, 1, 2, 14)] == [1, 0.590616, 0.476505, 0.269684]
    assert [round(r[f"p{i}"], 6) for i in range(3)] == [0, 0.02, 0.05] and [round(r[f"n{i}"], 6) for i in range(3)] == [0.015, 0.0045, 0]
    assert round(r.up, 9) == 0.575 and round(r.same, 9) == 1 and r.odd == r.nought == r.none == 0


def test_quota(spark):
    used = eviction.usage(spark.createDataFrame([("a", 40), ("b", 20), ("b", 20), (None, 9)], "ns string, t int"), "ns", "t")
    q = eviction.quotas(used, 120).first()
    assert (q.hard, q.soft, q.protected, q.reclaimable, q.borrow_capacity) == (30, 18, 60, 20, 60)


def test_regret_window(spark):
    e = spark.createDataFrame([("u", 1, 1000)], "k string, id int, evict_ms bigint")
    hit = lambda t, w: eviction.regrets(e, spark.createDataFrame([("u", t)], "k string, recall_ms bigint"), "k", w).count()
    assert [hit(1000, 500), hit(1500, 500), hit(1501, 500), hit(999, 500), hit(1500, 100)] == [1, 1, 0, 0, 0]


def test_rerank_statuses(spark):
    def effect(rows):
        df = spark.createDataFrame([("q", *r) for r in rows], "q string, id string, semantic double, keyword double, importance double, tags array<string>")
        f = recall.fused(df, "q", recall.tag_profile(F.col("tags")))
        f = recall.ranked(recall.ranked(f, "q", F.col("fused"), "id", "a"), "q", F.col("semantic"), "id", "b")
        g = f.groupBy("q").agg(F.sum((F.col("a") != F.col("b")).cast("int")).alias("c"), F.countDistinct("fused").alias("n"))
        order = [r.id for r in f.orderBy("a").collect()]
        return order, g.select("c", recall.rerank_effect(F.col("c"), F.col("n")).alias("s")).first()

    order, r = effect([("x", 0.90, 0.0, 0.0, []), ("y", 0.89, 0.0, 1.0, [])])
    assert order == ["y", "x"] and r.c == 2 and r.s == "ORDER_CHANGED"
    order, r = effect([("x", 0.9, 0.0, 1.0, []), ("y", 0.1, 0.0, 0.0, [])])
    assert order == ["x", "y"] and r.s == "IDENTIFIABLE"
    order, _ = effect([("x", 0.90, 0.0, 0.0, ["category-temporal-reasoning"]), ("y", 0.5, 1.0, 1.0, ["category-temporal-reasoning"])])
    assert order == ["x", "y"]


def test_budget_skips_and_goes_on(spark):
    rows = [("q", 1, "a", 60), ("q", 2, "b", 60), ("q", 3, "c", 40), ("q", 4, "c", 1), ("q", 5, "d", 1)]
    out = recall.within_budget(spark.createDataFrame(rows, "q string, rank int, id string, t int"), "q", "rank", "id", "t", k=3, budget=101).collect()
    assert [(r.id, r.place, r.used) for r in sorted(out, key=lambda r: r.place)] == [("a", 1, 60), ("c", 2, 100), ("d", 3, 101)]


def test_keyword_search(spark):
    docs = [("t", "n", "Pegasus release is owned by avery"), ("o", "n", "weather tomorrow")]
    d = spark.createDataFrame(docs, "id string, namespace string, c string").select("id", "namespace", text.keywords(F.col("c")).alias("tokens"))
    q = spark.createDataFrame([("q", "n", "Who owns Pegasus release?")], "query_id string, namespace string, c string").select("query_id", "namespace", text.keywords(F.col("c")).alias("tokens"))
    r = recall.keyword_scores(d, q).collect()
    assert [x.id for x in r] == ["t"] and r[0].matched == 2 and abs(r[0].score - (2 * math.log(3) + 0.5)) < 1e-9


@pytest.mark.parametrize("block", [4096, 70, 7])
def test_keyword_search_blocks_change_nothing(spark, block):
    """Every common term is counted, whatever the blocks; only rows by query and document leave their tasks."""
    import random
    from collections import Counter

    r = random.Random(3)
    rows = [(f"d{i:03d}", "large" if i < 150 else f"p{i % 20}" if i % 9 else None, sorted({f"t{int(r.paretovariate(0.7)) % 90}" for _ in range(r.randint(0, 12))})) for i in range(260)]
    docs = spark.createDataFrame(rows, "id string, namespace string, tokens array<string>")
    asks = [(f"q{i}", r.choice(["large", "p3", "p4", "none", None]), [*{f"t{r.randint(0, 30)}" for _ in range(r.randint(0, 9))}, "nowhere"]) for i in range(40)]
    q = spark.createDataFrame(asks, "query_id string, namespace string, tokens array<string>")
    n = Counter(g for _, g, _ in rows)
    df = Counter((g, t) for _, g, ts in rows for t in ts)
    want = {(a, i): (len(both), sum(math.log(1 + n[g] / df[g, t]) for t in both) + len(both) / len(ts)) for a, g, ts in asks if g for i, h, us in rows if h == g and (both := set(ts) & set(us))}
    out = recall.keyword_scores(docs, q, block=block)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_g") and "hashpartitioning(query_id#" not in plan.split("MapInArrow")[0]
    got = {(x.query_id, x.id): (x.matched, x.score) for x in out.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert {x.query_id: x.hits for x in recall.keyword_hits(docs, q, block=block).collect()} == Counter(a for a, _ in want)


def test_edge_validation_broadcasts_nothing(spark):
    nodes = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)], "task_id bigint, node bigint")
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "task_id bigint, src bigint, dst bigint")
    want = [(1, 1, 2, "DUPLICATE"), (1, 3, 1, "CYCLE"), (1, 2, 2, "CYCLE"), (1, 1, 3, "OK"), (1, 1, 9, "UNKNOWN_NODE"), (2, 2, 1, "OK"), (3, 1, 2, "UNKNOWN_NODE"), (1, 1, None, "UNKNOWN_NODE"), (None, 1, 2, "UNKNOWN_NODE")]
    out = graph.valid_edges(spark.createDataFrame([w[:3] for w in want], "task_id bigint, src bigint, dst bigint"), nodes, edges)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan


def test_texts(spark):
    r = one(spark, p=text.split_text(F.lit("First paragraph.\n\nSecond paragraph.\n\nThird paragraph.")), s=text.packed(F.array(*map(F.lit, ["a b.", "c d.", "e f g h i j."])), 4), u=text.units(F.lit("- one. Two!\n2) three\n\n  ")), z=text.word_count(F.lit(" \n")))
    assert len(r.p) == 3 and r.s == ["a b. c d.", "e f g h i j."] and r.u == ["one.", "Two!", "three"] and r.z == 0


def test_metrics(spark):
    m = evaluate.metrics(spark.createDataFrame([(1, 1, 1, 1.0), (0, 0, None, 0.0), (1, 1, 2, 1 / math.log2(3))], "matched int, n_expected int, first_rank int, dcg double"), 5).collect()
    assert (m[0].recall, m[0].precision, m[0].ndcg) == (1, 0.2, 1) and m[1].recall == m[1].ndcg == 0 and not m[1].all_expected
    assert round(m[2].ndcg, 6) == 0.63093


def test_rolling_percentile(spark):
    df = spark.range(1, 601).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    r = evaluate.rolling(df, ["k"], [F.col("v").desc()], "v").first()
    assert (r.samples, r.p95, r.p99) == (512, 575, 595)


def test_bootstrap(spark):
    df = spark.range(400).select("id", ((F.col("id") % 3) - 1).cast("double").alias("v"))
    r = evaluate.bootstrap_interval(df, "v", "id", 500).first()
    assert r.low < r.mean < r.high and abs((r.high - r.low) - 2 * 1.96 * 0.8165 / 20) < 0.04


def test_largest_remainder(spark):
    q = evaluate.largest_remainder(spark.createDataFrame([("a", 5), ("b", 3), ("c", 3)], "k string, n int"), "k", "n", 10, "s").collect()
    assert sum(r.quota for r in q) == 10 and {r.k: r.quota for r in q}["a"] in (4, 5)


def test_group_release(spark):
    f = spark.createDataFrame([("n", "tiny", 1, 0.1 * 0.2), ("n", "large", 100, 0.2 * 0.2)], "namespace string, id string, token_count int, score double")
    out = eviction.until_target(eviction.group_totals(f, F.col("id")), ["namespace"], [F.col("density")], "group_tokens", 50).collect()
    assert [r.grp for r in out] == ["large"]
    three = spark.createDataFrame([("n", i, 5, 0.1) for i in range(3)], "namespace string, id int, token_count int, score double")
    assert eviction.until_target(eviction.group_totals(three, F.col("id")), ["namespace"], [F.col("grp")], "group_tokens", 10).count() == 2
    held = eviction.evict_with_floor(eviction.group_totals(three, F.col("id").cast("string")), 15, 6)
    assert held.count() == 1


def test_admissions(spark):
    rows = [("k", 1, 60, True), ("k", 2, 30, False), ("k", 3, 50, False), ("k", 4, 30, False)]
    out = {r.seq: r for r in eviction.admissions(spark.createDataFrame(rows, "key string, seq bigint, tokens bigint, pinned boolean"), 100, 100).collect()}
    assert out[3].decision == "REJECTED" and out[4].decision == "ADMITTED_AFTER_RECLAIM" and out[4].evicted == 30


def test_peers_in_blocks(spark):
    import random

    r = random.Random(1)
    rows = [(f"i{k}", "g", [r.gauss(0, 1) for _ in range(4)]) for k in range(60)] + [("alone", "h", [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, namespace string, embedding array<double>")
    a, b = ({x.id: x.sim and round(x.sim, 9) for x in recall.nearest_peer(df, block=n).collect()} for n in (1000, 13))
    assert a == b and a["alone"] is None
    c, e = ({(x.id, x.peer, x.place) for x in recall.peer_groups(df, 3, block=n).collect()} for n in (1000, 13))
    assert c == e and len(c) == 180
    f = df.withColumn("fresh", F.col("id") >= "i4")
    up = recall.add_peers(recall.nearest_peer(f.where("not fresh")), f, "fresh")
    assert {x.id: x.sim and round(x.sim, 9) for x in up.collect()} == a


def test_vector_search_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(7).normal(size=(90, 4))
    ids = [f"i{k:02d}" for k in range(90)]
    df = spark.createDataFrame([(i, "g" if k < 70 else "h", v.tolist()) for k, (i, v) in enumerate(zip(ids, x))], "id string, namespace string, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in recall.vector_search(df, df.where("substr(id, 3) in ('0', '5')"), 3, block=7).collect()}
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    want = {}
    for k in range(0, 90, 5):
        own = range(70) if k < 70 else range(70, 90)
        for place, j in enumerate(sorted(own, key=lambda j: (-round(float(u[k] @ u[j]), 6), j))[:3]):
            want[ids[k], place + 1] = ids[j]
    assert got == want


def test_graphs(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 3), (2, 1, 2), (2, 2, 1)], "task_id bigint, src bigint, dst bigint")
    n = spark.createDataFrame([(1, k) for k in (1, 2, 3)] + [(2, 1), (2, 2)], "task_id bigint, node bigint")
    assert [r.task_id for r in graph.cyclic(e).collect()] == [2]
    assert sorted(map(tuple, graph.levels(n, e).collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    assert graph.closure(e.limit(0)).count() == 0
    left, kept = graph.without_nodes(n, e, n.where("node = 2"))
    assert left.count() == 3 and [tuple(r) for r in kept.select("src", "dst").collect()] == [(1, 3)]


def test_pages(spark):
    rows = [(f"i{k}", "g", k, [1.0, 0.01 * k, 0.0] if k % 2 else [0.0, 0.01 * k, 1.0]) for k in range(20)]
    df = spark.createDataFrame(rows, "id string, namespace string, t int, embedding array<double>")
    for pages in (graph.cosine_pages(df, "namespace"), graph.incremental_pages(df, "namespace", "t")):
        of = {r.id: r.page_id for r in pages.collect()}
        assert len(of) == 20 and not {of[f"i{k}"] for k in range(0, 20, 2)} & {of[f"i{k}"] for k in range(1, 20, 2)}


def test_incremental_pages_beyond_a_block_equal_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(5)
    x = r.normal(size=(150, 4))[r.integers(0, 150, 6000)] + 0.2 * r.normal(size=(6000, 4))
    df = spark.createDataFrame([(f"i{k:04d}", "g", k * 7919 % 6000 // 2 if k % 50 else None, v.tolist()) for k, v in enumerate(x)], "id string, namespace string, t int, embedding array<double>")
    of = {row.id: row.page_id for row in graph.incremental_pages(df, "namespace", "t").collect()}
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    centre, held, want = np.zeros((0, 4)), [], {}
    for k in sorted(range(6000), key=lambda k: (k % 50 == 0, k * 7919 % 6000 // 2 if k % 50 else 0, k)):
        far = np.where(np.array(held) < 10, 1 - centre @ u[k], np.inf) if held else np.array([np.inf])
        at = int(far.argmin())
        if far[at] > 0.30:
            at, centre = len(held), np.vstack([centre, u[k]])
            held.append(1)
        else:
            m = (centre[at] * held[at] + u[k]) / (held[at] + 1)
            centre[at], held[at] = m / np.sqrt(m @ m), held[at] + 1
        want[f"i{k:04d}"] = at
    assert len(of) == 6000 and {i: int(p.rpartition("-i")[2]) for i, p in of.items()} == want


def test_cosine_pages_beyond_a_block_equal_brute_force(spark):
    import numpy as np

    n = 21_000
    x = np.random.default_rng(6).normal(size=(n, 3))
    df = spark.createDataFrame([(f"i{k:05d}", "g", v.tolist()) for k, v in enumerate(x)], "id string, namespace string, embedding array<double>")
    of = {row.id: int(row.page_id.rpartition("-p")[2]) for row in graph.cosine_pages(df, "namespace", size=50, rounds=3).collect()}
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    seeds, near = [0], u @ u[0]
    while len(seeds) < n // 50:
        seeds.append(int(near.argmin()))
        near = np.maximum(near, u @ u[seeds[-1]])
    c = u[seeds]
    for _ in range(3):
        own = (u @ c.T).argmax(1)
        mean = np.array([u[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        mean /= np.sqrt((mean * mean).sum(1, keepdims=True))
        settled = (1 - (mean * c).sum(1)).max() <= 1e-3
        c = mean
        if settled:
            break
    want = (u @ c.T).argmax(1)
    assert len(of) == n and len(set(of.values())) == len(set(want.tolist()))
    assert sum(of[f"i{k:05d}"] == w for k, w in enumerate(want)) >= 0.999 * n


LOG = "task_id string, seq bigint, entry_id string, operation string, payload map<string,string>, ts_ms bigint"


def replayed(spark, *ops):
    rows = [("t", i, f"e{i}", op, p, i * 1000) for i, (op, p) in enumerate(ops, 1)]
    df = spark.createDataFrame(rows, LOG)
    a, b = log.replay(df).first(), log.replay(df.unionByName(df).orderBy(F.col("seq").desc())).first()
    assert a == b
    return a


def node(i, **more):
    return "APPEND_NODE", {"nodeId": i, "type": "thought", **more}


def test_replay_of_values_and_lifecycles(spark):
    r = replayed(
        spark, ("UPDATE_CONTEXT", {"key": "k", "value": "v"}), ("START_TOOL_EXECUTION", {"executionId": "x"}), ("UPDATE_CONTEXT", {"key": "k", "value": ""}), ("COMPLETE_TOOL_EXECUTION", {"executionId": "x"}),
        ("START_LLM_CALL", {"callId": "l"}), ("TIMEOUT_LLM_CALL", {"callId": "l"}), ("MARK_LLM_CALL_RETRY", {"callId": "l"}), ("APPEND_CONVERSATION_MESSAGE", {"conversationId": "c", "content": "hi"}), ("SET_STATUS", {"status": "COMPLETED"}),
    )
    assert (json.loads(r.context), json.loads(r.tools), json.loads(r.calls), json.loads(r.conversations)) == ({}, {"x": "SUCCEEDED"}, {"l": "RETRY_PENDING 2 retryable"}, {"c": 1})
    assert (r.applied, r.last_seq, r.status, r.finalization, r.error) == (9, 9, "COMPLETED", "PENDING_FINALIZATION", None)
    assert replayed(spark, ("SET_STATUS", {"status": "RECOVERING"})).status == "RUNNING"


def test_replay_of_nodes_and_edges(spark):
    r = replayed(spark, node("a"), node("b", targetNodeId="a", edgeType="DATA"), node("c", targetNodeId="b", edgeType="DATA"), ("ADD_EDGE", {"sourceNodeId": "a", "targetNodeId": "c", "dependencyType": "DATA"}), ("COMPLETE_NODE", {"nodeId": "a", "result": "r"}), ("DELETE_NODE", {"nodeId": "c"}))
    assert (json.loads(r.nodes), json.loads(r.edges), r.current_node) == ({"a": "COMPLETED", "b": "PENDING"}, ["a>b DATA"], "b")


@pytest.mark.parametrize(
    "op, payload, error",
    [
        ("COMPLETE_NODE", {"nodeId": "z"}, "UNKNOWN_NODE"), ("ADD_EDGE", {"sourceNodeId": "b", "targetNodeId": "a", "dependencyType": "DATA"}, "CYCLE"), ("APPEND_NODE", {"nodeId": "c", "targetNodeId": "z", "edgeType": "DATA"}, "UNKNOWN_NODE"),
        ("FAIL_TOOL_EXECUTION", {"executionId": "x"}, "UNKNOWN_EXECUTION"), ("COMPLETE_LLM_CALL", {"callId": "l"}, "UNKNOWN_CALL"), ("DELETE_TASK", {}, "TASK_DELETED"), ("SET_STATUS", None, "NO_PAYLOAD"),
        ("SWITCH_BRANCH", {"branchId": "q"}, "NO_ACTIVE_BRANCH"), ("CREATE_BRANCH", {"sourceNodeId": "z"}, "UNKNOWN_NODE"), ("SOMETHING", {"a": "b"}, "UNKNOWN_OPERATION"),
    ],
)
def test_a_refused_entry_ends_the_replay(spark, op, payload, error):
    r = replayed(spark, node("a"), node("b", targetNodeId="a", edgeType="DATA"), (op, payload), ("UPDATE_CONTEXT", {"key": "k", "value": "v"}))
    assert (r.error, r.error_seq, r.applied, json.loads(r.context), json.loads(r.nodes), json.loads(r.edges)) == (error, 3, 2, {}, {"a": "PENDING", "b": "PENDING"}, ["a>b DATA"])


def test_replay_of_branches(spark):
    create = lambda b: ("CREATE_BRANCH", {"branchId": b, "branchName": b, "sourceNodeId": "a", "forkNodeId": f"f{b}"})
    r = replayed(spark, node("a"), create("x"), node("n", branchId="x"), create("y"), ("SWITCH_BRANCH", {"branchId": "x"}))
    assert (json.loads(r.branches), r.current_branch, r.current_node) == ({"x": "ACTIVE", "y": "ACTIVE"}, "x", "n")
    r = replayed(spark, node("a"), create("x"), create("y"), ("MERGE_BRANCH", {"sourceBranchId": "y", "targetBranchId": "x"}), ("ABANDON_BRANCH", {"branchId": "x"}))
    assert (json.loads(r.branches), r.current_branch) == ({"x": "ABANDONED", "y": "MERGED"}, "x")
    r = replayed(spark, node("a"), *(create(f"b{i}") for i in range(11)))
    assert (r.error, r.error_seq, len(json.loads(r.branches))) == ("TOO_MANY_BRANCHES", 12, 10)


def test_full_equals_full_and_deltas(spark):
    full = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, "c", False), (1, None, True), (3, "d", False)], "k int, v string, deleted boolean")
    assert sorted(map(tuple, log.apply_delta(full, delta, ["k"]).collect())) == [(2, "c"), (3, "d")]


def test_executions_expire(spark):
    df = spark.createDataFrame([("k", "h", 0, 1), ("k", "h", 5, 2), ("k", "g", 9, 3), ("k", "g", 10, 4)], "key string, hash string, ts_ms bigint, n bigint")
    assert [r.outcome for r in sorted(log.executions(df, 10).collect(), key=lambda r: r.n)] == ["NEW", "REPLAY", "CONFLICT", "NEW"]


def test_learning(spark):
    a = learning.arms(spark)
    assert a.count() == 36 and a.where("abs(alpha + beta + gamma - 1) > 1e-9").count() == 0
    w = learning.simplex(2.0, 0.0, 0.0)
    assert abs(sum(w) - 1) < 1e-9 and min(w) >= 0.05 - 1e-9
    rows = [("s", i, i, i % 4, 1.0 if i % 4 == 2 else 0.0) for i in range(600)]
    r = learning.exp3(spark.createDataFrame(rows, "scenario string, n bigint, ts_ms bigint, arm bigint, reward double"), 4).first()
    assert r.best_arm == 2 and r.recalls == 600


@pytest.mark.parametrize(
    "answer, want",
    [
        ("The current color is blue.", "correct"), ("It is green, the color is blue", "hallucinated_forbidden_fact"), ("The color is blue, not green.", "correct"), ("Green is outdated; the color is blue", "correct"),
        ("I cannot determine the color", "insufficient_answer"), ("It is red", "answer_missing_fact"), ("", "answer_missing_fact"), (None, "answer_missing_fact"), ("No longer green, now blue", "correct"),
    ],
)
def test_judge(answer, want):
    assert judge.verdict("blue", ["blue"], ["green"], answer) == want


def test_judge_ranges():
    assert judge.mentions("monday from 09:00 to 10:00 utc", "call on monday 09:00 until 10:00 utc")
    assert judge.mentions("bullet points", "use bullet-point lists") and not judge.mentions("", "x")
    assert judge.mentions("port 8080", "on port 8080.") and not judge.mentions("8080", "on port 18080")


@pytest.mark.parametrize(
    "text, stated",
    [
        ("ship it in red", True), ("not only red but blue", True), ("not one of the six red ones", False), ("not one of these very many old and quite red ones", True), ("not there. red it is", True),
        ("the red tier note is explicitly from before the move", False), ("red was only a former choice", False), ("they previously asked for red", False), ("red is a pre-launch value", False),
        ("it was no longer red", False), ("red, but the current setting is blue", False), ("red-ish", True), ("use blue instead of kim's red", False), ("red is new", True),
    ],
)
def test_judge_reads_what_stands_around_a_term(text, stated):
    assert judge.asserts("red", text) is stated


def test_model_surfaces(spark):
    df = spark.createDataFrame([("g", 1, "a b", "a b c"), ("g", 2, "a b", "a b"), ("g", 3, "a b", None)], "g string, r int, q string, d string")
    out = {r.r: r.reranked for r in models.rerank(df, "g", "r", "q", "d", models.overlap_scorer).collect()}
    assert out == {1: 1, 2: 2, 3: 3}
    with pytest.raises(Exception, match="finite"):
        models.pair_scores(df, "q", "d", lambda: lambda q, d: [float("nan")] * len(q)).collect()
    v = df.select(models.hash_embedder(32)("d").alias("v")).collect()
    assert all(len(r.v) == 32 for r in v) and abs(sum(x * x for x in v[0].v) - 1) < 1e-5

    def flaky():
        def answer(p):
            if p == "a b":
                raise TimeoutError
            return p.upper()

        return answer

    g = models.generated(df.select("r", "d"), "d", flaky).collect()
    assert {r.r: (r.answer, r.error) for r in g}[1] == ("A B C", None) and {r.r: r.error for r in g}[2] == "TimeoutError"


def test_prompts(spark):
    df = spark.createDataFrame([("q", 1, "a", "one two three"), ("q", 2, "b", "x " * 50), ("q", 3, "c", "four"), ("q", 4, "d", " ")], "q string, r int, id string, c string")
    r = prompts.assemble(df, "q", "r", "id", "c", F.lit("Why?"), F.lit("task"), 20).first()
    assert r.included == ["a", "c"] and r.omitted == ["b"] and r.kept_task and r.prompt_tokens <= 20


def test_log_lines(spark, tmp_path):
    e = lambda n: json.dumps({"sequenceNumber": n, "entryId": f"e{n}", "operation": "SET_STATUS", "payload": json.dumps({"status": "RUNNING"}), "timestamp": "2026-01-01T00:00:00Z"})
    (tmp_path / "t1.jsonl").write_text(f"{e(1)}\n\n{e(2)}\n{e(3)[:20]}")
    out = readers.action_log(spark, str(tmp_path), 2).collect()
    assert [(r.task_id, r.seq, r.payload) for r in out] == [("t1", 2, {"status": "RUNNING"})]
    (tmp_path / "t2.jsonl").write_text(f"{e(1)[:20]}\n{e(2)}\n")
    with pytest.raises(Exception, match="broken log line"):
        readers.action_log(spark, str(tmp_path)).collect()


def test_json_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"caseId": "c", "question": "q"}]))
    (tmp_path / "b.jsonl").write_text('{"caseId": "d"}\n{"caseId": "e"}\n')
    assert readers.case_set(spark, str(tmp_path / "a.json")).count() == 1 and readers.case_set(spark, str(tmp_path / "b.jsonl")).count() == 2
    f = spark.createDataFrame([("i", "n", "c", 3)], "id string, namespace string, content string, token_count int")
    writers.archive(f, str(tmp_path / "archive"))
    assert readers.fragments(spark, str(tmp_path / "archive")).select("id", "token_count").first() == ("i", 3)
    table = writers.report(f, str(tmp_path / "report"), "Title")
    assert "| i | n | c | 3 |" in table


def test_stores(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "id string, v int, c string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 2, "no"), ("c", 1, "n")], "id string, v int, c string")
    assert {r.id: r.c for r in stores.upsert(old, new, "id", "v").collect()} == {"a": "z", "b": "y", "c": "n"}
    assert one(spark, a=stores.retry_outcome(F.lit(False), F.lit(3)), b=stores.retry_outcome(F.lit(False), F.lit(4)), c=stores.retry_outcome(F.lit(True), F.lit(9)))[:3] == ("retried", "discarded", "recovered")


def test_engine(spark):
    rows = [("a", "N", "pegasus release notes", [1.0, 0.0], 3, 0.5, 0, ["x"], None, None), ("b", "n ", "other text", [0.0, 1.0], 2, 0.5, 0, [], "chain", None), ("c", "m", "pegasus", [1.0, 0.0], 1, 0.5, 0, None, None, 9)]
    f = spark.createDataFrame(rows, "id string, namespace string, content string, embedding array<double>, token_count int, importance double, last_access_ms bigint, tags array<string>, reasoning_chain_id string, pinned_until_ms bigint")
    e = Engine(spark, f, 0)
    q = spark.createDataFrame([("q", "n", [1.0, 0.1], "pegasus release")], "query_id string, namespace string, embedding array<double>, text string")
    ids = lambda df: [r.id for r in df.orderBy("place").collect()]
    assert ids(e.recall(q)) == ["a", "b"] and ids(e.recall(q, mode=HYBRID, rerank=True)) == ["a", "b"] and ids(e.recall(q, mode=KEYWORD_ONLY)) == ["a"]
    assert ids(e.recall(q, tags=["x"])) == ["a"] and ids(e.recall(q, budget=2)) == ["b"]
    assert e.eviction_plan(1).count() >= 1 and e.quota(100).count() == 1
    assert e.forget(spark.createDataFrame([("a",)], "id string")).fragments.count() == 2
    assert e.store(f.where("id = 'a'")).fragments.count() == 3


def test_summary_is_cut_at_a_space(spark):
    long = " ".join(f"word{i:03d}" for i in range(300))
    r = one(spark, a=text.summary(F.lit(long)), b=text.summary(F.lit("x" * 2000)), c=text.summary(F.lit("- one.\n- two.")), d=text.summary(F.lit(None).cast("string")))
    assert 600 <= len(r.a) <= 1200 and long.startswith(r.a) and long[len(r.a)] == " "
    assert r.b == "x" * 1200 and r.c == "one.\ntwo." and r.d == ""


def test_numbers_and_sums_of_a_large_group(spark):
    rows = [("hot" if i % 3 else None if i % 9 == 0 else f"g{i % 5}", (i * 37) % 1000, i, i % 4 if i % 7 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, k int, id int, n int")
    got = {r.id: (r.rank, r.before) for r in ordering.numbered(df, "g", ["k", "id"], "n").collect()}
    want, by = {}, {}
    for g, k, i, n in rows:
        by.setdefault(g, []).append((k, i, n or 0))
    for members in by.values():
        total = 0
        for place, (_, i, n) in enumerate(sorted(members), 1):
            want[i] = (place, total)
            total += n
    assert got == want
    assert ordering.numbered(df.limit(0), "g", ["k", "id"]).count() == 0


def test_chains_that_never_end(spark):
    rows = [(1, 2, "DELTA"), (2, 3, "DELTA"), (3, 1, "DELTA"), (4, 1, "DELTA"), (5, 5, "DELTA"), (10, None, "FULL"), *[(i, i - 1, "DELTA") for i in range(11, 50)], (60, 99, "DELTA"), (61, 60, "DELTA")]
    out = {r.checkpoint_id: (r.root_id, r.depth, r.root_kind) for r in log.base_chains(spark.createDataFrame(rows, "checkpoint_id int, base_id int, kind string")).collect()}
    assert all(out[i] == (None, None, "CYCLE") for i in (1, 2, 3, 4, 5))
    assert all(out[i] == (10, i - 10, "FULL") for i in range(10, 50)) and out[61] == (60, 1, "DELTA") and len(out) == len(rows)
    assert log.base_chains(spark.createDataFrame([], "checkpoint_id int, base_id int, kind string")).count() == 0


def test_evidence_flags_at_any_depth(spark):
    texts = ['{"a":[{"b":{"hasAnswer":true}}]}', '{"a":"\\"has_answer\\": true"}', '{"is_evidence": "TRUE"}', '{"isEvidence":false,"x":[1]}', '{"has_answer" : 1}', "{}", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.e for r in df.select("i", text.has_evidence(F.col("t")).alias("e")).orderBy("i").collect()] == [True, False, True, False, True, False, None]


def test_page_distance(spark):
    d = lambda nodes, now: scalar.page_distance(F.array(*map(F.lit, nodes)), F.lit(now))
    assert one(spark, a=d(["task-0001-a"], "task-0001-a"), b=d(["task-0001-a"], "task-0001-b"), c=d(["short"], "shorts"), d=d(["other-001-a"], "task-0001-a"))[:4] == (0.0, 0.3, 1.0, 1.0)


def test_nearest_open_page(spark):
    vectors = spark.createDataFrame([("a", "n", [1.0, 0.0]), ("b", "n", [0.0, 1.0]), ("c", "m", [1.0, 0.0])], "id string, namespace string, embedding array<float>")
    pages = spark.createDataFrame([("n", "q", [1.0, 0.1]), ("n", "p", [1.0, 0.1]), ("n", "r", [-1.0, 0.0])], "namespace string, page_id string, centre array<double>")
    assert [(r.id, r.page_id) for r in graph.nearest_open_page(vectors, pages, 0.3).collect()] == [("a", "p")]


def test_pool_redundancy(spark):
    rows = [(1, "a", [1.0, 0.0]), (1, "b", [1.0, 0.0]), (1, "c", [0.0, 1.0]), (2, "a", [1.0, 0.0]), (3, "a", None), (3, "b", [1.0, 0.0])]
    out = {(r.q, r.id): (round(r.penalty, 6), round(r.novelty, 6)) for r in recall.pool_redundancy(spark.createDataFrame(rows, "q int, id string, v array<float>"), "q", "id", "v").collect()}
    assert out == {(1, "a"): (0.05, 0.0), (1, "b"): (0.05, 0.0), (1, "c"): (0.0, 0.15), (2, "a"): (0.0, 0.0), (3, "a"): (0.0, 0.15), (3, "b"): (0.0, 0.15)}


def test_tier_store(spark, tmp_path):
    from tidemark.sources.tiers import TierStore

    s = TierStore(spark, str(tmp_path / "hot"), "id string, namespace string, token_count bigint")
    row = lambda *r: spark.createDataFrame(list(r), "id string, namespace string, token_count bigint")
    assert s.all().count() == 0
    s.put(row(("a", "n", 1), ("b", "n", 2), ("c", "m", 3)))
    s.put(row(("a", "n", 5)))
    s.delete(row(("c", "m", 0)))
    assert sorted(map(tuple, s.all().collect())) == [("a", "n", 5), ("b", "n", 2)]
    assert s.get(row(("b", "", 0), ("z", "", 0))).count() == 1 and s.scan("n").count() == 2 and s.usage().first().tokens == 7
    t = s.compact(str(tmp_path / "new"))
    s.clear("n")
    assert s.all().count() == 0 and t.all().count() == 2


def test_payload_formats(spark):
    from tidemark.sources import payloads

    assert payloads.sniff(b'{"a":1}') == ("json", '{"a":1}') and payloads.sniff(b"\x1f\x8bxx") == payloads.sniff(b"\x00\xff") == payloads.sniff(None) == ("unknown", None)
    df = spark.createDataFrame([(1, '{"a":1}'), (2, None)], "i int, body string")
    back = {r.i: (r.format, r.body) for r in payloads.unpacked(payloads.packed(df)).collect()}
    assert back == {1: ("gzip", '{"a":1}'), 2: ("unknown", None)}


def test_ingest_stages(spark):
    from tidemark.operators import ingest

    rows = [("a", " N ", "One two.\n\nThree."), ("a", " N ", "One two.\n\nThree."), ("b", " ", "x"), ("c", "n", " \n"), ("d", "n", None), (None, "n", "x")]
    done = ingest.staged(spark.createDataFrame(rows, "request_id string, namespace string, content string"), 512, models.hash_embedder(8)("piece"))
    got = {r.request_id: (r.status, r.stage, r.reason) for r in done.collect()}
    assert got == {"a": ("COMPLETED", "warm", None), "b": ("FAILED", "validate", "no namespace"), "c": ("FAILED", "validate", "no content"), "d": ("FAILED", "validate", "no content")}
    f = ingest.fragments(done).collect()
    assert [(r.namespace, r.place, r.content, len(r.embedding)) for r in sorted(f, key=lambda r: r.place)] == [("n", 0, "One two.", 8), ("n", 1, "Three.", 8)]


def test_fallback_embedding(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 9)], "i int, t string")
    out = {r.i: r.source for r in models.with_fallback(df, "t", models.failing_on_length(4, 16), lambda: models.hash_embedding_of(16), 16).collect()}
    assert out == {i: "fallback" if i % 4 == 0 else "primary" for i in range(1, 9)}
    seen = []
    models.for_retrieval(lambda: lambda texts: seen.extend(texts), "q: ", 3)()(["a b c d"])
    assert seen == ["q: a b"]


def test_failed_attempts_come_back(spark):
    out = stores.retries(spark.createDataFrame([(1,), (2,)], "id int"), "id", lambda n: (F.col("id") == 1) & (n == 3)).collect()
    assert sorted((r.id, r.attempt, r.outcome) for r in out) == [(1, 1, "retried"), (1, 2, "retried"), (1, 3, "recovered"), *[(2, i, "retried") for i in range(1, 5)], (2, 5, "discarded")]


def test_reached_equals_the_closure(spark):
    import random

    r = random.Random(3)
    rows = sorted({(g, r.randrange(12), r.randrange(12)) for g in range(3) for _ in range(20)})
    e = spark.createDataFrame(rows, "task_id bigint, src bigint, dst bigint")
    whole = sorted(map(tuple, graph.closure(e).collect()))
    starts = e.select("task_id", F.col("src").alias("node"))
    assert sorted(map(tuple, graph.reached(e, starts).collect())) == whole
    ends = e.where("task_id = 1").select("task_id", F.col("dst").alias("node"))
    assert sorted((t, n, s) for t, s, n in map(tuple, graph.reached(e, ends, backwards=True).collect())) == [w for w in whole if w[0] == 1]


def test_shadow_arms_learn(spark):
    rows = [("s", i, i, 0, 0.0, 3, 1.0) for i in range(200)]
    r = learning.exp3(spark.createDataFrame(rows, "scenario string, n bigint, ts_ms bigint, arm bigint, reward double, shadow_arm bigint, shadow_reward double"), 4).first()
    assert r.best_arm == 3 and r.recalls == 200


def test_lookahead_pages(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4)], "task_id bigint, src bigint, dst bigint")
    p = spark.createDataFrame([(1, 2, 7, "EVICTED", 1), (1, 3, 8, "RESIDENT", 9), (1, 3, 9, "EVICTED", 5), (1, 4, 10, "EVICTED", 9)], "task_id bigint, node bigint, page bigint, state string, access_count bigint")
    s = spark.createDataFrame([(1, 1)], "task_id bigint, node bigint")
    assert [r.page for r in graph.lookahead_pages(s, e, p, 2, 1).collect()] == [9]
    assert sorted(r.page for r in graph.lookahead_pages(s, e, p, 2, 3).collect()) == [7, 9]
