import numpy as np

import pytest

from tidemark.llm import neighbours
from tidemark.llm.neighbours import IndexSettings, footrule_top, nearest_vectors, neighbour_pairs, order_codes, orders

SCHEMA = "fragment_id string, namespace string, embedding array<float>, cosine string"


def data(n, width, seed, groups=("g", "h")):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(1, n // 8), width))
    rows = []
    for i in range(n):
        v = centres[r.integers(len(centres))] + 0.3 * r.normal(size=width)
        rows.append((f"v{i:04d}", groups[i % len(groups)], (v * r.uniform(0.5, 2)).astype(np.float32).tolist(), "x"))
    return rows


def brute(rows, k):
    out = set()
    by = {}
    for i, g, v, _ in {r[0]: r for r in rows}.values():
        by.setdefault(g, []).append((i, np.array(v, np.float32).astype(np.float64)))
    for members in by.values():
        for i, v in members:
            s = sorted((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 6), j) for j, w in members if j != i)
            out |= {(i, j) for _, j in s[:k]}
    return out


def found(spark, rows, width, k=5, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.id, r.neighbour) for r in nearest_vectors(df, k, width=width, settings=IndexSettings(**kw)).collect()}


def test_small_groups_are_exact(spark):
    rows = data(90, 8, 1)
    assert found(spark, rows + rows[:7], 8) == brute(rows, 5)


def test_recall_of_one_and_several_files(spark):
    rows = data(900, 16, 2, ("g",))
    true = brute(rows, 5)
    one = found(spark, rows, 16, candidates=60, pivots=32)
    files = found(spark, rows, 16, candidates=60, pivots=32, spread=8.0)
    assert len(one & true) / len(true) >= 0.9 and len(files & true) / len(true) >= 0.9
    assert len(files) == len(true)


def test_shuffled_pivots_post_alike(spark, monkeypatch):
    rows = data(700, 16, 5, ("g", "g", "g", "h"))
    sent = found(spark, rows, 16, candidates=40, pivots=32, spread=5.0)
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", -1)
    assert found(spark, rows, 16, candidates=40, pivots=32, spread=5.0) == sent


def test_distances_leave_out_nobody_where_all_are_candidates():
    r = np.random.default_rng(4)
    x, h = r.normal(size=(60, 8)).astype(np.float32), r.integers(0, 2**63, 60).astype(np.uint64)
    short, (best, cos) = IndexSettings(candidates=59), neighbours._nearest(x, h, 5, IndexSettings(candidates=58))
    whole = neighbours._nearest(x, h, 5, short)
    assert (cos[:, 0] == whole[1][:, 0]).all() and (best == whole[0]).mean() > 0.98


@pytest.mark.parametrize("merge", [True, False])
def test_recall_of_posted_vectors(spark, merge):
    """All vectors of a table as one group, half of them without a close neighbour; and the largest natural group."""
    from pyspark.sql import functions as F

    df = spark.read.parquet("/root/testdata/sf0.1/warm_vectors.parquet")
    df = df.withColumn("namespace", F.lit("one")) if merge else df.where("lower(trim(namespace)) = 'atlas-frontdesk'")
    rows = {r.id: np.frombuffer(r.vec, "<f4").astype(np.float64) for r in neighbours.vector_table(df, "fragment_id", "namespace", "embedding", 128).collect()}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    assert len(ids) > (15_000 if merge else 1_500)
    true = set()
    for lo in range(0, len(x), 1024):
        sim = np.round(x[lo : lo + 1024] @ x.T, 6)
        sim[np.arange(len(sim)), lo + np.arange(len(sim))] = -9
        for q, row in enumerate(np.argsort(-sim, axis=1, kind="stable")[:, :5], lo):
            true |= {(ids[q], ids[j]) for j in row}
    got = {(r.id, r.neighbour) for r in nearest_vectors(df).select("id", "neighbour").collect()}
    recall = len(got & true) / len(true)
    print("recall of posted vectors", len(ids), round(recall, 4))
    assert recall >= 0.9


def test_equal_vectors_and_ties(spark):
    v, w = [1.0, 0.0], [2.0, 0.0]
    rows = [(f"c{i:02d}", "g", v, "") for i in range(20)] + [(f"d{i}", "g", w, "") for i in range(2)] + [("e", "g", [0.0, 1.0], "")]
    assert found(spark, rows, 2) == brute(rows, 5)


def test_unusable_rows(spark):
    rows = [("a", "g", [1.0, 0.0], ""), ("b", " G ", [1.0, 0.1], ""), ("n", "g", None, ""), ("w", "g", [1.0], ""), ("z", "g", [0.0, 0.0], ""), ("q", "g", [float("nan"), 1.0], ""), ("i", "g", [float("inf"), 1.0], ""), ("x", None, [1.0, 0.0], ""), ("y", " ", [1.0, 0.0], ""), (None, "g", [1.0, 0.0], ""), ("alone", "k", [1.0, 0.0], "")]
    assert found(spark, rows, 2) == {("a", "b"), ("b", "a")}
    assert found(spark, [], 2) == set()


def test_pairs_have_the_smaller_id_first(spark):
    df = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "c")], "id string, neighbour string")
    assert sorted(map(tuple, neighbour_pairs(df).collect())) == [("a", "b"), ("a", "c")]


def test_footrule_is_the_distance_of_the_codes():
    r = np.random.default_rng(3)
    x, pivots = r.normal(size=(50, 6)).astype(np.float32), r.normal(size=(10, 6)).astype(np.float32)
    places = orders(x, pivots)
    assert (np.sort(places, axis=1) == np.arange(10)).all()
    for bands in (10, 4):
        b = places.astype(int) * bands // 10
        for lo, top in footrule_top(order_codes(x, pivots, bands), 7):
            for i, row in enumerate(top, lo):
                want = sorted((np.abs(b[i] - b[j]).sum(), j) for j in range(50) if j != i)[:7]
                assert sorted(row.tolist()) == sorted(j for _, j in want)
