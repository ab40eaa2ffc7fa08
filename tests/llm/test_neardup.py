import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import neardup as nd

SCHEMA = "fragment_id string, namespace string, content string, a string, id int"


def brute(rows, t=0.6):
    sets = {}
    for i, g, c, *_ in rows:
        g = (g or "").strip(" ").lower()
        x = re.findall("[a-z0-9]+|[一-鿿]", (c or "").lower())
        s = frozenset(zip(x, x[1:]))
        if i is not None and g and s:
            sets[i] = (g, s)
    ids = sorted(sets)
    return sorted((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) >= t * len(sets[a][1] | sets[b][1]))


def texts(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + list("记忆召回结果")
    base = [[r.choice(words) for _ in range(r.randint(1, 40))] for _ in range(max(1, n // 4))]
    out = []
    for i in range(n):
        x = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(x) + 1)
            x[k : k + r.randint(0, 1)] = [r.choice(words)]
        out.append((f"f{i:03d}", r.choice([" A", "a", "b", None, " "]), " ".join(x), "z", i))
    return out


def found(spark, rows, t=0.6):
    return sorted((r.id_a, r.id_b) for r in nd.similar_pairs(spark.createDataFrame(rows, SCHEMA), threshold=t).collect())


def test_equals_brute_force(spark):
    rows = texts(240, 1)
    assert found(spark, rows) == brute(rows) != []


def links(spark, rows, t=0.6):
    out, members = nd.class_links(spark.createDataFrame(rows, SCHEMA), threshold=t)
    return sorted((bytes(r.a), bytes(r.b), round(r.similarity, 9)) for r in out.collect())


@pytest.mark.parametrize("grams", [10**6, 400, 40])
def test_fragments_change_nothing(spark, monkeypatch, grams):
    rows = texts(200, 2)
    whole = links(spark, rows)
    monkeypatch.setattr(nd, "SMALL_GROUP", 0)
    monkeypatch.setattr(nd, "FRAGMENT_GRAMS", grams)
    monkeypatch.setattr(nd, "BATCH_GRAMS", 100)
    assert links(spark, rows) == whole != []
    assert found(spark, rows) == brute(rows)


def test_fragments_form_few_other_pairs(spark, monkeypatch):
    """Texts of common phrases in other choices are no pairs, however many fragments their group has."""
    r = random.Random(5)
    phrases = [[f"p{i}w{k}" for k in range(6)] for i in range(40)]
    rows = [(f"f{i:03d}", "n", " ".join(sum(r.sample(phrases, 8), [])), "", i) for i in range(120)]
    rows += [(f"g{i}", "n", rows[i][2] + f" more {i}", "", i) for i in range(10)]
    monkeypatch.setattr(nd, "FRAGMENT_GRAMS", 500)
    table = nd.gram_table(spark.createDataFrame(rows, SCHEMA), "fragment_id", "namespace", "content")
    cut = nd.with_fragments(table)
    assert cut.first().frags > 8
    pairs = nd.partial_overlaps(cut, *nd.global_order(table), 0.6).select("a", "b").distinct().count()
    assert 10 <= len(brute(rows)) <= pairs <= 3 * len(brute(rows))


@pytest.mark.parametrize("t", [0.3, 0.8, 1.0])
def test_other_thresholds(spark, monkeypatch, t):
    rows = texts(160, 4)
    monkeypatch.setattr(nd, "SMALL_GROUP", 300)
    monkeypatch.setattr(nd, "FRAGMENT_GRAMS", 250)
    assert found(spark, rows, t) == brute(rows, t)


def test_found_pairs_of_a_whole_table_are_similar(spark):
    """Every pair of a table, recomputed from its texts."""
    df = spark.read.parquet("/root/testdata/sf0.01/memory_fragments.parquet")
    rows = [tuple(r) for r in df.select("fragment_id", "namespace", "content").collect()]
    got = {(r.id_a, r.id_b) for r in nd.similar_pairs(df).collect()}
    assert got == set(brute(rows))


def test_dirty_and_repeated_rows(spark):
    long = " ".join(f"t{i}" for i in range(5000))
    rows = [("a", "n", "one two three", "", 1), ("a", "n", "one two three", "", 1), ("b", "N ", "One, two - three!", "", 1), ("c", "n", None, "", 1), ("d", "n", "", "", 1), ("e", "n", "one", "", 1), (None, "n", "one two three", "", 1), ("g", None, "one two three", "", 1), ("h", "n", long, "", 1), ("i", "n", long + " more", "", 1)]
    assert found(spark, rows) == [("a", "b"), ("h", "i")]


def test_empty(spark):
    assert found(spark, []) == []
    assert nd.similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_are_components(spark):
    chain = [(f"c{i}", "n", " ".join(f"t{k}" for k in range(i, i + 12)), "", i) for i in range(9)]
    rows = [*chain, ("z1", "n", "far away text here", "", 1), ("z2", "n", "far away text here", "", 1), ("y", "m", "far away text here", "", 1)]
    out = {r.id: r for r in nd.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    pairs = brute(rows)
    assert len({out[f"c{i}"].group_id for i in range(9)}) == 1
    assert out["z1"].group_id == out["z2"].group_id != out["y"].group_id
    assert all(out[a].group_id == out[b].group_id for a, b in pairs)
    assert out["z1"].n_links == 0 and out["c4"].n_links > 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=30))
def test_gram_set_is_a_set(xs):
    text = " ".join(map(str, xs))
    assert len(nd.gram_set(text)) == len(set(zip(xs, xs[1:])))
