import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing as k
from tidemark.llm.tokens import count_tokens, default_vocabulary, encoder


def test_configuration_is_the_best_knapsack():
    price, count = np.array([0, 1.0, 2.9, 3.1, 0, 7.0]), np.array([0, 9, 9, 9, 0, 9])
    c = k.best_configuration(price, 5, count)
    assert (c * price).sum() == max(7.0, 2.9 * 2 + 1) and (c * np.arange(6)).sum() <= 5


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=20))
def test_plan_covers_every_item_once(sizes):
    count = np.zeros(41, np.int64)
    for s, n in sizes.items():
        count[s] = n
    plan, placed, value = k.solve(count, 40)
    assert 0 <= placed <= sum(m for _, m in plan) and value >= (count * np.arange(41)).sum() / 40 - 1e-9
    assert all((c * np.arange(41)).sum() <= 40 and m > 0 for c, m in plan)
    assert (sum((c * m for c, m in plan), np.zeros(41, np.int64)) == count).all()


def test_little_room_left():
    r = np.random.default_rng(1)
    count = np.bincount(np.minimum(np.maximum(r.lognormal(5.5, 0.7, 20_000).astype(int), 20), 2048), minlength=2049)
    plan, placed, value = k.solve(count, 2048)
    used, n = (count * np.arange(2049)).sum(), sum(m for _, m in plan)
    assert used / (n * 2048) > 0.997
    # nearly all containers come from the program, which is close to the bound by volume
    assert placed / n > 0.95 and value <= 1.003 * used / 2048


def test_program_covers_every_length():
    r = np.random.default_rng(2)
    count = np.bincount(r.integers(1, 300, 3000), minlength=513)
    cover = k.program(count, 512)
    assert np.allclose(sum(x * c for c, x in cover), count) and all((c * np.arange(513)).sum() <= 512 for c, _ in cover)


def test_a_frequent_length_is_numbered_in_shares(spark, monkeypatch):
    monkeypatch.setattr(k, "SHARE", 7)
    out = k.pack(spark.range(100).selectExpr("id", "if(id < 90, 5, id - 88) n"), "id", "n", 16).collect()
    box = {}
    for x in out:
        box[x.container] = box.get(x.container, 0) + x.n_tokens
    assert len(out) == len({x.id for x in out}) == 100 and max(box.values()) <= 16


def test_items(spark):
    rows = [(1, 5), (2, 10), (3, 0), (4, None), (5, 25), (6, 20), (7, 3), (8, 3), (None, 4)]
    out = k.pack(spark.createDataFrame(rows, "id bigint, total int"), "id", "total", 10).collect()
    box = {}
    for r in out:
        box.setdefault(r.container, []).append(r)
    assert {r.id for r in box.pop(0)} == {3, 4}
    assert all(sum(r.n_tokens for r in b) <= 10 for b in box.values())
    assert sorted((r.piece, r.start_token, r.n_tokens) for r in out if r.id == 5) == [(1, 0, 10), (2, 10, 10), (3, 20, 5)]
    assert sum(r.n_tokens for r in out) == sum(n or 0 for _, n in rows)
    assert k.pack(spark.createDataFrame([], "id bigint, total int"), "id", "total", 10).count() == 0
    report = k.container_report(k.pack(spark.createDataFrame(rows, "id bigint, total int"), "id", "total", 10), 10).first()
    assert report.tokens == 70 and report.containers >= 7 and 0 <= report.program_share <= 1


def test_whole_texts_are_counted():
    e = encoder(default_vocabulary()).encode_ordinary
    text = "A recall window, 12 hits. " * 4000
    assert count_tokens(e, text) == len(e(text)) and count_tokens(e, None) == count_tokens(e, "") == 0
