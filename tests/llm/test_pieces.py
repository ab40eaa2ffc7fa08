import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pieces as p
from tidemark.llm.tokens import TOKEN

count = lambda t: len(re.findall(TOKEN, t))


def check(text, limit=64, overlap=8):
    spans = p.cut_text(text, limit, overlap, step=1)
    if not text:
        assert spans == []
        return spans
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for a, b in spans:
        assert count(text[a:b]) <= limit
    for (a, b), (c, d) in zip(spans, spans[1:]):
        own = [m.span() for m in re.finditer(TOKEN, text[a:b])]
        assert c == a + own[-overlap][0] and d > b
    # without the overlaps the pieces are the text
    assert "".join(text[max(a, (spans[i - 1][1] if i else 0)) : b] for i, (a, b) in enumerate(spans)) == text
    return spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .。\n\r\t记忆!？x", max_size=900))
def test_pieces_cover_and_fit(text):
    check(text)


def test_long_kinds_of_text():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    check(" ".join(word() for _ in range(5000)), 512, 64)
    check("记" * 3000, 512, 64)
    check("x" * 20_000, 512, 64)
    check("。".join("记忆召回结果" * 9 for _ in range(80)), 512, 64)
    check("\r\n".join(word() for _ in range(3000)), 512, 64)


def test_cuts_lie_at_paragraphs_or_sentences():
    para = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(90)) + "." for i in range(20))
    for _, b in check(para, 512, 64)[:-1]:
        assert para[b - 2 : b] == "\n\n"
    sent = " ".join(" ".join(f"w{i}x{j}" for j in range(30)) + "." for i in range(60))
    for _, b in check(sent, 512, 64)[:-1]:
        assert sent[b - 1] == "."


def test_cut_at_the_topic_boundary():
    r = random.Random(5)
    topic = lambda w, n: [" ".join(r.choice(w) for _ in range(20)) + "." for _ in range(n)]
    text = " ".join(topic([f"a{i}" for i in range(12)], 19) + topic([f"b{i}" for i in range(12)], 19))
    edge = text.index(" b") + 1
    assert abs(p.cut_text(text)[0][1] - edge) <= 2


def test_cohesion_against_plain_counts():
    import numpy as np
    from collections import Counter

    r = random.Random(6)
    terms = np.array([r.randrange(9) for _ in range(120)])
    w = 10
    sim = p.cohesion(terms, w)
    for g in range(1, 120):
        a, b = Counter(terms[max(0, g - w) : g].tolist()), Counter(terms[g : g + w].tolist())
        want = sum(a[t] * b[t] for t in a) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
        assert abs(sim[g] - want) < 1e-9


def test_rows(spark):
    long = "word. " * 2000
    rows = [("a", long, 1), ("a", long, 1), ("b", None, 1), ("c", "", 1), ("d", " \n ", 1), (None, "x", 1), ("e", "short", 1)]
    df = spark.createDataFrame(rows, "k string, content string, piece int")
    out = p.pieces(df, "k", "content", "note").collect()
    by = {}
    for r in out:
        by.setdefault(r.record_id, []).append(r)
    assert set(by) == {"a", "b", "c", "d", "e"}
    assert [r.piece for r in sorted(by["a"], key=lambda r: r.piece)] == list(range(1, len(by["a"]) + 1)) and by["a"][0].text_tokens == 2000
    assert all(len(by[k]) == 1 and by[k][0].piece == 0 and by[k][0].content is None for k in "bcd")
    assert by["e"][0].n_pieces == 1 and by["e"][0].content == "short"
    assert p.pieces(df.limit(0), "k", "content", "note").count() == 0


def test_the_deepest_of_all_gaps_is_taken():
    # no mark in the text; its topic changes at token 405, which is not one of every eighth gap
    words = [f"{'a' if k < 405 else 'b'}{k % 7}" for k in range(900)]
    text = " ".join(words)
    assert p.cut_text(text)[0] == (0, text.index("b"))
