import random

from tidemark.llm import truncation as t

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, reason string"
OBJECTS = ["the cache", "a vector", "the archive", "every session", "the ledger", "a snapshot"]
VERBS = ["restored", "compacted", "released", "measured", "duplicated", "verified"]
WHEN = ["before the restart", "during the night", "after the review", "under heavy load"]


def sentence(r):
    return f"The {r.choice(['scheduler', 'planner', 'gateway', 'splitter'])} {r.choice(VERBS)} {r.choice(OBJECTS)} {r.choice(WHEN)}."


def corpus(n=400, seed=7):
    r = random.Random(seed)
    return [" ".join(sentence(r) for _ in range(r.randint(3, 8))) for _ in range(n)], r


def judged(spark, texts):
    df = spark.createDataFrame([(i, x, " Notes", len(x) if x else None, "clash") for i, x in enumerate(texts)], SCHEMA)
    return {r.doc_id: r.reason for r in t.judged(df).collect()}


def test_cut_words_and_sentences(spark):
    texts, r = corpus()
    whole = len(texts)
    cut = [x[: x.index("compacted") + 6] for x in texts if "compacted" in x][:8] + [x[: x.index(" the restart") + 4] for x in texts if " the restart" in x][:8]
    closers = [x + "\n\nRegards, team north" for x in texts[:12]] + [x + " To be continued…" for x in texts[:12]]
    reason = judged(spark, texts + cut + closers)
    assert all(reason[i] is None for i in range(whole))
    assert all(reason[whole + i] in ("word", "sentence") for i in range(len(cut)))
    assert all(reason[whole + len(cut) + i] is None for i in range(len(closers)))


def test_structures_and_debris(spark):
    texts, _ = corpus(60)
    table = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    good = ['{"a": 1,\n "b": [2]}', '```json\n{"a": 1}\n```', table]
    bad = ['{"a": 1,\n "b": [2', '```json\n{"a": 1', "| a | b |\n| --- | --- |", table + "\n| 3 |", texts[0][:40] + "�", texts[0][:40] + "&quo", texts[1][:40] + "<b"]
    reason = judged(spark, texts + good + bad)
    n = len(texts)
    assert all(reason[n + i] is None for i in range(3))
    assert [reason[n + 3 + i] for i in range(7)] == ["structure"] * 4 + ["debris"] * 3


def test_marks_and_copies(spark):
    texts, _ = corpus()
    cut = texts[3][: texts[3].index("The") + 9] + " [more]"
    said = 'The preview had shown "[more]" 9 times.'
    reason = judged(spark, [*texts, cut, cut, said])
    n = len(texts)
    assert reason[n] == reason[n + 1] == "mark" and reason[n + 2] is None


def test_dirty_rows(spark):
    reason = judged(spark, [None, "", " \n\t", "x" * 200_000, "Fine."])
    assert set(reason) == {3, 4} and reason[4] is None
    assert t.judged(spark.createDataFrame([], SCHEMA)).count() == 0
    rates = t.truncation_rates(spark.createDataFrame([(1, "A text.", None, None, ""), (2, '{"a": ', None, None, "")], SCHEMA)).collect()
    assert [(r.source, r.n_documents, r.n_truncated, r.rate) for r in rates] == [(None, 2, 1, 0.5)]


def test_trie(spark):
    words = spark.createDataFrame([("recall", 3), ("recap", 2)], "word string, n bigint")
    nodes = {r.node: r.below for r in t.trie(words).collect()}
    assert nodes["rec"] == 5 and nodes["recal"] == 3 and "recall" not in nodes


def test_long_tails_are_read_whole(spark):
    texts, _ = corpus(60)
    row = "| " + "cell " * 3000 + "| b |"
    good = row + "\n" + row
    reason = judged(spark, [*texts, good, good + "\n| " + "cell " * 3000, '{"name": "abc\\u4e'])
    n = len(texts)
    assert reason[n] is None and reason[n + 1] == "structure" and reason[n + 2] == "debris"


def test_planted_cuts(spark):
    """Random cuts of a corpus of its own, beside texts that end on purpose in many ways."""
    r = random.Random(11)
    whole, _ = corpus(1500, 5)
    ends = ["", "", "", "\n\nBest, Kim", "\n- done", "\n\nsent from the field desk"]
    whole = [x + r.choice(ends) for x in whole]
    cut = []
    for x in r.sample(whole, 120):
        at = r.randrange(20, len(x) - 30)
        # a cut right after a sentence can't be told from an end
        if x[:at].rstrip()[-1].isalnum():
            cut.append(x[:at])
    df = spark.createDataFrame([(i, x, "n", None, "") for i, x in enumerate(whole + cut)], SCHEMA)
    rows = {x.doc_id: x for x in t.judged(df).collect()}
    found = [rows[len(whole) + i].reason is not None for i in range(len(cut))]
    wrong = [whole[i][-40:] for i in range(len(whole)) if rows[i].reason is not None]
    assert sum(found) / len(found) >= 0.95 and len(wrong) <= 5
    # the tries of words and of contexts carry what is found
    assert all(x.evidence in ("word", "context") for x in rows.values() if x.reason)
