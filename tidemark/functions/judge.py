"""Rule-based check of generated answers.

Answer and facts are read as tokens: words, clock times and single marks. A
fact is a run of tokens. What stands around the run decides whether the answer
states it, denies it or speaks of the past.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Tokens = list[str]
_token = re.compile(r"\d{1,2}:\d{2}(?![0-9])|[a-z0-9]+|\S")


def tokens(text: str | None) -> Tokens:
    return _token.findall(re.sub("[‘’‛′]", "'", (text or "").lower()))


def _phrases(*slots: str) -> list[Tokens]:
    """All phrases that take one alternative from every slot."""
    return [tokens(" ".join(p)) for p in product(*(s.split("|") for s in slots))]


# Words and phrases that the results depend on.
UNSURE = [
    *_phrases("insufficient|unknown"),
    *_phrases("cannot|can not|can't|cant|could not|couldn't", "determine|answer|tell|identify|infer|say"),
    *_phrases("do not|don't|dont|did not|didn't", "have"),
    *_phrases("no", "memory|fragments|information|details|context"),
    *_phrases("none were", "supplied|provided|given"),
    *_phrases("without additional", "context|information|memory"),
]
DENIED = _phrases("not|instead of|rather than")
NOT_DENIED = _phrases("not only")
DENIED_WORDS = 6
PAST = _phrases("previously|formerly|historically|no longer|used to be")
PAST_WORDS = 8
STALE = set("previous prior old former outdated deprecated obsolete historical".split())
STALE_PHRASES = [
    *_phrases("no longer|previously|formerly|from before|from last week|noted as|pre -"),
    *_phrases("from the", "previous|prior|old"),
    *_phrases("but|but the", "current", "preference|state|status|setting|value"),
]
LINKING = set("tier reference note alert alerts is are was were only explicitly described as a an the , ; :".split())
RANGE_WORDS = {"to", "through", "until", "-"}
SAME = [(tokens(a), tokens("bullet point")) for a in ("bullet-points", "bullet-point", "bullet points")]
# End of the fixed values.


def canonical(t: Tokens) -> Tokens:
    """One spelling of time ranges (``09:00 to 10:00 utc``) and of bullet points."""
    out: Tokens = []
    i = 0
    while i < len(t):
        same = next(((a, b) for a, b in SAME if t[i : i + len(a)] == a), None)
        if same:
            out += same[1]
            i += len(same[0])
            continue
        if ":" in t[i] and len(t[i]) > 1:
            k = i + 2 if t[i + 1 : i + 2] == ["utc"] else i + 1
            if t[k : k + 1] and t[k] in RANGE_WORDS and ":" in "".join(t[k + 1 : k + 2])[1:] and t[k + 2 : k + 3] == ["utc"]:
                if out[-1:] == ["from"]:
                    out.pop()
                out += [*t[i:k], "to", t[k + 1], "utc"]
                i = k + 3
                continue
        out.append(t[i])
        i += 1
    return out


def runs(term: Tokens, t: Tokens) -> Iterator[int]:
    """Places at which a run of tokens starts."""
    n = len(term)
    return (i for i in range(len(t) - n + 1) if n and t[i] == term[0] and t[i : i + n] == term)


def _reaches(cues: list[Tokens], words: int, t: Tokens, at: int, but: list[Tokens] = []) -> bool:  # noqa: B006
    """Whether a cue ends before ``at``, with at most ``words`` words and no mark but joined ones between."""
    left, i = words, at
    while True:
        for c in cues:
            if i >= len(c) and t[i - len(c) : i] == c and not any(t[i - len(c) : i - len(c) + len(b)] == b for b in but):
                return True
        joined = i >= 2 and t[i - 1] in "'-"
        if not joined:
            if not i or not t[i - 1][0].isalnum() or ":" in t[i - 1]:
                return False
            # words that a mark joins count as one
            if not (i < at and t[i] in "'-"):
                left -= 1
                if left < 0:
                    return False
        i -= 1


def _past_after(t: Tokens, at: int) -> bool:
    """Whether what follows calls the run a thing of the past, after words that only link."""
    while at < len(t):
        if t[at] in STALE or any(t[at : at + len(p)] == p for p in STALE_PHRASES):
            return True
        if t[at] not in LINKING:
            return False
        at += 1
    return False


def mentions(term: str, text: str) -> bool:
    """Whether the text has the term, in any spelling of time ranges and bullet points."""
    return any(True for _ in runs(canonical(tokens(term)), canonical(tokens(text))))


def asserts(term: str, text: str) -> bool:
    """Whether the text states a term, neither denied nor as something of the past."""
    run, t = canonical(tokens(term)), canonical(tokens(text))
    return any(not (_reaches(DENIED, DENIED_WORDS, t, i, NOT_DENIED) or _reaches(PAST, PAST_WORDS, t, i) or _past_after(t, i + len(run))) for i in runs(run, t))


def unsure(text: str) -> bool:
    """Whether the text says that it can't tell."""
    t = tokens(text)
    return any(True for p in UNSURE for _ in runs(p, t))


def verdict(expected: str | None, must: Iterable[str] | None, must_not: Iterable[str] | None, answer: str | None) -> str:
    """``correct`` or the first reason against the answer."""
    wanted = [expected, *(must if must is not None else ())]
    if not tokens(expected) or not tokens(answer):
        return "answer_missing_fact"
    if any(asserts(t, answer) for t in (must_not if must_not is not None else ()) if t):
        return "hallucinated_forbidden_fact"
    if unsure(answer):
        return "insufficient_answer"
    return "correct" if all(mentions(t or "", answer) for t in wanted) else "answer_missing_fact"


@F.pandas_udf(StringType())
def judge(expected: pd.Series, must: pd.Series, must_not: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([verdict(*r) for r in zip(expected, must, must_not, answer)], dtype="object")


def failure(recall_hit: Column, judged: Column, evidence_missing: Column) -> Column:
    """Why a case failed: recall before judgement; null when it didn't."""
    insufficient = (judged == "insufficient_answer") & ~evidence_missing
    return F.when(~recall_hit, "recall_miss").when(judged == "correct", F.lit(None)).when(insufficient, "insufficient_when_memory_available").otherwise(judged)
