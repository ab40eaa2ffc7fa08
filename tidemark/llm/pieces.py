"""Cutting long texts at natural boundaries, by lexical cohesion.

A token is one Han character or one run of other characters without white
space. Cuts lie at paragraph or sentence ends where a size window has them.
Among the possible cuts of a window the one in the deepest valley is taken: at
each gap the terms of the block before are compared with those of the block
after, and the depth of a gap is how far its similarity lies below the nearest
peaks on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import TOKEN

_token = re.compile(TOKEN)
_paragraph = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:(?:\r\n|\r|\n)[ \t]*)+")
_line = re.compile(r"\r\n|\r|\n")
#: End of a sentence, with closing quotes and brackets.
_sentence = re.compile(r"(?:[。！？]+|…+|[.!?]+(?=[\"'”’»）)\]」]*(?:\s|$)))[\"'”’»）)\]」]*")
PARAGRAPH, SENTENCE, LINE, TOKEN_END = 3, 2, 1, 0


def token_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of all tokens."""
    spans = [m.span() for m in _token.finditer(text)]
    a = np.array(spans, np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1]


def boundaries(text: str) -> dict[int, int]:
    """Character offset of every natural cut, with its kind."""
    at = {m.end(): LINE for m in _line.finditer(text)}
    at |= {m.end(): SENTENCE for m in _sentence.finditer(text)}
    at |= {m.end(): PARAGRAPH for m in _paragraph.finditer(text)}
    return at


def cohesion(terms: np.ndarray, block: int) -> np.ndarray:
    """Cosine of the term counts of the blocks before and after each gap 0..n."""
    n = len(terms)
    order = np.argsort(terms, kind="stable")
    same, at = terms[order], order
    dot, inner = np.zeros(n + 2), np.zeros(n + 2)
    lag = 1
    live = np.arange(n - 1)
    while len(live):
        live = live[live + lag < n]
        i, j = at[live], at[np.minimum(live + lag, n - 1)]
        ok = (same[live] == same[np.minimum(live + lag, n - 1)]) & (j - i < 2 * block)
        live, i, j = live[ok], i[ok], j[ok]
        lo, hi = np.maximum(i + 1, j - block + 1), np.minimum(j, i + block)
        dot += np.bincount(lo, minlength=n + 2) - np.bincount(hi + 1, minlength=n + 2)
        near = j - i < block
        inner += np.bincount(j[near] + 1, minlength=n + 2) - np.bincount(i[near] + block + 1, minlength=n + 2 + block)[: n + 2]
        lag += 1
    g = np.arange(n + 1)
    left = np.minimum(g, block) + 2 * np.cumsum(inner)[: n + 1]
    # pairs inside the block after gap g are those inside the block before g + block
    ends = np.minimum(g + block, n)
    tail = np.cumsum(inner)[: n + 1]
    after = np.where(g + block <= n, tail[ends], np.nan)
    short = np.flatnonzero(np.isnan(after))
    for k in short:
        c = np.unique(terms[k:], return_counts=True)[1]
        after[k] = float((c * (c - 1)).sum() / 2)
    right = np.minimum(n - g, block) + 2 * after
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = np.cumsum(dot)[: n + 1] / np.sqrt(left * right)
    return np.nan_to_num(sim)


def depths(sim: np.ndarray) -> np.ndarray:
    """How far each value lies below the peaks that follow it uphill on both sides."""

    def climb(v: np.ndarray) -> np.ndarray:
        top = v.copy()
        up = np.flatnonzero(v[:-1] >= v[1:]) + 1
        # within a run that falls towards the right, the peak is its first value
        run = np.zeros(len(v), bool)
        run[up] = True
        start = np.where(run, 0, np.arange(len(v)))
        return top[np.maximum.accumulate(start)]

    if len(sim) < 2:
        return np.zeros(len(sim))
    return (climb(sim) - sim) + (climb(sim[::-1])[::-1] - sim)


def cut_text(text: str, limit: int = 512, overlap: int = 64, block: int = 32, step: int = 1) -> list[tuple[int, int]]:
    """Character spans of the pieces.

    Every piece has at most ``limit`` tokens. The first starts at 0, each later
    one with the last ``overlap`` tokens of the piece before, and the last ends
    with the text, so nothing is lost. A text of at most ``limit`` tokens is
    one piece; an empty one has no piece.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half the limit")
    starts, ends = token_spans(text)
    n = len(starts)
    if n <= limit:
        return [(0, len(text))] if text else []
    ids: dict[str, int] = {}
    terms = np.fromiter((ids.setdefault(text[s:e].lower(), len(ids)) for s, e in zip(starts.tolist(), ends.tolist())), np.int64, n)
    sim = cohesion(terms, block)
    cuts = boundaries(text)
    at = np.array(sorted(c for c in cuts if 0 < c < len(text)), np.int64)
    kind = np.array([cuts[c] for c in at.tolist()], np.int64)
    gap = np.searchsorted(starts, at, "left")
    depth = depths(sim[gap]) if len(at) else np.zeros(0)
    every = np.arange(1, n, step)
    plain = depths(sim[every])
    out, a = [], 0
    while True:
        done = int(np.searchsorted(ends, a, "right"))
        if n - done <= limit:
            out.append((a, len(text)))
            return out
        # cuts that keep the piece within the limit and leave more than the overlap behind them
        last = done + limit
        inside = np.searchsorted(starts, at, "left")
        far = at <= starts[last]
        full = far & (inside >= done + limit // 2)
        part = far & (inside > done + overlap) & (at > a)
        b = 0
        for ok in ((full, PARAGRAPH), (full, SENTENCE), (part, PARAGRAPH), (part, SENTENCE), (full, LINE), (part, LINE)):
            k = np.flatnonzero(ok[0] & (kind == ok[1]))
            if len(k):
                best = depth[k].max()
                b = int(at[k[depth[k] >= best - 1e-12][-1]])
                break
        else:
            k = np.flatnonzero((every >= done + limit // 2) & (every <= last))
            best = plain[k].max()
            b = int(starts[every[k[plain[k] >= best - 1e-12][-1]]])
        out.append((a, b))
        have = int(np.searchsorted(starts, b, "left"))
        a = max(int(starts[have - overlap]), a) if overlap else b


def pieces(df: DataFrame, key: str, text: str, kind: str, limit: int = 512, overlap: int = 64) -> DataFrame:
    """``record_kind, record_id, piece, n_pieces, start_char, end_char, n_tokens, text_tokens, content``.

    One row per piece of each record; ``content`` is the whole piece. Repeated
    rows of an id are one record, their texts are taken as equal. Null, empty and blank texts give one row with piece 0,
    no content and 0 tokens, so no record gets lost; null ids drop out.
    """
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("txt")).where("id is not null")
    names = ["record_kind", "record_id", "piece", "n_pieces", "start_char", "end_char", "n_tokens", "text_tokens", "content"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column("id").to_pylist(), b.column("txt").to_pylist()):
                # repeated rows of an id follow each other
                if i == last:
                    continue
                last = i
                total = 0
                spans: list[tuple[int, int]] = []
                if t and not t.isspace():
                    total = sum(1 for _ in _token.finditer(t))
                    spans = cut_text(t, limit, overlap) if total > limit else [(0, len(t))]
                if not total:
                    out.append((kind, i, 0, 0, 0, 0, 0, 0, None))
                for p, (x, y) in enumerate(spans if total else []):
                    own = t[x:y]
                    out.append((kind, i, p + 1, len(spans), x, y, total if len(spans) == 1 else sum(1 for _ in _token.finditer(own)), total, own))
            a = list(zip(*out)) if out else [[]] * len(names)
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(a, types)], names=names)

    schema = "record_kind string, record_id string, piece int, n_pieces int, start_char int, end_char int, n_tokens int, text_tokens int, content string"
    return rows.repartition("id").sortWithinPartitions("id").mapInArrow(cut, schema)
