"""Scalar rules of scoring, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOT_MS = 300_000
#: Default weights of recency, similarity and importance.
ALPHA, BETA, GAMMA = 0.3, 0.5, 0.2
REDUNDANT_AT, MAX_PENALTY, MAX_NOVELTY = 0.95, 0.25, 0.15


def dot(a: Column, b: Column) -> Column:
    """Sum of the products of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for null or unequal lengths or a zero vector."""
    d = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (d == 0), 0.0).otherwise(dot(a, b) / d)


def unit(v: Column) -> Column:
    """Vector of length 1; unchanged where its norm is at most 1e-12."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 1e-12, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def recency(last_access_ms: Column, now_ms: Column) -> Column:
    age = F.greatest(F.lit(0.0), (now_ms - last_access_ms) / F.lit(float(DAY_MS)))
    return 1 / (1 + F.log(1 + age))


def redundancy_penalty(sim: Column) -> Column:
    return F.when(sim < REDUNDANT_AT, 0.0).otherwise(F.least(F.lit(MAX_PENALTY), sim - REDUNDANT_AT))


def novelty_bonus(sim: Column) -> Column:
    return F.least(F.lit(MAX_NOVELTY), F.greatest(F.lit(0.0), 1 - sim) * MAX_NOVELTY)


def memory_score(rec: Column, cos: Column, importance: Column, penalty: Column, novelty: Column, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA) -> Column:
    return alpha * rec + beta * cos + gamma * importance - clamp(penalty, 0.0, MAX_PENALTY) + clamp(novelty, 0.0, MAX_NOVELTY)


def reinforced(importance: Column, rate: float = 0.15) -> Column:
    return F.least(F.lit(1.0), importance + (1 - importance) * rate)


def normalized(s: Column, top: Column) -> Column:
    return F.when(s <= 0, 0.0).when(top <= 0, s).otherwise(F.least(F.lit(1.0), s / top))


def protection(hits: Column, last_ms: Column, now_ms: Column) -> Column:
    """Freshness of the last regret within a day, times a share of three hits."""
    fresh = 1 - F.least(F.lit(1.0), (now_ms - last_ms) / float(DAY_MS))
    return fresh * F.greatest(F.lit(0.34), F.least(F.lit(1.0), hits / 3))


def page_distance(nodes: Column, current: Column) -> Column:
    """Distance of a page to the current node: 0 if the page holds it, .3 if it holds one with the same first 8 characters, else 1."""
    near = F.exists(nodes, lambda n: (F.length(n) > 8) & (F.length(current) > 8) & (F.substring(n, 1, 8) == F.substring(current, 1, 8)))
    return F.when(F.array_contains(nodes, current), 0.0).when(near, 0.3).otherwise(1.0)


def page_score(rec: Column, similarity: Column, distance: Column) -> Column:
    return 0.25 * rec + 0.5 * similarity + 0.25 * (1 - distance)


def is_pinned(pinned_until_ms: Column, now_ms: Column) -> Column:
    return F.coalesce(pinned_until_ms > now_ms, F.lit(False))


def is_hot(last_access_ms: Column, now_ms: Column, window: int = HOT_MS) -> Column:
    return now_ms - last_access_ms <= window


def group_key(chain: Column, own_id: Column) -> Column:
    """Reasoning chain, or a key of its own."""
    return F.coalesce(chain, F.concat(F.lit("__self__:"), own_id))


def gain(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)
