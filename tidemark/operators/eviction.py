"""Eviction, quotas and regret."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.folding import Rows, folded

HOUR_MS = 3_600_000


def regrets(evictions: DataFrame, recalls: DataFrame, key: str, window_ms: int = HOUR_MS) -> DataFrame:
    """Eviction and recall rows of one key with ``0 <= recall_ms - evict_ms <= window_ms``.

    Time is cut into buckets of the window's length and each eviction looks
    into its own and the next bucket, so the join has an equality on bucket and
    never compares a key's whole history.
    """
    e = evictions.withColumn("_b", F.explode(F.array(F.floor(F.col("evict_ms") / window_ms), F.floor(F.col("evict_ms") / window_ms) + 1)))
    r = recalls.withColumn("_b", F.floor(F.col("recall_ms") / window_ms))
    return e.join(r, [key, "_b"]).where((F.col("recall_ms") >= F.col("evict_ms")) & (F.col("recall_ms") - F.col("evict_ms") <= window_ms)).drop("_b")


def usage(df: DataFrame, namespace: str, tokens: str) -> DataFrame:
    return df.where(F.col(namespace).isNotNull()).groupBy(F.col(namespace).alias("namespace")).agg(F.sum(tokens).alias("used"))


def quotas(used: DataFrame, capacity: int, hard_share: float = 0.25, soft_share: float = 0.15, min_hard: int = 20) -> DataFrame:
    """One row of pool limits over the usage of all namespaces."""
    n = used.agg(F.count("*").alias("n"))
    hard = F.least(F.greatest(F.lit(min_hard), F.floor(F.lit(capacity * hard_share))), F.greatest(F.lit(1), F.floor(capacity / F.col("n")))).cast("bigint")
    limits = n.select("n", hard.alias("hard")).withColumn("soft", F.greatest(F.lit(1), F.least(F.col("hard"), F.lit(int(capacity * soft_share)))).cast("bigint"))
    each = used.join(F.broadcast(limits))
    total = each.groupBy("n", "hard", "soft").agg(F.sum(F.least("used", "hard")).alias("protected"), F.sum(F.greatest(F.lit(0), F.col("used") - F.col("hard"))).alias("reclaimable"))
    return total.withColumn("borrow_capacity", F.greatest(F.lit(0), capacity - F.col("protected")))


def group_totals(fragments: DataFrame, group: Column, pinned: Column | None = None) -> DataFrame:
    """Token sum, mean score and density of every group, over all members; ``loose`` if one isn't pinned."""
    g = fragments.withColumn("grp", group).withColumn("_p", F.lit(False) if pinned is None else pinned)
    g = g.groupBy("namespace", "grp").agg(F.sum("token_count").cast("bigint").alias("group_tokens"), F.avg("score").alias("group_score"), F.bool_or(~F.col("_p")).alias("loose"))
    return g.withColumn("density", F.col("group_score") / F.greatest(F.lit(1), F.col("group_tokens")))


def until_target(df: DataFrame, partition: list[str], order: list[Column], amount: str, target: int) -> DataFrame:
    """Rows in order while the amount released before them is below the target."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("released_before", F.coalesce(F.sum(amount).over(w), F.lit(0))).where(F.col("released_before") < target)


def evict_with_floor(groups: DataFrame, target: int, floor: int) -> DataFrame:
    """``namespace, grp, released``: groups in density order until the target, never under the floor.

    A group whose release would leave its namespace below ``floor`` tokens is
    skipped. Namespaces are independent.
    """
    total = groups.groupBy("namespace").agg(F.sum("group_tokens").alias("left"))

    def step(key: str, s: dict, g: Rows) -> list[tuple]:
        out = []
        for grp, t, left in zip(g["grp"], g["group_tokens"], g["left"]):
            if s["done"] < target and left - s["done"] - t >= floor:
                s["done"] += int(t)
                out.append((key, grp, int(t)))
        return out

    rows = groups.join(total, "namespace").select("namespace", "grp", "density", "group_tokens", "left")
    return folded(rows, "namespace", ["density", "grp"], "namespace string, grp string, released bigint", lambda: {"done": 0}, step)


def admissions(requests: DataFrame, capacity: int, quota: int) -> DataFrame:
    """``key, seq, decision`` of admission requests against per-key capacity, in order.

    A request beyond the capacity is rejected. If it fits only after pinned
    tokens, the oldest unpinned entries are evicted first; entries beyond the
    quota go before the others. Columns: ``key, seq, tokens, pinned``.
    """

    def step(key: str, s: dict, g: Rows) -> list[tuple]:
        held, out = s["held"], []
        for seq, tokens, pinned in zip(g["seq"], g["tokens"], g["pinned"]):
            if tokens > capacity or s["fixed"] + tokens > capacity:
                out.append((key, seq, "REJECTED", 0))
                continue
            evicted = 0
            while held and s["fixed"] + s["loose"] + tokens > (capacity if pinned else quota):
                t = held.popleft()
                s["loose"] -= t
                evicted += t
            if pinned:
                s["fixed"] += int(tokens)
            else:
                held.append(int(tokens))
                s["loose"] += int(tokens)
            out.append((key, seq, "ADMITTED_AFTER_RECLAIM" if evicted else "ADMITTED", evicted))
        return out

    # what is held has at most ``capacity`` tokens
    return folded(requests, "key", ["seq"], "key string, seq bigint, decision string, evicted bigint", lambda: {"held": deque(), "fixed": 0, "loose": 0}, step)
