"""Learning of score weights: arms, exploration, updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.folding import Rows, folded


def arms(spark: SparkSession) -> DataFrame:
    """Grid of weight triples on the simplex, numbered in order."""
    a = spark.range(1, 9).select((F.col("id") / 10).alias("alpha")).withColumn("beta", F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda b: b / 10)))
    g = a.withColumn("gamma", F.round(1.0 - F.col("alpha") - F.col("beta"), 6)).where("gamma between 0.05 and 0.9")
    return g.withColumn("arm", F.row_number().over(Window.orderBy("alpha", "beta")).cast("bigint"))  # 36 rows


def mixture(weights: DataFrame, epsilon: float) -> DataFrame:
    """Adds ``p``: share of the weight mixed with uniform exploration."""
    total = weights.agg(F.sum("weight").alias("_w"), F.count("*").alias("_n"))
    out = weights.join(F.broadcast(total))
    return out.withColumn("p", (1 - epsilon) * F.col("weight") / F.col("_w") + F.lit(epsilon) / F.col("_n")).drop("_w", "_n")


def best_two(weights: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("weight").desc(), "arm")
    r = weights.withColumn("r", F.row_number().over(w)).where("r <= 2")
    return r.groupBy(key).agg(F.max(F.when(F.col("r") == 1, F.col("arm"))).alias("best"), F.max(F.when(F.col("r") == 2, F.col("arm"))).alias("second"))


def first_feedback(events: DataFrame, key: str, ttl_ms: int, most: int) -> DataFrame:
    """``session_id, feedback_id``: the first feedback of every session; a session is used once.

    ``events`` has ``event_id, ts_ms, opens`` (1 for a session, 0 for feedback)
    and ``opened``, the sessions opened so far. Feedback goes to its key's newest
    session, if that is no older than ``ttl_ms`` and still among the newest ``most``.
    """
    w = Window.partitionBy(key).orderBy("ts_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("opens") == 1, F.struct("ts_ms", "event_id", "opened")), ignorenulls=True).over(w)
    f = events.withColumn("s", own).where((F.col("opens") == 0) & F.col("s").isNotNull() & (F.col("ts_ms") - F.col("s.ts_ms") <= ttl_ms) & (F.col("opened") - F.col("s.opened") < most))
    return f.groupBy(F.col("s.event_id").alias("session_id")).agg(F.min_by("event_id", F.struct("ts_ms", "event_id")).alias("feedback_id"))


def eligible(streak_ms: Column, samples: Column, win: Column, lift: Column) -> Column:
    """Whether a shadow profile may take over."""
    return (streak_ms >= 14 * 86_400_000) & (samples >= 20) & (win >= 0.9) & (lift >= 0.2)


def prefetch_budget(samples: Column, hit_rate: Column, budget: int) -> Column:
    """Budget cut by a low hit rate; unchanged below 8 samples."""
    low = F.when(hit_rate == 0, 0).otherwise(1)
    return F.when(samples < 8, budget).when(hit_rate < 0.1, low).when(hit_rate < 0.25, -(-budget // 2)).otherwise(budget)


def exp3(pulls: DataFrame, n_arms: int, rate: float = 0.5, warm: int = 100) -> DataFrame:
    """``scenario, recalls, epsilon, best_arm, best_p`` after all pulls, in time order.

    Exploration stays at .30 for the first ``warm`` pulls, then shrinks by 3 %
    a pull to .05, and grows by 10 % up to .30 after 40 pulls without a better
    mean reward. With ``shadow_arm`` and ``shadow_reward``, the shadow arm of a pull
    learns as well. A scenario's state is one vector of arm weights.
    """
    shadowed = {"shadow_arm", "shadow_reward"} <= set(pulls.columns)

    def start() -> dict:
        return {"w": np.ones(n_arms), "eps": 0.3, "best": -np.inf, "still": 0, "mean": 0.0, "n": 0}

    def learn(s: dict, arm: int | None, reward: float | None) -> None:
        if arm is None or not 0 <= arm < n_arms or reward is None:
            return
        w = s["w"]
        p = (1 - s["eps"]) * w[arm] / w.sum() + s["eps"] / n_arms
        w[arm] *= np.exp(rate / np.sqrt(s["n"] + 1) * (reward / p) / n_arms)
        w /= w.max()

    def step(_: str, s: dict, g: Rows) -> None:
        none = [None] * len(g)
        for arm, reward, shadow, its in zip(g["arm"], g["reward"], g["shadow_arm"] if shadowed else none, g["shadow_reward"] if shadowed else none):
            learn(s, arm, reward)
            learn(s, shadow, its)
            s["n"] += 1
            s["mean"] += (reward - s["mean"]) / s["n"]
            better = s["mean"] > s["best"] + 1e-12
            s["best"], s["still"] = (s["mean"], 0) if better else (s["best"], s["still"] + 1)
            if s["n"] > warm:
                s["eps"] = max(0.05, s["eps"] * 0.97)
                if s["still"] >= 40:
                    s["eps"], s["still"] = min(0.3, s["eps"] * 1.1), 0

    def finish(key: str, s: dict) -> list[tuple]:
        p = (1 - s["eps"]) * s["w"] / s["w"].sum() + s["eps"] / n_arms
        return [(key, s["n"], s["eps"], int(p.argmax()), float(p.max()))]

    return folded(pulls, "scenario", ["ts_ms", "n"], "scenario string, recalls bigint, epsilon double, best_arm int, best_p double", start, step, finish)


def simplex(alpha: float, beta: float, gamma: float, low: float = 0.05, high: float = 0.90) -> tuple[float, float, float]:
    """Weights clamped to ``[low, high]`` and rebalanced to sum to 1."""
    w = [min(high, max(low, x)) for x in (alpha, beta, gamma)]
    for _ in range(20):
        s = sum(w)
        w = [x / s for x in w]
        c = [min(high, max(low, x)) for x in w]
        if c == w:
            break
        w = c
    return tuple(w)
