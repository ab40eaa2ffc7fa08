"""Stateful operators over event streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import replaying


def _rows(parts: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat([p for p in parts if len(p)]).sort_values(list(by))


def regrets(evictions: DataFrame, recalls: DataFrame, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Stream-stream interval join; ``evict_ts`` and ``recall_ts`` are event times.

    Both sides keep state only as long as a partner within ``window`` may come.
    """
    e, r = evictions.withWatermark("evict_ts", late).alias("e"), recalls.withWatermark("recall_ts", late).alias("r")
    on = (F.col(f"e.{key}") == F.col(f"r.{key}")) & (F.col("recall_ts") >= F.col("evict_ts")) & (F.col("recall_ts") <= F.col("evict_ts") + F.expr(f"interval {window}"))
    return e.join(r, on).drop(F.col(f"r.{key}"))


def _expire(state: GroupState, at_ms: int) -> None:
    """Let the state time out at an event time, or with the next watermark if that has passed."""
    state.setTimeoutTimestamp(max(at_ms, state.getCurrentWatermarkMs() + 1))


def executions(requests: DataFrame, ttl_ms: int = 86_400_000, late: str = "10 minutes") -> DataFrame:
    """NEW, REPLAY or CONFLICT per request, with one open record of state per key.

    ``ts`` is the event time. A record leaves the state once the watermark has passed its life.
    """

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        g = _rows(parts, "ts_ms", "n")
        start, held = state.get if state.exists else (None, None)
        out = []
        for t, h in zip(g["ts_ms"], g["hash"]):
            if start is None or t - start >= ttl_ms:
                start, held = int(t), h
                out.append("NEW")
            else:
                out.append("REPLAY" if h == held else "CONFLICT")
        state.update((start, held))
        _expire(state, start + ttl_ms)
        yield pd.DataFrame({"key": key[0], "n": g["n"], "outcome": out})

    return requests.withWatermark("ts", late).groupBy("key").applyInPandasWithState(fold, "key string, n bigint, outcome string", "start bigint, held string", "append", GroupStateTimeout.EventTimeTimeout)


def replay(log: DataFrame) -> DataFrame:
    """State of a task after each batch; entries at or below the last sequence are ignored."""

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else replaying.new_state()
        for seq, op, payload, ts in _rows(parts, "seq").drop_duplicates("entry_id")[["seq", "operation", "payload", "ts_ms"]].itertuples(index=False):
            replaying.apply(s, int(seq), op, payload, int(ts))
        state.update((json.dumps(s),))
        yield pd.DataFrame([replaying.result(key[0], s)], columns=[c.split()[0] for c in replaying.OUTPUT.split(", ")]).astype({"error_seq": "Int64"})

    return log.groupBy("task_id").applyInPandasWithState(fold, replaying.OUTPUT, "state string", "update", GroupStateTimeout.NoTimeout)


def rolling(samples: DataFrame, key: str, window: int = 512) -> DataFrame:
    """p95 and p99 of the newest ``window`` samples of each key, by nearest rank."""

    def fold(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        g = _rows(parts, "ts_ms", "n")
        held = [*(state.get[0] if state.exists else []), *g["value"].tolist()][-window:]
        state.update((held,))
        s = sorted(held)
        rank = lambda p: s[max(0, min(len(s), -int(-(p * len(s)) // 1)) - 1)]
        yield pd.DataFrame([(k[0], len(s), rank(0.95), rank(0.99))], columns=[key, "samples", "p95", "p99"])

    return samples.groupBy(key).applyInPandasWithState(fold, f"{key} string, samples bigint, p95 double, p99 double", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def consumed_once(events: DataFrame, ttl_ms: int = 1_800_000, late: str = "10 minutes") -> DataFrame:
    """Sessions (``kind`` open) and the first feedback (``kind`` use) within their life; each is used once.

    ``ts`` is the event time. A key without a live session leaves the state.
    """

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        g = _rows(parts, "ts_ms", "n")
        live = list(zip(*state.get)) if state.exists else []
        out = []
        for t, n, kind in zip(g["ts_ms"], g["n"], g["kind"]):
            live = [(s, i) for s, i in live if t - s <= ttl_ms]
            if kind == "open":
                live.append((int(t), int(n)))
            elif live:
                out.append((key[0], live.pop(0)[1], int(n)))
        state.update(([s for s, _ in live], [i for _, i in live]))
        _expire(state, max((s for s, _ in live), default=0) + ttl_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "session_id", "feedback_id"])

    return events.withWatermark("ts", late).groupBy("key").applyInPandasWithState(fold, "key string, session_id bigint, feedback_id bigint", "started array<bigint>, ids array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def pin_sweeps(pins: DataFrame, every_ms: int = 30_000) -> DataFrame:
    """``id, sweep_ms`` of the pins that a sweep releases, one sweep each ``every_ms``.

    ``pins`` has ``key, id, ts_ms`` and ``until_ms``, null without a pin. A key's
    clock is its newest row. The state holds the key's live pins.
    """

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        g = _rows(parts, "ts_ms", "id")
        clock, due, ids = state.get if state.exists else (0, [], [])
        clock = max(clock, int(g["ts_ms"].max()))
        new = g[g["until_ms"].notna()]
        due = [*due, *(-(-int(u) // every_ms) * every_ms for u in new["until_ms"])]
        ids = [*ids, *new["id"]]
        gone = [(i, t) for i, t in zip(ids, due) if t <= clock]
        live = [(i, t) for i, t in zip(ids, due) if t > clock]
        state.update((clock, [t for _, t in live], [i for i, _ in live]))
        if gone:
            yield pd.DataFrame(gone, columns=["id", "sweep_ms"])

    return pins.groupBy("key").applyInPandasWithState(fold, "id string, sweep_ms bigint", "clock bigint, due array<bigint>, ids array<string>", "append", GroupStateTimeout.NoTimeout)


def triggers(log: DataFrame, every: int = 50, wait_ms: int = 60_000) -> DataFrame:
    """A row when a task has ``every`` entries since its last checkpoint, or the first of them is ``wait_ms`` old."""

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        g = _rows(parts, "seq")
        n, since, done = state.get if state.exists else (0, None, 0)
        out = []
        for seq, t in zip(g["seq"], g["ts_ms"]):
            n, since = n + 1, int(t) if since is None else since
            if n >= every or t - since >= wait_ms:
                done += 1
                out.append((key[0], int(seq), done))
                n, since = 0, None
        state.update((n, since, done))
        if out:
            yield pd.DataFrame(out, columns=["task_id", "seq", "checkpoint_no"])

    return log.groupBy("task_id").applyInPandasWithState(fold, "task_id string, seq bigint, checkpoint_no bigint", "n bigint, since bigint, done bigint", "append", GroupStateTimeout.NoTimeout)


def windows(events: DataFrame, time: str, kind: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums over tumbling (1 hour), sliding (1 hour by 30 minutes) or session (30 minutes gap per user) windows."""
    e = events.withWatermark(time, late)
    if kind == "session":
        g = e.groupBy(F.session_window(time, "30 minutes").alias("w"), "user_id")
    else:
        w = F.window(time, "1 hour", "30 minutes") if kind == "sliding" else F.window(time, "1 hour")
        g = e.groupBy(w.alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
