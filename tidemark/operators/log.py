"""Action logs, checkpoints and execution records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.operators import replaying
from tidemark.operators.folding import Rows, folded
from tidemark.storage import written

TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
EXECUTION_TTL_MS = 86_400_000


def first_of_each_entry(log: DataFrame) -> DataFrame:
    """The log without repeated entries: the lowest sequence of each entry id stays."""
    w = Window.partitionBy("task_id", "entry_id").orderBy("seq")
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_by(log: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Values of the entry of highest sequence of each key."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), "seq").alias("_l")).select(*keys, *(F.col(f"_l.{v}").alias(v) for v in values))


def context(log: DataFrame) -> DataFrame:
    """Last value of every context key; an empty value deletes the key."""
    return last_by(log, ["task_id", "key"], "value").where("value <> ''")


def status(log: DataFrame) -> DataFrame:
    """Replayed status: terminal without finalization is pending, RECOVERING runs again."""
    s = last_by(log, ["task_id"], "status", "finalized")
    out = F.when(F.col("status").isin(*TERMINAL) & ~F.col("finalized"), "PENDING_FINALIZATION").when(F.col("status") == "RECOVERING", "RUNNING").otherwise(F.col("status"))
    return s.select("task_id", out.alias("status"))


def tools(log: DataFrame) -> DataFrame:
    """State of every tool execution: RUNNING, SUCCEEDED, FAILED or ORPHAN (ended, never started)."""
    op = F.col("operation")
    g = log.groupBy("task_id", "execution_id").agg(F.min(F.when(op == "START_TOOL_EXECUTION", F.col("seq"))).alias("started"), F.max_by(op, "seq").alias("last"), F.min("seq").alias("first"))
    state = F.when(F.col("started").isNull() | (F.col("first") < F.col("started")), "ORPHAN").when(F.col("last") == "COMPLETE_TOOL_EXECUTION", "SUCCEEDED").when(F.col("last") == "FAIL_TOOL_EXECUTION", "FAILED").otherwise("RUNNING")
    return g.select("task_id", "execution_id", state.alias("state"))


def llm_calls(log: DataFrame) -> DataFrame:
    """State, attempts and retryable flag of every model call since its last start."""
    op = F.col("operation")
    start = F.max(F.when(op == "START", F.col("seq"))).over(Window.partitionBy("task_id", "call_id"))
    live = log.withColumn("_s", start).where("_s is not null and seq >= _s")
    g = live.groupBy("task_id", "call_id").agg(F.max_by("operation", "seq").alias("last"), (1 + F.sum((op == "RETRY").cast("bigint"))).alias("attempts"), F.max(F.when(op == "TIMEOUT", F.col("seq"))).alias("_t"), F.max(F.when(op == "COMPLETE", F.col("seq"))).alias("_c"))
    state = F.when(F.col("last") == "COMPLETE", "SUCCEEDED").when(F.col("last") == "TIMEOUT", "TIMED_OUT").otherwise("RUNNING")
    return g.select("task_id", "call_id", state.alias("state"), "attempts", (F.col("_t").isNotNull() & (F.col("_c").isNull() | (F.col("_c") < F.col("_t")))).alias("retryable"))


def conversations(log: DataFrame) -> DataFrame:
    """Messages of every conversation in order, with first and last time."""
    m = log.groupBy("task_id", "conversation_id").agg(F.sort_array(F.collect_list(F.struct("seq", "message"))).alias("m"), F.min("ts_ms").alias("created_ms"), F.max("ts_ms").alias("updated_ms"))
    return m.select("task_id", "conversation_id", F.concat_ws("\n", F.col("m.message")).alias("messages"), F.size("m").cast("bigint").alias("n"), "created_ms", "updated_ms")


def surviving(log: DataFrame, key: str, delete: Column) -> DataFrame:
    """Keys whose last entry isn't a deletion, with the sequence of that entry."""
    return log.groupBy("task_id", key).agg(F.max("seq").alias("seq"), F.max_by(delete, "seq").alias("_d")).where("not _d").drop("_d")


def since_full(checkpoints: DataFrame) -> DataFrame:
    """Adds ``deltas``: checkpoints since the last full one of the task."""
    w = Window.partitionBy("task_id").orderBy("created_ms", "checkpoint_id")
    island = F.sum((F.col("kind") == "FULL").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = checkpoints.withColumn("island", island)
    return c.withColumn("deltas", F.sum((F.col("kind") != "FULL").cast("bigint")).over(Window.partitionBy("task_id", "island").orderBy("created_ms", "checkpoint_id").rowsBetween(Window.unboundedPreceding, 0)))


def next_kind(checkpoints: DataFrame, most: int = 10) -> DataFrame:
    """FULL or DELTA for each task's next checkpoint."""
    last = since_full(checkpoints).groupBy("task_id").agg(F.max("island").alias("i"), F.max_by("deltas", F.struct("created_ms", "checkpoint_id")).alias("deltas"))
    return last.select("task_id", F.when((F.col("i") == 0) | (F.col("deltas") >= most), "FULL").otherwise("DELTA").alias("next_kind"), "deltas")


def base_chains(checkpoints: DataFrame) -> DataFrame:
    """``checkpoint_id, root_id, depth, root_kind``: where the chain of bases of each checkpoint ends.

    A base that doesn't exist ends the chain at the checkpoint that names it. A
    chain that never ends has root_kind ``CYCLE`` and no root. Pointers are
    doubled each round, and checkpoints that have reached their root drop out, so
    the rounds are logarithmic in the longest chain. Chains have every length up
    to their longest, so a round in which no checkpoint arrives leaves cycles only.
    """
    own = checkpoints.select("checkpoint_id", "base_id", "kind")
    known = own.select(F.col("checkpoint_id").alias("base_id"), F.lit(True).alias("_k"))
    p = own.join(known, "base_id", "left").select("checkpoint_id", F.when(F.col("_k"), F.col("base_id")).alias("to"), "kind")
    done = F.col("to").isNull()
    p = written(p.select("checkpoint_id", F.coalesce("to", "checkpoint_id").alias("to"), F.when(done, 0).otherwise(1).cast("bigint").alias("d"), done.alias("done"), "kind"), "chain")
    left, before = -1, -2
    while left != 0 and left != before:
        before = left
        q = p.select(F.col("checkpoint_id").alias("_c"), F.col("to").alias("_t"), F.col("d").alias("_d"), F.col("done").alias("_done"), F.col("kind").alias("_kind"))
        step = p.where("not done").join(q, F.col("to") == F.col("_c")).select("checkpoint_id", F.col("_t").alias("to"), (F.col("d") + F.col("_d")).alias("d"), F.col("_done").alias("done"), F.col("_kind").alias("kind"))
        seen = Observation()
        step = written(step.observe(seen, F.count(F.when(~F.col("done"), 1)).alias("left")), "chain")
        left = seen.get["left"]
        p = p.where("done").unionByName(step)
    there = lambda c: F.when(F.col("done"), F.col(c))
    return p.select("checkpoint_id", there("to").alias("root_id"), there("d").alias("depth"), F.coalesce(there("kind"), F.lit("CYCLE")).alias("root_kind"))


def retained(checkpoints: DataFrame, chains: DataFrame, now_ms: Column, days: int = 7, newest: int = 20) -> DataFrame:
    """Checkpoints young or new enough, with the bases that the newest of each task needs."""
    w = Window.partitionBy("task_id").orderBy(F.col("created_ms").desc(), F.col("checkpoint_id").desc())
    c = checkpoints.withColumn("place", F.row_number().over(w)).withColumn("age", F.floor((now_ms - F.col("created_ms")) / 86_400_000)).join(chains, "checkpoint_id")
    live = (F.col("age") <= days) & (F.col("place") <= newest)
    c = c.withColumn("live", live)
    top = Window.partitionBy("task_id")
    # everything of the chain from the root of a kept or newest checkpoint up to it
    need = F.max(F.when(F.col("live") | (F.col("place") == 1), F.col("depth"))).over(Window.partitionBy("task_id", "root_id"))
    return c.withColumn("need", need).where(F.col("live") | (F.col("depth") <= F.col("need"))).select("task_id", "checkpoint_id", "live", F.count("*").over(top).alias("kept"))


def executions(requests: DataFrame, ttl_ms: int = EXECUTION_TTL_MS) -> DataFrame:
    """NEW, REPLAY or CONFLICT of every request (``key, hash, ts_ms, n``).

    A request opens a record when its key has none or an expired one; within
    the record's life the same hash is a replay and another a conflict.
    """

    def step(key: str, s: dict, g: Rows) -> list[tuple]:
        out, opened, held = [], s.get("opened"), s.get("held")
        for n, t, h in zip(g["n"], g["ts_ms"], g["hash"]):
            if opened is None or t - opened >= ttl_ms:
                opened, held = t, h
                out.append((key, n, "NEW"))
            else:
                out.append((key, n, "REPLAY" if h == held else "CONFLICT"))
        s["opened"], s["held"] = opened, held
        return out

    return folded(requests.select("key", "hash", "ts_ms", "n"), "key", ["ts_ms", "n"], "key string, n bigint, outcome string", dict, step)


def replay(log: DataFrame) -> DataFrame:
    """State of every task after its whole log, a row of ``replaying.OUTPUT``.

    ``log`` has ``task_id, seq, entry_id, operation, payload`` (map<string,string>)
    and ``ts_ms``. Entries may come in any order and more than once. An entry
    that the state can't take ends the replay of its task with an ``error``.
    """

    def step(_: str, s: dict, g: Rows) -> None:
        for e in zip(g["seq"], g["operation"], g["payload"], g["ts_ms"]):
            replaying.apply(s, *e)

    first = first_of_each_entry(log.select("task_id", "seq", "entry_id", "operation", "payload", "ts_ms"))
    return folded(first, "task_id", ["seq"], replaying.OUTPUT, replaying.new_state, step, lambda task, s: [replaying.result(task, s)])


def apply_delta(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Rows after a delta: changed rows replace, rows with ``deleted`` go."""
    both = base.withColumn("deleted", F.lit(False)).withColumn("_o", F.lit(0)).unionByName(delta.withColumn("_o", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.col("_o").desc())
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1 and not deleted").drop("_r", "_o", "deleted")


def graph_delta(touches: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a stretch of a log changes in a graph: nodes (``alive`` at its end, ``cut`` if deleted in it) and edges left at its end.

    ``touches`` has ``task_id, node, seq, alive`` and ``links`` ``task_id, src, dst, seq``.
    """
    n = touches.groupBy("task_id", "node").agg(F.max_by("alive", "seq").alias("alive"), F.max(F.when(~F.col("alive"), F.col("seq"))).alias("gone"))
    gone = n.where("gone is not null").select("task_id", "node", "gone")
    e = links.groupBy("task_id", "src", "dst").agg(F.max("seq").alias("seq"))
    for side in ("src", "dst"):
        e = e.join(gone.select("task_id", F.col("node").alias(side), F.col("gone").alias(f"_{side}")), ["task_id", side], "left")
    kept = e.where(F.col("seq") > F.greatest(F.coalesce("_src", F.lit(0)), F.coalesce("_dst", F.lit(0)))).select("task_id", "src", "dst")
    return n.select("task_id", "node", "alive", F.col("gone").isNotNull().alias("cut")), kept


def apply_graph_deltas(deltas: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a base and its deltas, oldest first.

    The last delta that has a node decides on it. A deletion takes along the edges
    that earlier deltas put at the node, even if the node has come back.
    """
    nodes = edges = None
    for depth, (n, e) in enumerate(deltas):
        n, e = n.withColumn("depth", F.lit(depth)), e.withColumn("depth", F.lit(depth))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    last = nodes.groupBy("task_id", "node").agg(F.max_by("alive", "depth").alias("alive"), F.max(F.when(F.col("cut"), F.col("depth"))).alias("at"))
    cuts = last.where("at is not null").select("task_id", "node", "at")
    left = edges.groupBy("task_id", "src", "dst").agg(F.max("depth").alias("depth"))
    for side in ("src", "dst"):
        left = left.join(cuts.select("task_id", F.col("node").alias(side), F.col("at").alias(f"_{side}")), ["task_id", side], "left")
    left = left.where(F.col("depth") >= F.greatest(F.coalesce("_src", F.lit(0)), F.coalesce("_dst", F.lit(0)))).select("task_id", "src", "dst")
    return last.where("alive").select("task_id", "node"), left


def triggers(log: DataFrame, every: int = 50, wait_ms: int = 60_000) -> DataFrame:
    """``task_id, seq, checkpoint_no``: entries at which a checkpoint is due.

    Due after ``every`` entries since the last one, or when the first of them is ``wait_ms`` old.
    """

    def step(task: str, s: dict, g: Rows) -> list[tuple]:
        out = []
        for seq, t in zip(g["seq"], g["ts_ms"]):
            s["n"] += 1
            s["since"] = t if s["since"] is None else s["since"]
            if s["n"] >= every or t - s["since"] >= wait_ms:
                s["done"] += 1
                out.append((task, seq, s["done"]))
                s["n"], s["since"] = 0, None
        return out

    return folded(log.select("task_id", "seq", "ts_ms"), "task_id", ["seq"], "task_id string, seq bigint, checkpoint_no bigint", lambda: {"n": 0, "since": None, "done": 0}, step)
