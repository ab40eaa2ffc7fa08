"""Filling containers, by a configuration linear program over lengths.

The program covers the length histogram with configurations, that is with
multisets of lengths that fit a container, using as few containers as it can.
Multiplicative weights solve it: each round prices the lengths and asks a
knapsack dynamic program for a configuration of highest price. The solution is
rounded; what rounding leaves over is filled greedily. Everything on the driver
has the size of the capacity, not of the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import with_token_counts
from tidemark.storage import written


#: Rate at which a covered share of a length lowers its price.
RATE = 2e-3
#: Configurations read from one table of the dynamic program before prices are renewed.
READS = 48
#: Items of one length that a task numbers.
SHARE = 50_000


class Pricing:
    """Knapsack dynamic program over the lengths still wanted, at given prices."""

    def __init__(self, price: np.ndarray, wanted: np.ndarray, capacity: int) -> None:
        self.capacity = capacity
        self.lengths = np.flatnonzero(wanted[: capacity + 1] > 0)
        self.price = price[self.lengths]
        self.fits = np.searchsorted(self.lengths, np.arange(capacity + 1), "right")
        best = np.zeros(capacity + 1)
        for c in range(1, capacity + 1):
            m = self.fits[c]
            best[c] = max(best[c - 1], float((best[c - self.lengths[:m]] + self.price[:m]).max())) if m else best[c - 1]
        self.best = best

    def configuration(self, left: np.ndarray, slack: float, draw: np.random.Generator | None = None) -> np.ndarray:
        """Counts per length of a configuration within ``slack`` of the highest price.

        Among equal steps one is drawn by what is ``left`` of the lengths, or the
        best is taken. No length is used more often than it is left.
        """
        out = np.zeros(self.capacity + 1, np.int64)
        room = self.capacity
        while room > 0 and self.fits[room]:
            own = self.lengths[: self.fits[room]]
            value = self.price[: len(own)] + self.best[room - own]
            have = left[own] - out[own]
            value = np.where(have > 0, value, -1.0)
            top = value.max()
            if top < 0:
                break
            if draw is None:
                pick = int(value.argmax())
            else:
                odds = np.where(value >= top - slack, np.maximum(have, 0), 0).cumsum()
                pick = int(np.searchsorted(odds, draw.random() * odds[-1], "right"))
            out[own[pick]] += 1
            room -= int(own[pick])
        return out


def best_configuration(price: np.ndarray, capacity: int, count: np.ndarray) -> np.ndarray:
    """Counts per length of the configuration of highest price, at most ``count`` of each."""
    return Pricing(price, count, capacity).configuration(count, 0.0)


def program(count: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, possibly in parts: a cover of all lengths.

    The covering program asks for the fewest containers whose configurations
    hold ``count[l]`` items of every length ``l``. A length's multiplicative
    weight starts at the dual of a program without waste, its part of the
    volume, and shrinks by a factor with every share of its items that gets
    covered; its price is the weight for each item. A round takes a
    configuration of highest price, as often as covers its scarcest length.
    Every round covers some length, so there are at most a few for each length.
    """
    draw = np.random.default_rng(7)
    left = count[: capacity + 1].astype(np.float64)
    left[0] = 0
    want = np.maximum(left, 1)
    dual = np.arange(capacity + 1) / capacity
    weight = np.ones(capacity + 1)
    used: dict[bytes, list] = {}
    while left.any():
        prices = Pricing(dual * weight, left, capacity)
        for _ in range(READS):
            config = prices.configuration(np.ceil(left), 1e-9, draw)
            if not config.any():
                break
            some = config > 0
            step = float((left[some] / config[some]).min())
            e = used.setdefault(config.tobytes(), [config, 0.0])
            e[1] += step
            left[some] = np.maximum(left[some] - step * config[some], 0)
            left[left < 1e-9] = 0
            weight[some] *= np.exp(-RATE * step * config[some] / want[some])
            if (dual @ config) < prices.best[capacity] - 0.01:
                break  # lengths that the table counts on are used up
    return [(c, x) for c, x in used.values()]


def solve(count: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, int]], int, float]:
    """Configurations (counts per length) with their number of containers; how many the program places; its value.

    ``count[l]`` items of length ``l``, 1 to ``capacity``, are covered exactly.
    The program's uses are rounded down; parts left over are rounded up while
    their items last, the largest first. What remains is filled fullest first.
    """
    left = count[: capacity + 1].astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[np.ndarray, int]] = []
    cover = program(count, capacity)
    parts = []
    for config, x in cover:
        some = config > 0
        m = min(int(x + 1e-9), int((left[some] // config[some]).min()))
        if m:
            plan.append((config, m))
            left -= m * config
        if x - m > 1e-9:
            parts.append((m - x, len(parts), config))
    for _, _, config in sorted(parts, key=lambda t: t[:2]):
        if (left >= config).all():
            plan.append((config, 1))
            left -= config
    placed = sum(m for _, m in plan)
    length = np.arange(capacity + 1, dtype=np.float64)
    while left.any():
        config = best_configuration(length, capacity, left)
        some = config > 0
        m = int((left[some] // config[some]).min())
        plan.append((config, m))
        left -= m * config
    return plan, placed, float(sum(x for _, x in cover))


def pack(sizes: DataFrame, key: str, size: str, capacity: int = 2048) -> DataFrame:
    """``id, piece, start_token, n_tokens, total_tokens, container, by_program`` of every item.

    Items of more than ``capacity`` are split into full containers and a rest;
    no other item is split. Items of size 0 or null need no room and get
    container 0. ``by_program`` tells the containers of the linear program from
    those that fill up what rounding leaves. Ids are taken as unique; null ids
    are items as well.
    """
    items = sizes.select(F.col(key).alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("total"))
    cut = items.select("id", "total", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0)))).alias("p"))
    parts = cut.select("id", "total", (F.col("p") + 1).cast("int").alias("piece"), (F.col("p") * capacity).alias("start_token"), F.least(F.col("total") - F.col("p") * capacity, F.lit(capacity)).alias("n"))
    parts = written(parts, "parts")
    lengths = parts.groupBy("n").agg(F.count("*").alias("items"))
    count = np.zeros(capacity + 1, np.int64)
    for r in lengths.collect():  # at most one row for each length up to the capacity
        count[r.n] = r["items"]
    plan, placed, _ = solve(count, capacity)
    taken, base = np.zeros(capacity + 1, np.int64), 0
    table: dict[int, list[tuple[int, int, int]]] = {}
    for config, m in plan:
        for n in np.flatnonzero(config).tolist():
            table.setdefault(n, []).append((int(taken[n]), int(config[n]), base + 1))
            taken[n] += int(config[n]) * m
        base += m
    wide = sizes.sparkSession.sparkContext.broadcast({n: tuple(np.array(c) for c in zip(*t)) for n, t in table.items()})
    # a length's items are numbered in shares by hash; a share starts where the shares before it end
    shares = sizes.sparkSession.createDataFrame([(n, -(-int(c) // SHARE)) for n, c in enumerate(count) if c], "n bigint, shares int")
    keyed = parts.join(F.broadcast(shares), "n").withColumn("share", F.pmod(F.xxhash64("id", "piece"), "shares").cast("int")).drop("shares")
    before = Window.partitionBy("n").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("n", "share").agg(F.count("*").alias("c")).withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    numbered = keyed.withColumn("r", F.row_number().over(Window.partitionBy("n", "share").orderBy("id", "piece")) - 1)
    numbered = numbered.join(starts, ["n", "share"]).select("id", "piece", "start_token", "n", "total", (F.col("r") + F.col("start")).alias("at"))
    names = ["id", "piece", "start_token", "n_tokens", "total_tokens", "container", "by_program"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wide.value
        for b in batches:
            n, at = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "at"))
            box = np.zeros(len(n), np.int64)
            for size in np.unique(n[n > 0]).tolist():
                first, per, b0 = table[size]
                own = n == size
                k = np.searchsorted(first, at[own], "right") - 1
                box[own] = b0[k] + (at[own] - first[k]) // per[k]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("piece"), b.column("start_token"), b.column("n"), b.column("total"), pa.array(box), pa.array((box > 0) & (box <= placed))], names=names)

    kind = parts.schema["id"].dataType.simpleString()
    return numbered.mapInArrow(place, f"id {kind}, piece int, start_token bigint, n_tokens bigint, total_tokens bigint, container bigint, by_program boolean")


def pack_documents(documents: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """``pack`` of whole documents, sized in tokens of a public tokenizer."""
    sizes = with_token_counts(documents.select("doc_id", "text"), "text", "n_tokens", vocabulary)
    out = pack(sizes, "doc_id", "n_tokens", capacity)
    return out.withColumnRenamed("id", "doc_id")


def container_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the share of the room that stays empty, and the share of containers from the program."""
    box = packed.where("container > 0").groupBy("container").agg(F.sum("n_tokens").alias("n"), F.bool_or("by_program").alias("by_program"))
    total = box.agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.max("n").alias("fullest"), F.count(F.when(F.col("by_program"), 1)).alias("by_program"))
    out = total.withColumn("empty_share", F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6))
    return out.withColumn("program_share", F.round(F.col("by_program") / F.col("containers"), 6)).drop("by_program")
