"""Near-duplicate texts by set overlap, counted in vertical fragments.

The n-grams of all texts get one global order, rarest first. The order is cut
into consecutive ranges of equal load, the vertical fragments, as many as the
size of a group asks for. Each fragment joins the segments of the group's sets
that lie in its range, by the n-grams of their prefixes, and forms the pairs that the
sketches of the whole sets allow. Pairs are decided by the sum of their partial
overlaps, or by their whole sets where some fragment does not know them.

A text's terms are the runs of a-z and 0-9 and the single Han characters of
its lower-cased form; its set holds the distinct ordered pairs of adjacent
terms. Texts with equal sets in one group form a class, which is joined once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import clean_name
from tidemark.llm.arrays import chunks, summed
from tidemark.storage import written

TERM = re.compile("[a-z0-9]+|[一-鿿]")
#: An n-gram is kept as six bytes of its hash.
WIDTH = 6
#: Size of the table of n-gram counts, the same for any corpus: 4 MB.
ORDER_BITS = 20
#: Bits of the filter that spares classes without partner a shuffle; 1 MB.
FILTER_BITS = 23
#: N-grams of a group that are one fragment; a group with more has two at least.
SMALL_GROUP = 2_000
#: N-grams of a group for each further fragment.
FRAGMENT_GRAMS = 1_000_000
#: N-grams that a task joins at once, unless one fragment has more.
BATCH_GRAMS = 1_000_000
#: Bits of the sketch that a segment carries of its set: twice the n-grams, a power of two, within these.
SKETCH_BITS = 64, 1024
_EPS = 1e-9
_terms: dict[str, int] = {}


def _term_hash(t: str) -> int:
    h = _terms.get(t)
    if h is None:
        if len(_terms) > 300_000:
            _terms.clear()
        h = _terms[t] = xxhash.xxh3_64_intdigest(t)
    return h


def gram_set(text: str | None) -> np.ndarray:
    """Sorted distinct 48-bit hashes of a text's adjacent term pairs."""
    terms = TERM.findall(text.lower()) if text else []
    if len(terms) < 2:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_term_hash, terms), np.uint64, len(terms))
    with np.errstate(over="ignore"):
        x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[1:] >> np.uint64(29)))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(x >> np.uint64(16))


def _pack(v: np.ndarray) -> bytes:
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    if not len(column):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = (offsets[-1] - offsets[0]) // WIDTH
    if not size:
        return np.empty(0, np.uint64), np.diff(offsets) // WIDTH
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(size, WIDTH)
    out = np.zeros((size, 8), np.uint8)
    out[:, :WIDTH] = raw
    return out.view("<u8").ravel(), np.diff(offsets) // WIDTH


def gram_table(df: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """``id, grp, cls, n, grams`` of every record with a group and a non-empty set.

    ``cls`` is a 128-bit hash of group and set, so copies share it. Rows with a
    null key, a null or blank group or a text of fewer than two terms drop out.
    """
    rows = df.select(F.col(key).alias("id"), clean_name(F.col(group)).alias("grp"), F.col(text).alias("txt"))
    rows = rows.where("id is not null and grp is not null and txt is not null")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, groups, cls, sizes, grams, keep = b.column("id"), b.column("grp"), [], [], [], []
            for k, (g, t) in enumerate(zip(groups.to_pylist(), b.column("txt").to_pylist())):
                s = gram_set(t)
                if len(s):
                    p = _pack(s)
                    keep.append(k)
                    sizes.append(len(s))
                    grams.append(p)
                    cls.append(xxhash.xxh3_128_digest(g.encode() + b"\0" + p))
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(at), groups.take(at), pa.array(cls, pa.binary()), pa.array(sizes, pa.int32()), pa.array(grams, pa.binary())], names=["id", "grp", "cls", "n", "grams"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(parse, f"id {kind}, grp string, cls binary, n int, grams binary")


def global_order(table: DataFrame, bits: int = ORDER_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every hash bucket, rarest first, and the share of all n-grams before its end.

    Each task counts all its n-grams into ``2**bits`` buckets; the sum of these
    arrays is the only thing that reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.int64)
        for b in batches:
            grams, _ = _unpack(b.column(0))
            n += np.bincount((grams & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        yield chunks(np.minimum(n, 2**32 - 1).astype(np.uint32))

    counts = summed(table.select("grams").mapInArrow(count, "chunk int, part binary"), bits, "<u4", lambda a, b: np.minimum(a.astype(np.int64) + b, 2**32 - 1).astype(np.uint32))
    order = np.argsort(counts, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    load = np.cumsum(counts[order].astype(np.float64))
    return rank, (load / max(load[-1], 1)).astype(np.float32)


def _ordered(grams: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's n-grams in the global order, with their ranks."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    r = rank[(grams & np.uint64(len(rank) - 1)).astype(np.int64)]
    o = np.lexsort((grams, r, row))
    return grams[o], r[o].astype(np.int64)


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of every run, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length - start, length)


def needed(a, b, t: float):
    """Least overlap of two sets of these sizes at similarity ``t``."""
    return np.ceil(t / (1 + t) * (a + b) - _EPS)


def _sketches(grams: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """Bits of the hashed n-grams of each set that is wanted; the others have an empty sketch."""
    least, most = SKETCH_BITS
    width = np.clip(1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64), least, most)
    row = np.repeat(np.arange(len(sizes)), sizes)
    on = np.zeros((len(sizes), most), bool)
    # the low bits order the n-grams, so that others are taken
    on[row, (grams >> np.uint64(24)).astype(np.int64) & (width[row] - 1)] = True
    size = np.where(wanted, width // 8, 0)
    raw = np.packbits(on, axis=1, bitorder="little")[np.arange(most // 8) < size[:, None]]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


class _Bound:
    """Upper bounds of the overlaps of sets, from their sketches.

    A bit that one of two sketches has comes from an n-gram that only one of the
    sets has, so their difference has at least as many. A wide sketch is folded
    to the width of the other. A set without sketch bounds nothing.
    """

    def __init__(self, column: pa.Array, n: np.ndarray) -> None:
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        words = np.frombuffer(column.buffers()[2] or b"", "<u8")
        self.n, self.width = n, np.diff(at) // 8
        self.own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in sorted(set(self.width.tolist()) - {0}):
            place, parts, count = np.full(len(n), -1, np.int64), [], 0
            for wide in sorted(x for x in set(self.width.tolist()) if x >= w):
                rows = np.flatnonzero(self.width == wide)
                bits = words[_spread(at[rows] // 8, np.full(len(rows), wide))].reshape(len(rows), wide // w, w)
                place[rows] = count + np.arange(len(rows))
                count += len(rows)
                parts.append(np.bitwise_or.reduce(bits, axis=1))
            self.own[w] = place, np.concatenate(parts)

    def most(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.inf)
        width = np.minimum(self.width[x], self.width[y])
        for w, (place, bits) in self.own.items():
            at = np.flatnonzero(width == w)
            for lo in range(0, len(at), 500_000):
                k = at[lo : lo + 500_000]
                differ = np.bitwise_count(bits[place[x[k]]] ^ bits[place[y[k]]]).sum(1, dtype=np.int64)
                out[k] = (self.n[x[k]] + self.n[y[k]] - differ) // 2
        return out


def _joined(gid: np.ndarray, n: np.ndarray, head: np.ndarray, grams: np.ndarray, sizes: np.ndarray, t: float, bound: _Bound) -> tuple[np.ndarray, ...]:
    """Row pairs of equal ``gid`` with their overlap in the fragment.

    A row is a segment: ``sizes`` n-grams of a set of ``n``, after ``head`` others
    in the order. Two segments are a pair if they share an n-gram in the
    prefixes that their sets need at the threshold, and if the overlap, with the
    shorter head and the shorter tail, could reach it; for that, they share one
    in the prefixes of the segments as well. The sizes of the sets and their
    sketches must allow it.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    pos = _spread(head, sizes)
    tail = n - head - sizes
    with np.errstate(over="ignore"):
        key = (gid[row].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (grams * np.uint64(0xD6E8FEB86659FD93))
    keys, code = np.unique(key, return_inverse=True)
    # inverted lists of the prefixes that the least partner asks for, sorted by the size of the set
    inside = np.flatnonzero(pos <= (n - np.ceil(t * n - _EPS))[row])
    inside = inside[np.lexsort((n[row[inside]], code[inside]))]
    c, r, p = code[inside], row[inside], pos[inside]
    size = n[r].astype(np.float64)
    cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True]) if len(c) else np.zeros(1, np.int64)
    end = np.repeat(cut[1:], np.diff(cut))
    total = len(n)
    at, lag = np.flatnonzero(np.arange(len(c)) + 1 < end), 1
    found, some, held = np.empty(0, np.int64), [], 0
    while len(at):
        # past the bound no later set is small enough
        at = at[size[at] >= t * size[at + lag] - _EPS]
        x, y, u, w = r[at], r[at + lag], p[at], p[at + lag]
        least = needed(size[at], size[at + lag], t)
        asked = np.maximum(least - np.minimum(head[x], head[y]) - np.minimum(tail[x], tail[y]), 1)
        ok = (gid[x] == gid[y]) & (x != y) & (u <= size[at] - least) & (w <= size[at + lag] - least)
        ok &= (u - head[x] <= sizes[x] - asked) & (w - head[y] <= sizes[y] - asked)
        x, y = x[ok].astype(np.int64), y[ok].astype(np.int64)
        ok = bound.most(x, y) >= least[ok]
        x, y = x[ok], y[ok]
        some.append(np.minimum(x, y) * total + np.maximum(x, y))
        held += len(x)
        if held > 4_000_000:
            found, some, held = np.unique(np.concatenate([found, *some])), [], 0
        lag += 1
        at = at[at + lag < end[at]]
    found = np.unique(np.concatenate([found, *some]))
    x, y = found // max(total, 1), found % max(total, 1)
    flip = sizes[x] > sizes[y]
    x, y = np.where(flip, y, x), np.where(flip, x, y)
    # the n-grams of the shorter segment are looked up in the longer
    code = code[np.lexsort((code, row))]
    occurs = row * np.int64(len(keys)) + code
    common = np.zeros(len(x), np.int64)
    step = max(1, 2_000_000 // int(max(sizes.max(initial=1), 1)))
    for lo in range(0, len(x), step):
        u, w = x[lo : lo + step], y[lo : lo + step]
        pair = np.repeat(np.arange(len(u)), sizes[u])
        target = w[pair] * np.int64(len(keys)) + code[_spread(starts[u], sizes[u])]
        hit = occurs[np.minimum(np.searchsorted(occurs, target), len(occurs) - 1)] == target
        common[lo : lo + step] = np.bincount(pair[hit], minlength=len(u))
    reach = np.minimum(head[x], head[y]) + common + np.minimum(tail[x], tail[y])
    ok = reach >= needed(n[x].astype(np.float64), n[y].astype(np.float64), t)
    return x[ok], y[ok], common[ok]


def with_fragments(table: DataFrame) -> DataFrame:
    """The gram table with ``frags``, the number of vertical fragments of each row's group, by its n-grams."""
    size = F.sum("n").alias("size")
    frags = F.greatest(F.lit(2), F.ceil(F.col("size") / FRAGMENT_GRAMS)).cast("int")
    many = written(table.groupBy("grp").agg(size).where(F.col("size") > SMALL_GROUP).select("grp", frags.alias("frags")), "group-fragments")
    rows = table.join(F.broadcast(many) if many.count() <= 50_000 else many, "grp", "left")
    return rows.withColumn("frags", F.coalesce("frags", F.lit(1)))


def _segments(b: pa.RecordBatch, rank: np.ndarray, load: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of the sets of a batch: row, fragment, head, edges into the n-grams, n-grams."""
    grams, sizes = _unpack(b.column("grams"))
    frags = b.column("frags").to_numpy(zero_copy_only=False).astype(np.int64)
    grams, r = _ordered(grams, sizes, rank)
    row = np.repeat(np.arange(len(sizes)), sizes)
    part = np.minimum((load[r] * frags[row]).astype(np.int64), frags[row] - 1)
    edge = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1]), True]) if len(row) else np.zeros(1, np.int64)
    own = row[edge[:-1]]
    return own, part[edge[:-1]], edge[:-1] - (np.cumsum(sizes) - sizes)[own], edge, grams


def partial_overlaps(table: DataFrame, rank: np.ndarray, load: np.ndarray, t: float) -> DataFrame:
    """``a, b, na, nb, frags, part, common, sa, sb``: what each fragment knows of the pairs it forms.

    The order is cut into ranges of equal load, as many as the group has
    fragments. A fragment holds the segments of a group in one range and joins
    them with each other: ``common`` n-grams of segments of ``sa`` and ``sb``.
    Segments after the prefix that the threshold asks for form no pair and stay
    away. ``table`` has ``frags``.
    """
    spark = table.sparkSession
    wide = spark.sparkContext.broadcast((rank, load))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, load = wide.value
        for b in batches:
            if not b.num_rows:
                continue
            own, part, head, edge, grams = _segments(b, rank, load)
            sizes = b.column("n").to_numpy().astype(np.int64)
            near = np.flatnonzero(head <= (sizes - np.ceil(t * sizes - _EPS))[own])
            raw = np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH])
            seg = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((edge * WIDTH).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
            sketch = _sketches(grams, sizes, b.column("frags").to_numpy() > 1)
            take = pa.array(own[near])
            yield pa.RecordBatch.from_arrays(
                [b.column("grp").take(take), pa.array(part[near].astype(np.int32)), *(b.column(c).take(take) for c in ("frags", "cls", "n")), pa.array(head[near].astype(np.int32)), sketch.take(take), seg.take(pa.array(near))],
                names=["grp", "part", "frags", "cls", "n", "head", "sketch", "grams"],
            )

    def match(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tb = pa.Table.from_batches(got).combine_chunks()
        gid = pc.binary_join_element_wise(tb.column("grp"), tb.column("part").cast(pa.string()), "\x00").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        code = tb.column("cls").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        # copies of a set are one row
        _, one = np.unique(gid * (code.max() + 1) + code, return_index=True)
        tb = tb.take(pa.array(one)).combine_chunks()
        gid = gid[one]
        grams, sizes = _unpack(tb.column("grams").combine_chunks())
        n, head, frags, part = (tb.column(c).to_numpy().astype(np.int64) for c in ("n", "head", "frags", "part"))
        x, y, common = _joined(gid, n, head, grams, sizes, t, _Bound(tb.column("sketch").combine_chunks(), n))
        cls = tb.column("cls").combine_chunks()
        for lo in range(0, len(x), 100_000):
            u, w = x[lo : lo + 100_000], y[lo : lo + 100_000]
            p, q = cls.take(pa.array(u)).to_pylist(), cls.take(pa.array(w)).to_pylist()
            flip = np.array([i > j for i, j in zip(p, q)], bool)
            u, w = np.where(flip, w, u), np.where(flip, u, w)
            ints = (n[u], n[w], frags[u], part[u], common[lo : lo + 100_000], sizes[u], sizes[w])
            yield pa.RecordBatch.from_arrays([pa.array([min(i, j) for i, j in zip(p, q)], pa.binary()), pa.array([max(i, j) for i, j in zip(p, q)], pa.binary()), *(pa.array(v.astype(np.int32)) for v in ints)], names=names)

    def grams_in(b: pa.RecordBatch) -> int:
        return pc.sum(pc.binary_length(b.column("grams"))).as_py() // WIDTH

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fragments come one after the other; some are joined at once, none is cut."""
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(b.column("grp").to_pylist(), b.column("part").to_pylist()))
            at = len(keys) - 1
            while at and keys[at - 1] == keys[-1]:
                at -= 1
            if at or keys[0] != last:
                # what is held, with the rows before the last key, is whole
                if at:
                    held.append(b.slice(0, at))
                    size += grams_in(held[-1])
                if size > BATCH_GRAMS:
                    yield from match(held)
                    held, size = [], 0
            rest = b.slice(at) if at else b
            held.append(rest)
            size += grams_in(rest)
            last = keys[-1]
        if held:
            yield from match(held)

    names = ["a", "b", "na", "nb", "frags", "part", "common", "sa", "sb"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(float(table.agg(F.sum("n")).first()[0] or 0) / 1e6))
    cuts = table.select("grp", "cls", "n", "grams", "frags").mapInArrow(cut, "grp string, part int, frags int, cls binary, n int, head int, sketch binary, grams binary")
    return cuts.repartition(tasks, "grp", "part").sortWithinPartitions("grp", "part").mapInArrow(join, "a binary, b binary, " + ", ".join(f"{c} int" for c in names[2:]))


def _class_filter(pairs: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bits of the classes that occur in ``pairs``; of fixed size."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << bits, bool)
        for b in batches:
            for c in (0, 1):
                v = b.column(c).to_pylist()
                on[np.frombuffer(b"".join(x[:8] for x in v), "<u8") & np.uint64((1 << bits) - 1)] = True
        yield chunks(np.packbits(on))

    return summed(pairs.mapInArrow(mark, "chunk int, part binary"), bits - 3, "u1", np.bitwise_or)


def overlaps(table: DataFrame, partial: DataFrame, rank: np.ndarray, load: np.ndarray, t: float) -> DataFrame:
    """``a, b, similarity`` of the pairs at ``t`` or more, from the sums of their partial overlaps.

    A similar pair is formed in the fragment of its first common n-gram at least.
    The sum over the fragments that formed a pair, with the shorter of the sets'
    other parts, bounds its overlap. Pairs that can still reach the threshold
    and that some fragment did not form are counted over their whole sets.
    """
    spark = table.sparkSession
    least = F.ceil(t / (1 + t) * (F.col("na") + F.col("nb")) - _EPS)
    share = (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("similarity")
    one = partial.where("frags = 1").select("a", "b", share)
    sums = partial.where("frags > 1").groupBy("a", "b", "na", "nb", "frags").agg(F.count("*").alias("formed"), *(F.sum(c).alias(c) for c in ("common", "sa", "sb")))
    can = F.col("common") + F.least(F.col("na") - F.col("sa"), F.col("nb") - F.col("sb")) >= least
    pairs = written(sums.where(can).select("a", "b", "na", "nb", "common", (F.col("formed") < F.col("frags")).alias("open")), "open-pairs")
    asked = pairs.where("open").select("a", "b", "na", "nb")
    wide = spark.sparkContext.broadcast(np.unpackbits(_class_filter(asked.select("a", "b"))).astype(bool))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = wide.value
        for b in batches:
            cls = b.column("cls")
            if len(cls):
                k = np.frombuffer(b"".join(x[:8] for x in cls.to_pylist()), "<u8") & np.uint64(len(on) - 1)
                yield b.take(pa.array(np.flatnonzero(on[k])))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                # the row above the 48 bits of the n-gram
                x, y = (g | (np.repeat(np.arange(b.num_rows), n).astype(np.uint64) << np.uint64(8 * WIDTH)) for g, n in (_unpack(b.column(c)) for c in ("ga", "gb")))
                both = np.intersect1d(x, y, assume_unique=True) >> np.uint64(8 * WIDTH)
                common = np.bincount(both.astype(np.int64), minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "b", "na", "nb")), pa.array(common)], names=["a", "b", "na", "nb", "common"])

    sets = table.where("frags > 1").select("cls", "grams").mapInArrow(partners, "cls binary, grams binary").dropDuplicates(["cls"])
    left, right = sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb"))
    more = asked.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ga", "gb").mapInArrow(counted, "a binary, b binary, na int, nb int, common bigint")
    total = pairs.where("not open").select("a", "b", "na", "nb", "common").unionByName(more)
    return one.unionByName(total.select("a", "b", share)).where(F.col("similarity") >= t - _EPS)


def class_links(df: DataFrame, key: str = "fragment_id", group: str = "namespace", text: str = "content", threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Links between classes (``a, b, similarity``) and membership (``cls, id``).

    A repeated record repeats its membership. Together they hold every pair of records of one group whose sets have a
    Jaccard similarity of ``threshold`` or more: two members of one class have
    1, two members of linked classes the link's. A repeated id is one record.
    Null, blank and one-term texts have an empty set and take no part, nor do
    records without group; an empty table gives empty results.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    table = written(gram_table(df, key, group, text), "grams")
    rank, load = global_order(table)
    cut = with_fragments(table)
    partial = written(partial_overlaps(cut, rank, load, threshold), "partial-overlaps")
    return overlaps(cut, partial, rank, load, threshold), table.select("cls", "id")


def similar_pairs(df: DataFrame, key: str = "fragment_id", group: str = "namespace", text: str = "content", threshold: float = 0.6) -> DataFrame:
    """Every pair ``id_a < id_b`` of similar records, copies expanded."""
    links, members = class_links(df, key, group, text, threshold)
    left, right = members.select(F.col("cls").alias("a"), F.col("id").alias("x")), members.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    between = links.join(left, "a").join(right, "b").select("x", "y", "similarity")
    copied = members.groupBy("cls").count().where("count > 1").select(F.col("cls").alias("a"))
    own = left.join(copied, "a", "left_semi")
    within = own.join(own.select(F.col("a"), F.col("x").alias("y")), "a").where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    both = between.unionByName(within).where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity").distinct()


def _components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``v, root`` of every vertex of ``edges(u, v)``: the least vertex it is linked to.

    Alternates star contractions around larger and smaller neighbours until no
    edge changes. Every round is a written table.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = written(small, "edges")
        sums = [t.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first() for t in (now, new)]
        now = new
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("v"), F.col("v").alias("root"))


def similar_groups(df: DataFrame, key: str = "fragment_id", group: str = "namespace", text: str = "content", threshold: float = 0.6) -> DataFrame:
    """One row per record with a set: ``id, group_id, n_links``.

    ``group_id`` is the least id that links and copies reach; ``n_links`` counts
    the other texts that the record's is linked to, copies not expanded.
    """
    links, members = class_links(df, key, group, text, threshold)
    links, members = written(links, "links"), members.distinct()
    roots = _components(df.sparkSession, links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    out = members.join(roots.withColumnRenamed("v", "cls"), "cls", "left").join(degree, "cls", "left")
    out = out.select("id", F.coalesce("root", "cls").alias("root"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return out.join(out.groupBy("root").agg(F.min("id").alias("group_id")), "root").select("id", "group_id", "n_links")
