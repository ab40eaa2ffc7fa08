"""Most similar vectors of every vector, through a permutation index.

The index has two levels. The vectors of a group are posted in the inverted
files of their nearest file pivots; the number of files, and the length of one,
grow with the square root of the group. In a file every vector is represented
by the order in which it sees the file's own pivots. The other members are
ranked by the footrule distance of these orders, and the best are reranked by
exact cosine. A group that one file holds is a group with one file pivot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import clean_name
from tidemark.storage import written

#: File pivots of large groups are broadcast up to this many bytes; beyond, they are shuffled to the rows.
BROADCAST_BYTES = 64 << 20
#: Distinct vectors a task holds before it posts them.
HELD = 16_384


@dataclass(frozen=True)
class IndexSettings:
    """A file of a group of n vectors has about ``spread`` times the root of n members.

    Each vector is posted in ``posts`` files; a group no larger than one file has
    one. A file's members are ordered against ``pivots`` of them, and places are
    compared in ``bands`` bands. Of a file of L members, ``candidates``, or four
    times the root of L where that is more, are reranked.
    """

    spread: float = 30.0
    posts: int = 4
    pivots: int = 128
    bands: int = 8
    candidates: int = 100

    def files(self, n: Column) -> Column:
        """Number of file pivots of a group of ``n`` vectors."""
        return F.when(n <= self.spread * F.sqrt(n), 1).otherwise(F.ceil(self.posts * F.sqrt(n) / self.spread)).cast("int")

    def reranked(self, n: int) -> int:
        return max(self.candidates, math.ceil(4 * math.sqrt(n)))

def vector_table(df: DataFrame, key: str, group: str, vector: str, width: int) -> DataFrame:
    """``id, grp, cls, vec`` of the usable rows; ``cls`` is a hash of group and values.

    Usable: id and group not null (group not blank), ``width`` values, all
    finite, not all zero. Repeated rows of one id stay; they are equal.
    """
    rows = df.select(F.col(key).cast("string").alias("id"), clean_name(F.col(group)).alias("grp"), F.col(vector).cast("array<float>").alias("vec"))
    rows = rows.where((F.size("vec") == width) & F.col("id").isNotNull() & F.col("grp").isNotNull())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, width) + np.float32(0)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            at = pa.array(np.flatnonzero(ok))
            raw = [v.tobytes() for v in x[ok]]
            groups = b.column("grp").take(at)
            cls = [xxhash.xxh3_128_digest(g.encode() + b"\0" + v) for g, v in zip(groups.to_pylist(), raw)]
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), groups, pa.array(cls, pa.binary()), pa.array(raw, pa.binary())], names=["id", "grp", "cls", "vec"])

    return rows.mapInArrow(parse, "id string, grp string, cls binary, vec binary")


def _answers(ids: list[list[str]], best: np.ndarray, cos: np.ndarray, k: int) -> Iterator[tuple[int, str | None, str, float]]:
    """Item-level neighbours: each row is a class with its least ``k + 1`` ids.

    Yields ``row, query id, neighbour id, cosine``. A class that may have more
    members than the ids known gets rows without query id for the rest.
    """
    for i, own in enumerate(ids):
        items = [(-1.0, y) for y in own]
        for j, c in zip(best[i].tolist(), cos[i].tolist()):
            if j < 0:
                break
            items += [(-c, y) for y in ids[j]]
        items.sort()
        items = items[: k + 1]
        for q in own:
            for c, y in [t for t in items if t[1] != q][:k]:
                yield i, q, y, -c
        if len(own) > k:
            for c, y in items[:k]:
                yield i, None, y, -c


def orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of every pivot in the order in which each row sees them; equal ones by number."""
    near = (x @ pivots.T).round(6)
    places = np.empty(near.shape, np.int16)
    np.put_along_axis(places, np.argsort(-near, axis=1, kind="stable"), np.arange(near.shape[1], dtype=np.int16)[None, :], 1)
    return places


def order_codes(x: np.ndarray, pivots: np.ndarray, bands: int) -> np.ndarray:
    """Orders as bits: the Hamming distance of two rows is their footrule distance.

    Places are cut into bands; band ``b`` of a pivot is written as ``b`` ones, so
    that two codes differ in as many bits as their bands lie apart. With a band
    for every place this is the footrule distance itself.
    """
    m = len(pivots)
    out = np.zeros((len(x), -(-m * bands // 64) * 8), np.uint8)
    for lo in range(0, len(x), 4096):
        band = orders(x[lo : lo + 4096], pivots).astype(np.int32) * bands // m
        ones = (band[:, :, None] > np.arange(bands)).reshape(len(band), -1)
        packed = np.packbits(ones, axis=1)
        out[lo : lo + 4096, : packed.shape[1]] = packed
    return out.view(np.uint64)


def footrule_top(codes: np.ndarray, c: int) -> Iterator[tuple[int, np.ndarray]]:
    """For blocks of rows, the ``c`` other rows of least footrule distance; equal ones by row."""
    n = len(codes)
    words = np.ascontiguousarray(codes.T)
    block = max(1, 131_072 // n)
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        far = np.zeros((hi - lo, n), np.int64)
        for w in words:
            far += np.bitwise_count(w[lo:hi, None] ^ w[None, :])
        far = far * n + np.arange(n)
        far[np.arange(hi - lo), np.arange(lo, hi)] = np.iinfo(np.int64).max
        yield lo, np.argpartition(far, c - 1, axis=1)[:, :c]


def _nearest(x: np.ndarray, hashes: np.ndarray, k: int, s: IndexSettings) -> tuple[np.ndarray, np.ndarray]:
    """Per row of a file, up to ``k`` other rows by rounded cosine, then by row; -1 fills up.

    The pivots are the rows of least hash. Where every other row is among the
    candidates whatever its distance, the distances are left out.
    """
    n = len(x)
    d = x.astype(np.float64)
    norm = np.sqrt((d * d).sum(1))
    k_here = min(k, n - 1)
    best, cos = np.full((n, k), -1, np.int64), np.full((n, k), -2.0)
    c = s.reranked(n)
    if n - 1 <= c:
        sim = np.round(d @ d.T / norm[:, None] / norm[None, :], 6)
        np.fill_diagonal(sim, -9)
        o = np.argsort(-sim, axis=1, kind="stable")[:, :k_here]
        best[:, :k_here], cos[:, :k_here] = o, np.take_along_axis(sim, o, 1)
        return best, cos
    unit = (d / norm[:, None]).astype(np.float32)
    codes = order_codes(unit, unit[np.argsort(hashes, kind="stable")[: s.pivots]], s.bands)
    step = max(1, 4_000_000 // (c * x.shape[1]))
    for first, each in footrule_top(codes, c):
        for lo in range(0, len(each), step):
            near = np.sort(each[lo : lo + step], axis=1)
            rows = np.arange(first + lo, first + lo + len(near))
            sim = np.matmul(d[near], d[rows][:, :, None])[:, :, 0]
            sim = np.round(sim / norm[rows][:, None] / norm[near], 6)
            o = np.argsort(-sim, axis=1, kind="stable")[:, :k_here]
            best[rows, :k_here], cos[rows, :k_here] = np.take_along_axis(near, o, 1), np.take_along_axis(sim, o, 1)
    return best, cos


def file_pivots(table: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, files, bucket, vec``: the file pivots of ``groups`` (``grp, files``).

    The distinct vectors of a group fall into as many buckets as it has files,
    by hash; the one of least hash in each is a pivot. Every task sends at most
    one vector for each bucket it meets.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], tuple[int, bytes, int]] = {}

        def flush() -> pa.RecordBatch:
            keys, values = list(kept), list(kept.values())
            kept.clear()
            a = [pa.array([g for g, _ in keys], pa.string()), pa.array([v[2] for v in values], pa.int32()), pa.array([b for _, b in keys], pa.int32())]
            return pa.RecordBatch.from_arrays([*a, pa.array([v[0] - 2**63 for v in values], pa.int64()), pa.array([v[1] for v in values], pa.binary())], names=["grp", "files", "bucket", "h", "vec"])

        for b in batches:
            cls = np.frombuffer(b"".join(c[:8] for c in b.column("cls").to_pylist()), "<u8")
            for g, m, h, i in zip(b.column("grp").to_pylist(), b.column("files").to_pylist(), cls.tolist(), range(b.num_rows)):
                e = kept.get((g, h % m))
                if e is None or h < e[0]:
                    kept[g, h % m] = h, b.column("vec")[i].as_py(), m
            if len(kept) > HELD:
                yield flush()
        yield flush()

    rows = table.join(groups, "grp").select("grp", "files", "cls", "vec").mapInArrow(least, "grp string, files int, bucket int, h bigint, vec binary")
    return rows.groupBy("grp", "files", "bucket").agg(F.min_by("vec", "h").alias("vec"))


def posted(table: DataFrame, k: int, width: int, s: IndexSettings) -> tuple[DataFrame, int]:
    """``grp, part, cls, ids, vec``: every distinct vector under its files, and a number of tasks for the files.

    ``part`` is -1 in a group of one file. ``ids`` are the least ``k + 1`` of the
    vector's ids that the task met.
    """
    spark = table.sparkSession
    sizes = table.groupBy("grp").agg(F.count("*").alias("n")).withColumn("files", s.files(F.col("n")))
    sizes = written(sizes, "groups")
    single = F.col("files") == 1
    total = sizes.agg(
        F.coalesce(F.sum(F.when(~single, F.col("files"))), F.lit(0)), F.coalesce(F.sum(F.when(single, F.col("n")).otherwise(s.posts * F.col("n"))), F.lit(0)),
        F.coalesce(F.sum(F.when(single, F.col("n") * F.col("n")).otherwise(s.posts * s.spread * F.col("n") * F.sqrt("n"))), F.lit(0.0)),
    ).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total[1] / 25_000), math.ceil(float(total[2]) / 2e8))
    large = sizes.where(~single).select("grp", "files")
    pivots = written(file_pivots(table, large), "file-pivots")
    held = None
    if total[0] * 4 * width <= BROADCAST_BYTES:
        by: dict[str, list[bytes]] = {}
        for r in pivots.orderBy("grp", "bucket").collect():
            by.setdefault(r.grp, []).append(bytes(r.vec))
        held = spark.sparkContext.broadcast({g: _unit(v, width) for g, v in by.items()})
        rows = table.select("grp", F.lit(0).alias("salt"), F.lit(1).alias("kind"), F.lit(0).alias("bucket"), "id", "cls", "vec")
    else:
        # the rows of a large group are spread over shares, and its pivots sent to each share ahead of them
        shares = sizes.select("grp", F.ceil(F.col("n") / 50_000).cast("int").alias("shares"), "files")
        rows = table.join(shares, "grp").select("grp", F.pmod(F.xxhash64("cls"), "shares").cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(0).alias("bucket"), "id", "cls", "vec")
        ahead = pivots.join(shares.drop("files"), "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(0).alias("kind"), "bucket", F.lit(None).cast("string").alias("id"), F.lit(None).cast("binary").alias("cls"), "vec")
        rows = rows.unionByName(ahead).repartition(tasks, "grp", "salt").sortWithinPartitions("grp", "salt", "kind", "bucket")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, list] = {}
        own, ahead = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            by: dict[str, list[bytes]] = {}
            for c, e in kept.items():
                by.setdefault(e[1], []).append(c)
            cls, part = [], []
            for g, each in by.items():
                pivots = held.value.get(g) if held is not None else own[1] if own is not None and own[0] == g else None
                if pivots is None:
                    cls += each
                    part += [-1] * len(each)
                    continue
                m = min(s.posts, len(pivots))
                near = (_unit([kept[c][2] for c in each], width) @ pivots.T).round(6)
                part += np.argsort(-near, axis=1, kind="stable")[:, :m].ravel().tolist()
                cls += [c for c in each for _ in range(m)]
            for lo in range(0, len(cls), 8192):
                e = [kept[c] for c in cls[lo : lo + 8192]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[1] for x in e], pa.string()), pa.array(part[lo : lo + 8192], pa.int32()), pa.array(cls[lo : lo + 8192], pa.binary()), pa.array([x[0] for x in e], pa.list_(pa.string())), pa.array([x[2] for x in e], pa.binary())],
                    names=["grp", "part", "cls", "ids", "vec"],
                )
            kept.clear()

        for b in batches:
            for g, kind, i, c, v in zip(*(b.column(n).to_pylist() for n in ("grp", "kind", "id", "cls", "vec"))):
                if held is None:
                    # pivots come ahead of their group's rows
                    if kind == 0:
                        if ahead and ahead[0][0] != g:
                            ahead = []
                        if kept:
                            yield from flush()
                        ahead.append((g, v))
                        continue
                    if ahead:
                        own, ahead = (ahead[0][0], _unit([x for _, x in ahead], width)), []
                e = kept.get(c)
                if e is None:
                    kept[c] = [[i], g, v]
                    if len(kept) >= HELD:
                        yield from flush()
                elif i not in e[0]:
                    e[0] = sorted([*e[0], i])[: k + 1]
        yield from flush()

    return rows.mapInArrow(post, "grp string, part int, cls binary, ids array<string>, vec binary"), tasks


def _unit(vectors: list[bytes], width: int) -> np.ndarray:
    d = np.frombuffer(b"".join(vectors), "<f4").reshape(-1, width).astype(np.float64)
    return (d / np.sqrt((d * d).sum(1, keepdims=True))).astype(np.float32)


def nearest_vectors(df: DataFrame, k: int = 5, key: str = "fragment_id", group: str = "namespace", vector: str = "embedding", width: int = 128, settings: IndexSettings | None = None, with_rank: bool = True) -> DataFrame:
    """``id, neighbour, cosine, rank``: up to ``k`` most similar other vectors of the group.

    Cosine is computed in double and rounded to 6 decimals; equal ones are
    ordered by id. Unusable vectors (see ``vector_table``) neither ask nor
    answer. Equal vectors of one group are indexed once. A group of one vector
    gives no rows; an empty table an empty result. Without ``with_rank``, ranks
    that would need a shuffle of their own are null.
    """
    s = settings or IndexSettings()
    table = written(vector_table(df, key, group, vector, width), "vectors")
    files, tasks = posted(table, k, width, s)

    def answers(g: str, part: int, own: dict[bytes, list]) -> list[tuple]:
        if len(own) == 1 and len(next(iter(own.values()))[0]) == 1:
            return []
        each = sorted(own.items(), key=lambda t: t[1][0][0])
        x = np.frombuffer(b"".join(t[1][1] for t in each), "<f4").reshape(-1, width)
        best, cos = _nearest(x, np.frombuffer(b"".join(c[:8] for c, _ in each), "<u8"), k, s)
        return [(each[i][0], q, y, c, part >= 0) for i, q, y, c in _answers([t[1][0] for t in each], best, cos, k)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The files of a task, one after the other; only one is held."""
        now, own, out = None, {}, []
        for b in batches:
            for g, part, c, ids, v in zip(*(b.column(n).to_pylist() for n in ("grp", "part", "cls", "ids", "vec"))):
                if now != (g, part):
                    if own:
                        out += answers(*now, own)
                    now, own = (g, part), {}
                    if len(out) > 50_000:
                        yield batch(out)
                        out = []
                if c in own:
                    own[c][0] = sorted({*own[c][0], *ids})[: k + 1]
                else:
                    own[c] = [ids, v]
        if own:
            out += answers(*now, own)
        for lo in range(0, max(len(out), 1), 50_000):
            yield batch(out[lo : lo + 50_000])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        a = list(zip(*out)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(a[0], pa.binary()), pa.array(a[1], pa.string()), pa.array(a[2], pa.string()), pa.array(a[3], pa.float64()), pa.array(a[4], pa.bool_())], names=["cls", "id", "neighbour", "cosine", "large"])

    listed = files.repartition(tasks, "grp", "part").sortWithinPartitions("grp", "part")
    found = written(listed.mapInArrow(search, "cls binary, id string, neighbour string, cosine double, large boolean"), "neighbours")
    # a query of a group of one file has its answer; the others are merged over their files
    single = found.where("id is not null and not large").select("id", "neighbour", "cosine")
    several = found.where("id is not null and large").select("id", "neighbour", "cosine")
    # members of a class beyond the ids its file knew
    rest = found.where("id is null").select("cls", "neighbour", "cosine").distinct()
    known = found.where("id is not null").select("id").distinct()
    more = table.join(rest.select("cls").distinct(), "cls", "left_semi").select("id", "cls").distinct().join(known, "id", "left_anti")
    several = several.unionByName(more.join(rest, "cls").select("id", "neighbour", "cosine"))
    order = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour")
    merged = several.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(["id", "neighbour"])
    ranked = single.withColumn("rank", F.lit(None).cast("int"))
    if with_rank:
        ranked = single.withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(merged)


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs ``id_a < id_b`` in which one is a neighbour of the other."""
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
