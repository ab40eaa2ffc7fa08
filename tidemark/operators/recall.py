"""Retrieval: ranking, fusion, redundancy, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar, text
from tidemark.storage import written

#: Weights of semantic score, keyword score and importance by tag profile.
PROFILES = {
    "temporal-reasoning": (0.92, 0.03, 0.05),
    "multi-session": (0.80, 0.10, 0.10),
    "knowledge-update": (0.75, 0.05, 0.20),
    "abstention": (0.85, 0.05, 0.10),
}
DEFAULT_PROFILE = (0.70, 0.25, 0.05)


def tag_profile(tags: Column) -> Column:
    """Name of the first profile some tag is equal to or ends with; ``default`` otherwise."""

    def has(name: str) -> Column:
        return F.exists(tags, lambda t: (t == name) | t.endswith("-" + name))

    out = F.when(has("temporal-reasoning"), "temporal-reasoning").when(has("multi-session"), "multi-session")
    out = out.when(has("knowledge-update") | has("knowledge-updates"), "knowledge-update").when(has("abstention"), "abstention")
    return out.otherwise("default")


def weight(profile: Column, place: int) -> Column:
    out = F.lit(DEFAULT_PROFILE[place])
    for name, w in PROFILES.items():
        out = F.when(profile == name, w[place]).otherwise(out)
    return out


def fused(df: DataFrame, query: str, profile: Column) -> DataFrame:
    """Adds ``fused``: weighted sum of the scores, each normalised by its maximum over the query's pool."""
    top = df.groupBy(query).agg(F.max("semantic").alias("_s"), F.max(F.coalesce("keyword", F.lit(0.0))).alias("_k"))
    out = df.join(top, query).withColumn("_p", profile)
    value = (
        weight(F.col("_p"), 0) * scalar.normalized(F.col("semantic"), F.col("_s"))
        + weight(F.col("_p"), 1) * scalar.normalized(F.coalesce("keyword", F.lit(0.0)), F.col("_k"))
        + weight(F.col("_p"), 2) * scalar.clamp(F.col("importance"), 0.0, 1.0)
    )
    return out.withColumn("fused", value).drop("_s", "_k", "_p")


def ranked(df: DataFrame, query: str, score: Column, tie: str, out: str = "rank") -> DataFrame:
    w = Window.partitionBy(query).orderBy(score.desc(), tie)
    return df.withColumn(out, F.row_number().over(w).cast("bigint"))


def within_budget(df: DataFrame, query: str, rank: str, item: str, tokens: str, k: int = 5, budget: int = 2048) -> DataFrame:
    """Rows taken in rank order until ``k`` are taken; one that would exceed the budget is skipped.

    Each query's pool is folded by itself; pools are bounded by the search
    limits. Returns ``query, item, place, used``.
    """
    rows = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).alias("i"), F.col(tokens).cast("bigint").alias("t"))))
    pools = df.groupBy(query).agg(rows.alias("rows"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<i:string,used:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        ok = (F.size(s["out"]) < k) & (s["used"] + x["t"] <= budget) & ~F.exists(s["out"], lambda o: o["i"] == x["i"].cast("string"))
        used = s["used"] + x["t"]
        new = F.struct(used.alias("used"), F.concat(s["out"], F.array(F.struct(x["i"].cast("string").alias("i"), used.alias("used")))).alias("out"))
        return F.when(ok, new).otherwise(s)

    taken = pools.select(query, F.aggregate("rows", zero, step)["out"].alias("out"))
    return taken.select(query, F.posexplode("out").alias("place", "o")).select(query, F.col("o.i").alias(item), (F.col("place") + 1).cast("bigint").alias("place"), F.col("o.used").alias("used"))


def pool_redundancy(pool: DataFrame, query: str, item: str, vector: str) -> DataFrame:
    """Adds ``penalty`` and ``novelty`` of every candidate among the pool of its query, for ``vector``.

    The penalty is the greatest, the novelty the least over the other candidates;
    both are 0 without any. A null vector has cosine 0 to all. Similarities are
    rounded to 9 decimals. A pool is bounded by the search limits and is compared
    as one matrix, whose rows never leave their task.
    """

    def scored(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = b.column(query).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        v, known = b.column(vector), b.column(vector).is_valid().to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = np.zeros((b.num_rows, len(flat) // max(int(known.sum()), 1)))
        if known.any():
            x[known] = flat.reshape(int(known.sum()), -1)
        norm = np.sqrt((x * x).sum(1))
        x = np.where(norm[:, None] > 0, x / np.where(norm > 0, norm, 1)[:, None], 0)
        high = np.full(b.num_rows, np.nan)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if hi - lo > 1:
                sim = x[lo:hi] @ x[lo:hi].T
                np.fill_diagonal(sim, -np.inf)
                high[lo:hi] = sim.max(1)
        high = np.round(high, 9)
        alone = np.isnan(high)
        # both rules fall with the similarity, so the nearest other decides
        penalty = np.where(alone | (high < scalar.REDUNDANT_AT), 0.0, np.minimum(scalar.MAX_PENALTY, high - scalar.REDUNDANT_AT))
        novelty = np.where(alone, 0.0, np.minimum(scalar.MAX_NOVELTY, np.maximum(0.0, 1 - high) * scalar.MAX_NOVELTY))
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(penalty), pa.array(novelty)], names=[*keep, "penalty", "novelty"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(query).to_numpy(zero_copy_only=False)
            at = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
            if held and (at or keys[0] != held[-1].column(query)[0].as_py()):
                whole = pa.Table.from_batches([*held, b.slice(0, at)]).combine_chunks().to_batches()
                yield from map(scored, whole)
                held = []
            elif at:
                yield scored(b.slice(0, at))
            held.append(b.slice(at))
        if held:
            yield from map(scored, pa.Table.from_batches(held).combine_chunks().to_batches())

    keep = [c for c in pool.columns if c != vector]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.drop(vector).schema)
    return pool.repartition(query).sortWithinPartitions(query, item).mapInArrow(run, kinds + ", penalty double, novelty double")


def _postings(q: pa.Table, d: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Some queries at a time: the first one, and by query and document the number and the summed weight of common terms.

    Terms that many of the documents have go through a matrix, the others through
    their lists. A query without ``dfs`` has all documents of its pool here.
    """
    lists = [t.column("tokens").combine_chunks() for t in (q, d)]
    q_size, d_size = (pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
    terms = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    code = terms.indices.to_numpy()
    qc, dc, docs = code[: q_size.sum()], code[q_size.sum() :], len(d_size)
    here = np.bincount(dc, minlength=len(terms.dictionary))
    n = q.column("n")[0].as_py()
    df = here[qc] if n is None else q.column("dfs").combine_chunks().flatten().to_numpy()
    weight = np.log(1 + (docs if n is None else n) / np.maximum(df, 1))
    own = np.repeat(np.arange(docs), d_size)
    listed, start = own[np.argsort(dc, kind="stable")], np.cumsum(here) - here
    often = np.flatnonzero((here * 32 > docs) & (np.bincount(qc, minlength=len(here)) > 0) & (here > 64))
    place = np.full(len(here), -1)
    place[often] = np.arange(len(often))
    wide, at = np.zeros((len(often), docs)), place[dc] >= 0
    np.add.at(wide, (place[dc[at]], own[at]), 1)
    row, edge = np.repeat(np.arange(len(q_size)), q_size), np.r_[0, np.cumsum(q_size)]
    step = max(1, 262_144 // docs)
    for lo in range(0, len(q_size), step):
        hi = min(lo + step, len(q_size))
        r, c, w = (x[edge[lo] : edge[hi]] for x in (row, qc, weight))
        r, cells = r - lo, (hi - lo) * docs
        few = np.flatnonzero(place[c] < 0)
        k = here[c[few]]
        ends = np.cumsum(k)
        cell = np.repeat(r[few] * docs, k) + listed[np.arange(k.sum()) - np.repeat(ends - k - start[c[few]], k)]
        matched, score = np.bincount(cell, minlength=cells), np.bincount(cell, np.repeat(w[few], k), cells)
        if len(often):
            m = np.flatnonzero(place[c] >= 0)
            a, b = np.zeros((hi - lo, len(often))), np.zeros((hi - lo, len(often)))
            np.add.at(a, (r[m], place[c[m]]), 1)
            np.add.at(b, (r[m], place[c[m]]), w[m])
            matched, score = matched + (a @ wide).ravel().round().astype(np.int64), score + (b @ wide).ravel()
        yield lo, matched.reshape(hi - lo, docs), score.reshape(hi - lo, docs)


def _keyword_blocks(docs: DataFrame, queries: DataFrame, pool: str, block: int, work, schema: str) -> DataFrame:
    """Run ``work`` on every block of a pool's queries with every block of its documents, so that no common term is a row.

    A pool within ``block`` is one block and counts its terms in its task. The
    queries of larger pools carry the counts of their terms (``dfs``) and the
    size of the pool (``n``).
    """
    d = docs.select("id", F.col(pool).alias("_g"), "tokens").where("_g is not null")
    q = queries.select("query_id", F.col(pool).alias("_g"), "tokens").where("_g is not null and query_id is not null")
    size = lambda t, c: t.groupBy("_g").agg(F.count("*").alias(c)).where(F.col(c) > block)
    many = written(size(d, "_n").join(size(q, "_a"), "_g", "full_outer"), "keyword-pools")
    held = many.count() <= 50_000
    small = lambda t: F.broadcast(t) if held else t
    large = small(many.where("_n is not null").select("_g"))
    df = d.join(large, "_g").select("_g", F.explode("tokens").alias("term")).groupBy("_g", "term").agg(F.count("*").alias("df"))
    asked = q.join(large, "_g").select("query_id", "_g", F.posexplode("tokens").alias("p", "term")).join(df, ["_g", "term"], "left")
    asked = asked.groupBy("query_id", "_g").agg(F.array_sort(F.collect_list(F.struct("p", "term", F.coalesce("df", F.lit(0)).alias("df")))).alias("x"))
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    asks = q.join(large, "_g", "left_anti").select("query_id", "_g", "tokens", none("array<bigint>", "dfs")).unionByName(asked.select("query_id", "_g", F.col("x.term").alias("tokens"), F.col("x.df").alias("dfs")))
    blocks = lambda c: F.coalesce(F.ceil(F.col(c) / block), F.lit(1)).cast("int")
    place = lambda key, c: F.pmod(F.xxhash64(key), blocks(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    a = d.join(small(many), "_g", "left").withColumn("_lo", place("id", "_n")).withColumn("_hi", each("_a"))
    b = asks.join(small(many), "_g", "left").withColumn("_hi", place("query_id", "_a")).withColumn("_lo", each("_n"))
    kind = q.schema["query_id"].dataType.simpleString()
    a = a.select("_g", "_lo", "_hi", "id", none(kind, "query_id"), "tokens", none("array<bigint>", "dfs"), none("bigint", "n"))
    b = b.select("_g", "_lo", "_hi", none(d.schema["id"].dataType.simpleString(), "id"), "query_id", "tokens", "dfs", F.col("_n").alias("n"))

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, asks = sum(p.num_rows for p in parts), sum(p.num_rows - p.column("query_id").null_count for p in parts)
        if 0 < asks < rows:
            t = pa.Table.from_batches(parts)
            ask = t.column("query_id").is_valid()
            yield from work(t.filter(ask).combine_chunks(), t.filter(pc.invert(ask)).combine_chunks())

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of blocks come one after the other; a task holds one."""
        held, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            name = b.column("_g").dictionary_encode()
            g, lo, hi = name.indices.to_numpy(), b.column("_lo").to_numpy(), b.column("_hi").to_numpy()
            edges = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), True]).tolist()
            for at, end in zip(edges[:-1], edges[1:]):
                key = (name[at].as_py(), lo[at], hi[at])
                if key != last:
                    yield from done(held)
                    held, last = [], key
                held.append(b.slice(at, end - at))
        yield from done(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for b in groups(batches):
            some.append(b)
            size += b.num_rows
            if size > 50_000:
                yield from pa.Table.from_batches(some).combine_chunks().to_batches()
                some, size = [], 0
        if some:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()

    return a.unionByName(b).repartition("_g", "_lo", "_hi").sortWithinPartitions("_g", "_lo", "_hi").mapInArrow(run, schema)


def keyword_scores(docs: DataFrame, queries: DataFrame, pool: str = "namespace", block: int = 4096) -> DataFrame:
    """``query_id, id, score, matched`` of the documents that share a keyword with a query of their pool.

    ``docs`` has ``id, pool, tokens`` and ``queries`` ``query_id, pool, tokens``;
    ids occur once in a pool, tokens once in a row. Both are read several times.
    A term's weight is the logarithm of 1 + pool size / documents with it.
    """

    def work(q: pa.Table, d: pa.Table) -> Iterator[pa.RecordBatch]:
        asked, ids = q.column("query_id").combine_chunks(), d.column("id").combine_chunks()
        terms = pc.list_value_length(q.column("tokens")).to_numpy()
        for lo, matched, score in _postings(q, d):
            i, k = np.nonzero(matched)
            m = matched[i, k]
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(lo + i)), ids.take(pa.array(k)), pa.array(score[i, k] + m / terms[lo + i]), pa.array(m)], names=["query_id", "id", "score", "matched"])

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}"
    return _keyword_blocks(docs, queries, pool, block, work, f"{kinds}, score double, matched bigint")


def keyword_hits(docs: DataFrame, queries: DataFrame, pool: str = "namespace", block: int = 4096) -> DataFrame:
    """``query_id, hits``: the number of rows that ``keyword_scores`` has for each query with any."""

    def work(q: pa.Table, d: pa.Table) -> Iterator[pa.RecordBatch]:
        hits = np.concatenate([(matched > 0).sum(1) for _, matched, _ in _postings(q, d)])
        at = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([q.column("query_id").combine_chunks().take(pa.array(at)), pa.array(hits[at])], names=["query_id", "hits"])

    parts = _keyword_blocks(docs, queries, pool, block, work, f"query_id {queries.schema['query_id'].dataType.simpleString()}, hits bigint")
    return parts.groupBy("query_id").agg(F.sum("hits").alias("hits"))


def document_tokens(content: Column, tags: Column) -> Column:
    return F.array_distinct(F.concat(text.keywords(content), F.flatten(F.transform(tags, text.keywords))))


def _in_blocks(df: DataFrame, group: str, block: int, work, schema: str, *extra: str) -> DataFrame:
    """Run ``work`` on the rows of every two hash blocks of each group.

    Groups are cut into blocks by id hash; every two blocks of a group meet in
    one task as matrices, so no pair is ever a row.
    """
    n = df.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_b"))
    rows = df.select("id", group, "embedding", *extra).join(n, group)
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_b")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    rows = rows.select("id", "embedding", *extra, F.col(group).alias("_g"), F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"))

    def done(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, g in pd.concat(parts).groupby(["_g", "_lo", "_hi"], sort=False):
            x = np.stack(g["embedding"].to_numpy()).astype(np.float64)
            norm = np.sqrt((x * x).sum(1))
            yield work(g, x / np.where(norm > 0, norm, 1)[:, None])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of blocks come one after the other; a task holds one, and the batch it ends in."""
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            g, lo, hi = (b[c].to_numpy() for c in ("_g", "_lo", "_hi"))
            at = int(np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])[-1])
            if at:
                yield from done([*held, b.iloc[:at]])
                held = []
            elif held and (g[0], lo[0], hi[0]) != tuple(held[-1][["_g", "_lo", "_hi"]].iloc[0]):
                yield from done(held)
                held = []
            held.append(b.iloc[at:])
        if held:
            yield from done(held)

    return rows.repartition("_g", "_lo", "_hi").sortWithinPartitions("_g", "_lo", "_hi").mapInPandas(run, schema)


def nearest_peer(df: DataFrame, group: str = "namespace", block: int = 4096, fresh: str | None = None) -> DataFrame:
    """``id, sim, least_sim``: highest and lowest cosine to another vector of the group.

    Ids alone in their group get null. With the boolean column ``fresh``, only
    pairs with a fresh row count; ids without such a pair get null.
    """

    def work(g: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        high, low = np.full(len(x), -np.inf), np.full(len(x), np.inf)
        new = g[fresh].to_numpy(bool) if fresh else np.ones(len(x), bool)
        for lo in range(0, len(x), 1024):
            own = np.arange(lo, min(lo + 1024, len(x)))
            s = x[own] @ x.T
            off = ~(new[own][:, None] | new[None, :])
            off[own - lo, own] = True
            high[own] = np.where(off, -np.inf, s).max(1)
            low[own] = np.where(off, np.inf, s).min(1)
        clean = lambda v: np.where(np.isfinite(v), v, np.nan)
        return pd.DataFrame({"id": g["id"].to_numpy(), "sim": clean(high), "least_sim": clean(low)})

    each = _in_blocks(df, group, block, work, "id string, sim double, least_sim double", *([fresh] if fresh else []))
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return each.groupBy("id").agg(F.max(known("sim")).alias("sim"), F.min(known("least_sim")).alias("least_sim"))


def add_peers(peers: DataFrame, df: DataFrame, fresh: str, group: str = "namespace") -> DataFrame:
    """``peers`` of the old rows, brought up to date with the fresh rows of ``df``."""
    new = nearest_peer(df, group, fresh=fresh).select("id", F.col("sim").alias("_s"), F.col("least_sim").alias("_l"))
    out = peers.join(new, "id", "full_outer")
    return out.select("id", F.greatest("sim", "_s").alias("sim"), F.least("least_sim", "_l").alias("least_sim"))


def peer_groups(df: DataFrame, k: int, group: str = "namespace", block: int = 4096) -> DataFrame:
    """``id, peer, sim, place``: the ``k`` most similar others of the group, by rounded cosine, then id."""

    def work(g: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        ids = g["id"].to_numpy(dtype=object)
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        most = min(k, len(x) - 1)
        out = []
        for lo in range(0, len(x) if most else 0, 1024):
            own = np.arange(lo, min(lo + 1024, len(x)))
            s = np.round(x[own] @ x.T, 6)
            s[own - lo, own] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :most]
            out.append((np.repeat(ids[own], most), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pd.DataFrame({"id": pd.Series(cols[0], dtype="object"), "peer": pd.Series(cols[1], dtype="object"), "sim": np.asarray(cols[2], np.float64)})

    each = _in_blocks(df, group, block, work, "id string, peer string, sim double").distinct()
    w = Window.partitionBy("id").orderBy(F.col("sim").desc(), "peer")
    return each.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)


def vector_search(df: DataFrame, queries: DataFrame, k: int, group: str = "namespace", block: int = 4096) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` most similar rows of each query's group, by rounded cosine, then id.

    Every block of a group's rows meets every block of its queries in a task.
    """
    rows, asks = df.select("id", group, "embedding"), queries.select("id", group, "embedding")
    size = lambda t, c: t.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias(c))
    n = size(rows, "_r").join(size(asks, "_q"), group)
    place = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = rows.join(n, group).withColumn("_lo", place("_r")).withColumn("_hi", each("_q")).withColumn("_ask", F.lit(False))
    b = asks.join(n, group).withColumn("_hi", place("_q")).withColumn("_lo", each("_r")).withColumn("_ask", F.lit(True))
    both = a.select(F.col(group).alias("_g"), "_lo", "_hi", "_ask", "id", "embedding").unionByName(b.select(F.col(group).alias("_g"), "_lo", "_hi", "_ask", "id", "embedding"))

    def work(g: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(g["embedding"].to_numpy()).astype(np.float64)
        norm = np.sqrt((x * x).sum(1))
        x, ids, ask = x / np.where(norm > 0, norm, 1)[:, None], g["id"].to_numpy(dtype=object), g["_ask"].to_numpy(dtype=bool)
        own = np.flatnonzero(~ask)
        own = own[np.argsort(ids[own])]
        out = []
        for lo in range(0, int(ask.sum()), 512):
            q = np.flatnonzero(ask)[lo : lo + 512]
            s = np.round(x[q] @ x[own].T, 6)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(ids[q], top.shape[1]), "id": ids[own][top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    found = both.groupBy("_g", "_lo", "_hi").applyInPandas(work, "query_id string, id string, score double")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def first_source(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Union in which the first source of a key wins; ``source`` numbers it, ``offered`` counts all."""
    both = None
    for i, s in enumerate(sources):
        s = s.select(*key).withColumn("source", F.lit(i))
        both = s if both is None else both.unionByName(s)
    return both.groupBy(*key).agg(F.min("source").alias("source"), F.count("*").alias("offered"))


def rerank_effect(changed: Column, distinct: Column) -> Column:
    return F.when(changed > 0, "ORDER_CHANGED").when(distinct > 1, "IDENTIFIABLE").otherwise("NON_IDENTIFIABLE")


def empty_reason(mode: Column, n_l1: Column, n_vector: Column, n_keyword: Column, n_filtered: Column, n_over: Column) -> Column:
    """Why a recall returned nothing; null if there are results."""
    return (
        F.when(n_l1 + n_vector + n_keyword + n_filtered + n_over == 0, "NO_CANDIDATES").when((mode == "KEYWORD_ONLY") & (n_keyword == 0), "NO_KEYWORD_MATCH")
        .when((mode != "KEYWORD_ONLY") & (n_vector == 0), "NO_VECTOR_MATCH").when(n_filtered > 0, "TAG_FILTER").when(n_over > 0, "TOKEN_BUDGET")
    )
