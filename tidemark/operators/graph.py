"""Task graphs: degrees, reachability, levels, branches, pages."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators.folding import Rows, folded
from tidemark.storage import written

GRAPH = "task_id"


def ends(nodes: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    """Nodes without incoming (``dst``) or outgoing (``src``) edge."""
    return nodes.select(GRAPH, "node").join(edges.select(GRAPH, F.col(side).alias("node")), [GRAPH, "node"], "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``n_in, n_out`` of every node, from one pass over the edges."""
    e = edges.select(GRAPH, F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select(GRAPH, "x.*")
    n = nodes.select(GRAPH, "node", F.lit(0).alias("o"), F.lit(0).alias("i"))
    return n.unionByName(e).groupBy(GRAPH, "node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def closure(edges: DataFrame, most: int = 30) -> DataFrame:
    """All pairs connected by a path, by doubling path lengths.

    Each round joins the paths found so far with themselves and is a written
    table, so the number of rounds is logarithmic in the longest path.
    """
    paths, n = written(edges.select(GRAPH, "src", "dst").distinct(), "paths"), -1
    for _ in range(most):
        now = paths.count()
        if now == n:
            return paths
        n = now
        tail = paths.select(GRAPH, F.col("src").alias("mid"), F.col("dst").alias("end"))
        head = paths.select(GRAPH, "src", F.col("dst").alias("mid"))
        longer = head.join(tail, [GRAPH, "mid"]).select(GRAPH, "src", F.col("end").alias("dst"))
        paths = written(paths.unionByName(longer).distinct(), "paths")
    raise RuntimeError("paths did not settle")


def cyclic(edges: DataFrame) -> DataFrame:
    """Graphs with a cycle: those that can't be peeled from their sources."""
    nodes = edges.select(GRAPH, F.col("src").alias("node")).union(edges.select(GRAPH, "dst")).distinct()
    return nodes.select(GRAPH).distinct().join(levels(nodes, edges).select(GRAPH).distinct(), GRAPH, "left_anti")


def reached(edges: DataFrame, starts: DataFrame, backwards: bool = False) -> DataFrame:
    """``task_id, start, node``: all nodes on paths from each start, or to it; a start itself only on a cycle.

    ``starts`` has ``task_id, node``. Only the asked nodes are followed. One task
    graph is bounded, and its edges are held while its starts stream by.
    """
    a, b = ("dst", "src") if backwards else ("src", "dst")
    rows = edges.select(GRAPH, F.lit(0).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(starts.select(GRAPH, F.lit(1).alias("kind"), F.col("node").alias("src"), F.lit(None).cast("bigint").alias("dst")).distinct())

    def step(task: int, s: dict, g: Rows) -> list[tuple]:
        out = []
        for kind, src, dst in zip(g["kind"], g["src"], g["dst"]):
            if kind == 0:
                s.setdefault(src, []).append(dst)
                continue
            seen, front = set(), [src]
            while front:
                fresh = [x for x in s.get(front.pop(), ()) if x not in seen]
                seen.update(fresh)
                front += fresh
            out += [(task, src, n) for n in seen]
        return out

    return folded(rows, GRAPH, ["kind"], f"{GRAPH} bigint, start bigint, node bigint", dict, step)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``level`` of every node: longest path from a source; graphs with a cycle drop out.

    One task graph is bounded, so each is peeled in memory by its own group.
    """

    def peel(g: pd.DataFrame) -> pd.DataFrame:
        task = g["task_id"].iloc[0]
        node = g.loc[g["dst"].isna(), "src"].astype(int).tolist()
        level = dict.fromkeys(node, 0)
        waiting = dict.fromkeys(node, 0)
        after: dict[int, list[int]] = {}
        for s, t in g.loc[g["dst"].notna(), ["src", "dst"]].astype(int).itertuples(index=False):
            after.setdefault(s, []).append(t)
            waiting[t] = waiting.get(t, 0) + 1
        ready, done = [n for n in node if not waiting[n]], 0
        while ready:
            n = ready.pop()
            done += 1
            for t in after.get(n, []):
                level[t] = max(level[t], level[n] + 1)
                waiting[t] -= 1
                if not waiting[t]:
                    ready.append(t)
        if done < len(node):
            return pd.DataFrame({"task_id": [], "node": [], "level": []})
        return pd.DataFrame({"task_id": task, "node": node, "level": [level[n] for n in node]})

    rows = nodes.select(GRAPH, F.col("node").alias("src"), F.lit(None).cast("bigint").alias("dst")).unionByName(edges.select(GRAPH, "src", "dst"))
    return rows.groupBy(GRAPH).applyInPandas(peel, "task_id bigint, node bigint, level bigint")


def within_hops(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``start, node, hop``: nodes first reached after at most ``hops`` edges, without the start."""
    front = starts.select(GRAPH, F.col("node").alias("start"), "node").withColumn("hop", F.lit(0))
    out = None
    for h in range(1, hops + 1):
        e = edges.select(F.col(GRAPH).alias("_g"), F.col("src").alias("_s"), "dst")
        front = front.join(e, (F.col(GRAPH) == F.col("_g")) & (F.col("node") == F.col("_s"))).select(GRAPH, "start", F.col("dst").alias("node"), F.lit(h).alias("hop")).distinct()
        out = front if out is None else out.unionByName(front)
    return out.where("node <> start").groupBy(GRAPH, "start", "node").agg(F.min("hop").alias("hop"))


def lookahead_pages(starts: DataFrame, edges: DataFrame, pages: DataFrame, hops: int, most: int) -> DataFrame:
    """``task_id, start, page``: the ``most`` used pages of nodes within ``hops`` of each start that are neither loaded nor loading.

    ``pages`` has ``task_id, node, page, state, access_count``.
    """
    free = pages.where("state not in ('RESIDENT', 'FAULTING')").select(GRAPH, "node", "page", "access_count")
    near = within_hops(starts, edges, hops).join(free, [GRAPH, "node"]).select(GRAPH, "start", "page", "access_count").distinct()
    w = Window.partitionBy(GRAPH, "start").orderBy(F.col("access_count").desc(), "page")
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select(GRAPH, "start", "page")


def valid_edges(wanted: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``verdict`` of new edges: UNKNOWN_NODE, DUPLICATE, CYCLE or OK. Paths are followed from the wanted targets only.

    One task graph is bounded; its nodes and edges are held while its wanted edges
    stream by, so that nothing is joined or broadcast.
    """
    none = F.lit(None).cast("bigint").alias("dst")
    rows = nodes.select(GRAPH, F.lit(0).alias("kind"), F.col("node").cast("bigint").alias("src"), none)
    rows = rows.unionByName(edges.select(GRAPH, F.lit(1).alias("kind"), "src", "dst")).unionByName(wanted.select(GRAPH, F.lit(2).alias("kind"), "src", "dst"))

    def start() -> dict:
        return {"nodes": set(), "after": {}, "reached": {}}

    def reach(s: dict, node: int) -> set:
        seen = s["reached"].get(node)
        if seen is None:
            seen, front = set(), [node]
            while front:
                fresh = [x for x in s["after"].get(front.pop(), ()) if x not in seen]
                seen.update(fresh)
                front += fresh
            s["reached"][node] = seen
        return seen

    def step(task: int, s: dict, g: Rows) -> list[tuple]:
        out = []
        for kind, src, dst in zip(g["kind"], g["src"], g["dst"]):
            if kind == 0:
                s["nodes"].add(src)
            elif kind == 1:
                s["after"].setdefault(src, set()).add(dst)
            elif src is None or dst is None or src not in s["nodes"] or dst not in s["nodes"]:
                out.append((task, src, dst, "UNKNOWN_NODE"))
            elif dst in s["after"].get(src, ()):
                out.append((task, src, dst, "DUPLICATE"))
            else:
                out.append((task, src, dst, "CYCLE" if src == dst or src in reach(s, dst) else "OK"))
        return out

    found = folded(rows, GRAPH, ["kind"], f"{GRAPH} bigint, src bigint, dst bigint, verdict string", start, step)
    return found.unionByName(wanted.where(F.col(GRAPH).isNull()).select(GRAPH, "src", "dst", F.lit("UNKNOWN_NODE").alias("verdict")))


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after removal of ``gone`` and the edges at them."""
    g = gone.select(GRAPH, "node")
    left = nodes.join(g, [GRAPH, "node"], "left_anti")
    e = edges.join(g.withColumnRenamed("node", "src"), [GRAPH, "src"], "left_anti").join(g.withColumnRenamed("node", "dst"), [GRAPH, "dst"], "left_anti")
    return left, e


def branch_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges among branch members and all their ancestors."""
    up = reached(edges, members, backwards=True).select(GRAPH, "node")
    keep = members.select(GRAPH, "node").union(up).distinct()
    e = edges.join(keep.withColumnRenamed("node", "src"), [GRAPH, "src"], "left_semi")
    return e.join(keep.withColumnRenamed("node", "dst"), [GRAPH, "dst"], "left_semi").select(GRAPH, "src", "dst")


def chain_of(steps: DataFrame, *order: Column) -> DataFrame:
    """Linear graph of a step list: an edge from each step to the next."""
    w = Window.partitionBy(GRAPH).orderBy(*order)
    return steps.withColumn("src", F.lag("node").over(w)).where("src is not null").select(GRAPH, "src", F.col("node").alias("dst"))


def centroids(members: DataFrame, page: str, vector: str) -> DataFrame:
    """Unit mean vector of every page: ``page, values`` (array<double>).

    Sums are combined in each task before the shuffle, one row per page.
    """
    width = "double"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list] = {}
        for b in batches:
            for p, x in zip(b[page], b[vector]):
                x = np.asarray(x, np.float64)
                s = sums.get(p)
                if s is None:
                    sums[p] = [x.copy(), 1]
                else:
                    s[0] += x
                    s[1] += 1
        if sums:
            yield pd.DataFrame({page: list(sums), "total": [s[0].tolist() for s in sums.values()], "n": [s[1] for s in sums.values()]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list] = {}
        for b in batches:
            for p, t, n in zip(b[page], b["total"], b["n"]):
                s = sums.get(p)
                if s is None:
                    sums[p] = [np.asarray(t, np.float64).copy(), n]
                else:
                    s[0] += np.asarray(t)
                    s[1] += n
        if sums:
            mean = {p: s[0] / s[1] for p, s in sums.items()}
            norm = {p: np.sqrt((m * m).sum()) for p, m in mean.items()}
            yield pd.DataFrame({page: list(mean), "values": [(m / norm[p] if norm[p] > 1e-12 else m).tolist() for p, m in mean.items()], "n": [s[1] for s in sums.values()]})

    part = members.select(page, vector).mapInPandas(partial, f"{page} string, total array<{width}>, n bigint")
    return part.repartition(page).mapInPandas(whole, f"{page} string, values array<{width}>, n bigint")


def nearest_open_page(vectors: DataFrame, pages: DataFrame, reach: float) -> DataFrame:
    """``id, page_id, distance``: the page of least cosine distance in the vector's namespace, up to ``reach``.

    ``pages`` are those with room (``namespace, page_id, centre``). Each task keeps
    the best page of a vector before the shuffle. Vectors out of reach drop out.
    """
    each = vectors.join(pages, "namespace").withColumn("distance", F.round(1 - scalar.cosine(F.col("embedding"), F.col("centre")), 6)).where(F.col("distance") <= reach)
    best = each.groupBy("id").agg(F.min(F.struct("distance", "page_id")).alias("b"))
    return best.select("id", "b.page_id", "b.distance")


def cosine_pages(vectors: DataFrame, group: str, size: int = 10, rounds: int = 10, settle: float = 1e-3) -> DataFrame:
    """``id, page_id``: cosine k-means of each group into about ``n / size`` pages.

    Seeds go farthest first from the least id, one after the other over the
    whole group, so a group is the work of one task. Its unit vectors lie in a
    file mapped into memory; similarities are made for some rows at a time.
    """

    def start() -> dict:
        return {"ids": [], "file": tempfile.TemporaryFile(), "width": 0}

    def step(key: str, s: dict, rows: Rows) -> None:
        x = np.asarray(rows["embedding"], np.float64)
        n = np.sqrt((x * x).sum(1))
        s["file"].write((x / np.where(n > 0, n, 1)[:, None]).tobytes())
        s["ids"] += rows["id"]
        s["width"] = x.shape[1]

    def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        rows = max(1, 4_000_000 // len(c))
        return np.concatenate([(x[lo : lo + rows] @ c.T).argmax(1) for lo in range(0, len(x), rows)])

    def finish(key: str, s: dict) -> list[tuple]:
        s["file"].flush()
        x = np.asarray(np.memmap(s["file"], np.float64, "r", shape=(len(s["ids"]), s["width"])))
        k = -(-len(x) // size)
        chosen, near = [0], x @ x[0]
        while len(chosen) < k:
            far = int(near.argmin())
            chosen.append(far)
            near = np.maximum(near, x @ x[far])
        c = x[chosen]
        for _ in range(rounds):
            new = np.zeros_like(c)
            np.add.at(new, nearest(x, c), x)
            norm = np.sqrt((new * new).sum(1))
            new = np.where(norm[:, None] > 1e-12, new / np.where(norm > 1e-12, norm, 1)[:, None], c)
            moved = 1 - (new * c).sum(1)
            c = new
            if moved.max() <= settle:
                break
        own = nearest(x, c)
        s["file"].close()
        return [(v, f"{key}-p{i}") for v, i in zip(s["ids"], own)]

    rows = vectors.select(F.col(group).alias("_g"), "id", "embedding")
    return folded(rows, "_g", ["id"], "id string, page_id string", start, step, finish)


def incremental_pages(vectors: DataFrame, group: str, order: str, size: int = 10, reach: float = 0.30) -> DataFrame:
    """``id, page_id``: vectors join the nearest page in reach that has room, else open one; in order.

    Pages keep a running unit centroid. The rule is sequential, so a group is
    one fold of its rows in order; its state is the pages that still have room.
    """

    def start() -> dict:
        return {"c": None, "count": np.zeros(0, np.int64), "page": np.zeros(0, np.int64), "held": 0, "full": 0, "pages": 0}

    def step(key: str, s: dict, rows: Rows) -> list[tuple]:
        x = np.asarray(rows["embedding"], np.float64)
        n = np.sqrt((x * x).sum(1))
        x = x / np.where(n > 0, n, 1)[:, None]
        own = []
        for v in x:
            at, held = -1, s["held"]
            if held:
                d = 1 - s["c"][:held] @ v
                d[s["count"][:held] >= size] = np.inf
                at = int(d.argmin()) if d.min() <= reach else -1
            if at < 0:
                if held == len(s["page"]):
                    more = max(64, held)
                    s["c"] = np.concatenate([np.zeros((0, x.shape[1])) if s["c"] is None else s["c"], np.zeros((more, x.shape[1]))])
                    s["count"], s["page"] = (np.concatenate([s[c], np.zeros(more, np.int64)]) for c in ("count", "page"))
                at, s["held"] = held, held + 1
                s["c"][at], s["count"][at], s["page"][at] = v, 0, s["pages"]
                s["pages"] += 1
            else:
                m = (s["c"][at] * s["count"][at] + v) / (s["count"][at] + 1)
                z = np.sqrt(m @ m)
                s["c"][at] = m / z if z > 1e-12 else m
            s["count"][at] += 1
            own.append(s["page"][at])
            s["full"] += int(s["count"][at] >= size)
            # full pages leave the state, in batches; the others keep their order
            if s["full"] > 64 and 2 * s["full"] > s["held"]:
                k = np.flatnonzero(s["count"][: s["held"]] < size)
                for c in ("c", "count", "page"):
                    s[c] = s[c][k]
                s["held"], s["full"] = len(k), 0
        return [(v, f"{key}-i{i}") for v, i in zip(rows["id"], own)]

    rows = vectors.select(F.col(group).alias("_g"), "id", order, "embedding")
    return folded(rows, "_g", [F.col(order).asc_nulls_last(), "id"], "id string, page_id string", start, step)
