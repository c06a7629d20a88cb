"""Analysis: hubs, edges between communities, import cycles, questions."""

from __future__ import annotations

from array import array
from bisect import bisect, bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import ends
from .paths import cut, drop, numbered

HUBS, CHUNK = 7, 1 << 17  # hubs; members or cycles that leave a task at once


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int = HUBS) -> DataFrame:
    """The ``top`` nodes of highest degree (2 at least) of each graph, ids in order on a tie."""
    order = Window.partitionBy("graph").orderBy(F.desc("degree"), "id")
    known = ends(edges).where("degree >= 2").join(nodes, ["graph", "id"]).where("label is not null")
    return known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def biggest_community(nodes: DataFrame) -> DataFrame:
    per = nodes.where("community >= 0").groupBy("graph", "community").agg(F.count("*").alias("n"))
    return per.groupBy("graph").agg(F.min_by(F.struct("community", "n"), F.struct(-F.col("n"), "community")).alias("b")).select("graph", "b.*")


def surprising_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends lie in different communities; ends without a node or community don't count."""
    side = lambda k: nodes.where("community >= 0").select("graph", F.col("id").alias(k), F.col("community").alias(f"{k}_community"))
    return edges.join(side("src"), ["graph", "src"]).join(side("dst"), ["graph", "dst"]).where("src_community <> dst_community")


def back_edges(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Back edges of a depth-first search over nodes 0 to n - 1 in order: ``from, to, least, size, parent``. Each closes
    one cycle, the path of the tree from ``to`` down to ``from``, of ``size`` nodes and with ``least`` as its smallest.

    They come in the order of the cycles, each read from its smallest member on: those with one smallest member are walks
    down one tree, which part where the search took another neighbour, so they lie as the search met them; only one that
    ends where others go on comes before these. No cycle is spelt out, since all of them may hold the square of the
    graph. ``parent`` is of the tree."""
    links = src.astype(np.int64) * n + dst
    links.sort()
    if len(links) and not (new := np.diff(links, prepend=-1) != 0).all():
        links = links[new]
    nxt = np.searchsorted(links, np.arange(n + 1, dtype=np.int64) * n)
    to, nxt = memoryview((links % max(n, 1)).astype(np.int32)), nxt.tolist()
    del links
    end, depth, entered, parent = nxt[1:], [-1] * n, [0] * n, [-1] * n  # depth: -1 new, -2 done
    least_at, least, size, undo = [0] * (n + 1), [0] * (n + 1), 0, []  # places and values of the minima of the path's ends
    out, clock = [array("i"), array("i"), array("i"), array("i"), array("q")], 0
    add_from, add_to, add_least, add_size, add_time = (x.append for x in out)
    for start in range(n):
        if depth[start] != -1 or nxt[start] == end[start]:
            continue
        path, new = [], start
        while True:
            if new >= 0:
                k = bisect(least, new, 0, size)
                undo.append((k, least_at[k], least[k], size))
                least_at[k], least[k], size = len(path), new, k + 1
                depth[new], entered[new], here = len(path), clock, new
                clock += 1
                path.append(new)
            i, last, new = nxt[here], end[here], -1
            while i < last:
                y = to[i]
                i += 1
                d = depth[y]
                if d >= 0:
                    low = least[bisect_left(least_at, d, 0, size)]
                    add_from(here)
                    add_to(y)
                    add_least(low)
                    add_size(len(path) - d)
                    add_time(entered[here] if y == low else clock)
                    clock += 1
                elif d == -1:
                    new = y
                    break
            nxt[here] = i
            if new >= 0:
                parent[new] = here
                continue
            depth[path.pop()] = -2
            k, least_at[k], least[k], size = undo.pop()
            if not path:
                break
            here = path[-1]
    a, b, low, count, time = (np.frombuffer(x, x.typecode) if len(x) else np.zeros(0, x.typecode) for x in out)
    order = np.lexsort((time, low))
    return a[order], b[order], low[order], count[order], np.array(parent, np.int32)


def spelt(a: int, b: int, low: int, parent: list[int]) -> list[int]:
    """The members of the cycle that a back edge from ``a`` to ``b`` closes, from the smallest on."""
    up = [a]
    while up[-1] != b:
        up.append(parent[up[-1]])
    k = len(up) - up.index(low) - 1
    up.reverse()
    return up[k:] + up[:k]


def back_edge_cycles(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Cycles closed by the back edges of a depth-first search in id order, turned to their smallest member."""
    ids = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(ids)}
    src, dst = (np.array([at[p[i]] for p in pairs], np.int64) for i in (0, 1))
    a, b, low, _, parent = back_edges(len(ids), src, dst)
    return [[ids[i] for i in spelt(*x, parent.tolist())] for x in zip(a.tolist(), b.tolist(), low.tolist())]


def _cyclic(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports by the places of their ends, without nodes that no cycle can hold: ``graph, a, b``; and ``graph, id, pos``."""
    e = cut(edges.where("relation = 'imports'").select("graph", "src", "dst").distinct())
    ids = numbered(e.select("graph", F.col("src").alias("id")).union(e.select("graph", "dst")).distinct(), "id")
    side = lambda k, to: ids.select("graph", F.col("id").alias(k), F.col("pos").alias(to))
    own, e = e, cut(e.join(side("src", "a"), ["graph", "src"]).join(side("dst", "b"), ["graph", "dst"]).select("graph", "a", "b"))
    drop(own)
    n, before = e.count(), None
    while n != before:  # drop edges into ends that import nothing, and out of ends nothing imports
        into, out = e.select("graph", F.col("a").alias("b")).distinct(), e.select("graph", F.col("b").alias("a")).distinct()
        own, e = e, cut(e.join(into, ["graph", "b"], "left_semi").join(out, ["graph", "a"], "left_semi").select("graph", "a", "b"))
        drop(own)
        n, before = e.count(), n
    return e, ids


def _searched(parts: Iterator[pd.DataFrame]) -> tuple[str, dict[int, str], tuple]:
    """A graph's name, the ids it came with and its :func:`back_edges`; its parts hold edges, and nodes where there is an id."""
    graph, ids, pairs = None, {}, []
    for x in parts:
        graph = x["graph"].iloc[0]
        edge = (x["b"] >= 0).to_numpy()
        pairs.append(x.loc[edge, ["a", "b"]].to_numpy(np.int32))
        if "id" in x.columns and not edge.all():
            ids |= zip(x.loc[~edge, "a"].tolist(), x.loc[~edge, "id"].tolist())
    pairs = np.concatenate(pairs)
    n = int(pairs.max()) + 1 if len(pairs) else 0
    return graph, ids, back_edges(n, pairs[:, 0], pairs[:, 1])


def cycle_sizes(edges: DataFrame) -> DataFrame:
    """``graph, rank, n``: the rank and number of members of each of :func:`import_cycles`, which aren't spelt out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, _, (*_, size, _) = _searched(parts)
        for lo in range(0, len(size), CHUNK):
            n = size[lo : lo + CHUNK]
            yield pd.DataFrame({"graph": graph, "rank": np.arange(lo + 1, lo + 1 + len(n), dtype=np.int32), "n": n})

    return _cyclic(edges)[0].groupBy("graph").applyInPandas(run, "graph string, rank int, n int")


def import_cycles(edges: DataFrame) -> DataFrame:
    """``graph, rank, members``, in the order of the members. Nodes that no cycle can hold are peeled off before a graph
    goes to its task, by places instead of ids; what it finds leaves it in portions."""
    e, ids = _cyclic(edges)
    rows = e.withColumn("id", F.lit(None).cast("string")).unionByName(ids.select("graph", F.col("pos").alias("a"), F.lit(-1).alias("b"), "id"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, ids, (a, b, low, size, parent) = _searched(parts)
        parent, lo = parent.tolist(), 0
        while lo < len(a):
            hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(size[lo : lo + CHUNK], dtype=np.int64), CHUNK)))
            cycles = [[ids[i] for i in spelt(*x, parent)] for x in zip(a[lo:hi].tolist(), b[lo:hi].tolist(), low[lo:hi].tolist())]
            yield pd.DataFrame({"graph": graph, "rank": np.arange(lo + 1, lo + 1 + len(cycles), dtype=np.int32), "members": cycles})
            lo = lo + len(cycles)

    return rows.groupBy("graph").applyInPandas(run, "graph string, rank int, members array<string>")


def short_cycles(edges: DataFrame) -> DataFrame:
    """All import cycles of two or three nodes, as joins: ``graph, members``."""
    e = edges.where("relation = 'imports' and src <> dst").select("graph", "src", "dst").distinct()
    a, b, d = (e.select("graph", F.col("src").alias(x), F.col("dst").alias(y)) for x, y in (("x", "y"), ("y", "z"), ("z", "w")))
    paths = a.join(b, ["graph", "y"]).where("x < y and x <= z")
    two = paths.where("x = z").select("graph", F.array("x", "y").alias("members"))
    three = paths.where("x < z").join(d, ["graph", "z"]).where("w = x").select("graph", F.array("x", "y", "z").alias("members"))
    return two.union(three)


#: In place of questions that a graph has no material for.
GENERAL = ["Where does execution start?", "Which modules are independent of each other?", "How is the code laid out?"]


def questions(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Three questions for each graph, ``graph, rank, question``: those that its hub, first link across and
    biggest community give, then general ones."""
    graphs = nodes.select("graph").distinct()
    hub = god_nodes(nodes, edges, 1).select("graph", F.format_string("Which parts rely on %s, and what would break without it (%d links)?", "label", "degree").alias("q1"))
    odd = surprising_edges(nodes, edges).groupBy("graph").agg(F.min(F.struct("src", "dst", "relation")).alias("e")).select("graph", F.format_string("Why does %s %s %s although they lie in different districts?", "e.src", "e.relation", "e.dst").alias("q2"))
    big = biggest_community(nodes).join(communities.select("graph", F.col("id").alias("community"), "label"), ["graph", "community"]).select("graph", F.format_string("What holds the %s district (%d members) together?", "label", "n").alias("q3"))
    all_ = graphs.join(hub, "graph", "left").join(odd, "graph", "left").join(big, "graph", "left")
    three = F.slice(F.concat(F.array_compact(F.array("q1", "q2", "q3")), F.array(*map(F.lit, GENERAL))), 1, 3)
    return all_.select("graph", F.posexplode(three).alias("rank", "question")).withColumn("rank", F.col("rank") + 1)
