"""Communities: weights, local moving, names, modularity."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import expr as X

from .paths import cut, drop, numbered, together

PASSES, CHUNK = 10_000, 1 << 17  # passes, and nodes that leave a task at once
MANY, BLOCK = 200, 1 << 16  # blocks of so many links are looked at once fewer than a node in so many moves
RUN = 1 << 10  # links from which on a run of nodes that aren't joined has its turns at once
SLICES = 4  # parts of the edges that are numbered one after the other


def pair_weights(edges: DataFrame) -> DataFrame:
    """Undirected pairs with their number of edges; self-loops are left out."""
    return edges.where("src <> dst").groupBy("graph", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("w"))


def weighted_degrees(pairs: DataFrame) -> DataFrame:
    both = pairs.select("graph", F.col("a").alias("id"), "w").union(pairs.select("graph", "b", "w"))
    return both.groupBy("graph", "id").agg(F.sum("w").alias("deg"))


def moved(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Single-level local moving over nodes 0 to n - 1 in order, joined by pairs ``a, b`` of weight ``w``: each node's
    community. A node goes to the neighbouring community of highest ``w - deg * tot / 2m``; a tie keeps its own, then the
    smallest.

    What a node does depends on the communities of its neighbours and on their totals, so it needs a turn only if one of
    these communities changed since its last. Nodes that follow each other and aren't joined depend on each other by
    totals alone, so a run of them has its turns at once. Other nodes have them one by one: all while many nodes move,
    then what is left of a block is looked at again after each move."""
    src, dst, w = np.r_[a, b], np.r_[b, a].astype(np.int32), np.r_[w, w]
    degrees = np.bincount(src, w, n)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(src, minlength=n), out=starts[1:])
    order = np.argsort(src, kind="stable")
    dst, w = dst[order], w[order]
    del src, order
    own, total, deg, start, m2 = np.arange(n, dtype=np.int32), array("d", degrees), degrees.tolist(), starts.tolist(), float(degrees.sum())
    totals = np.frombuffer(total)
    now, changed, asked = 0, np.zeros(n, np.int64), np.full(n, -1)  # times: a community's last change, a node's last turn
    up, down, mark = np.zeros(n), np.zeros(n), np.zeros(n, bool)

    def turn(i: int) -> bool:
        nonlocal now
        lo, hi = start[i], start[i + 1]
        home, d = int(own[i]), deg[i]
        to: dict[int, float] = {home: 0.0}
        for c, x in zip(own[dst[lo:hi]].tolist(), w[lo:hi].tolist()):
            to[c] = to.get(c, 0.0) + x
        total[home] -= d
        best, most = home, to[home] - d * total[home] / m2
        for c, x in to.items():
            gain = x - d * total[c] / m2
            if gain > most or gain == most and best != home and c < best:
                best, most = c, gain
        total[best] += d
        now += 1
        asked[i] = now
        if best != home:
            own[i], changed[home], changed[best] = best, now, now
        return best != home

    def turns(rest: np.ndarray) -> int:
        moves = 0
        while len(rest):
            lo, hi = starts[rest[0]], starts[rest[-1] + 1]
            last = np.maximum.reduceat(changed[own[dst[lo:hi]]], starts[rest] - lo)
            open_ = np.flatnonzero(np.maximum(last, changed[own[rest]]) > asked[rest]).tolist()
            k = next((k for k in open_ if turn(int(rest[k]))), len(rest))
            moves, rest = moves + (k < len(rest)), rest[k + 1 :]
        return moves

    def choices(nodes: np.ndarray) -> np.ndarray:
        """Where nodes, no two of which are joined, go by their turns. All choose by the totals as they are; then by those
        that the choices before leave, until no choice changes."""
        size = starts[nodes + 1] - starts[nodes]
        links = np.repeat(starts[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
        at, home, d = np.arange(len(nodes)), own[nodes], degrees[nodes]
        pair = np.r_[np.repeat(at, size), at] * n + np.r_[own[dst[links]], home]
        order = np.argsort(pair)
        pair = pair[order]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        x = np.add.reduceat(np.r_[w[links], np.zeros(len(nodes), w.dtype)][order], first)
        i, c = np.divmod(pair[first], n)
        stays = c == home[i]
        ours, theirs = np.where(stays, d[i], 0.0), np.where(stays, 0.0, d[i])
        np.add.at(up, c, theirs)
        np.add.at(down, home, d)
        tot = totals[c] - ours
        low, high = tot - down[c] + ours, tot + up[c] - theirs  # whatever the others do
        up[c], down[home] = 0, 0
        sure = np.maximum.reduceat(x - d[i] * high / m2, np.flatnonzero(np.r_[True, i[1:] != i[:-1]]))
        can = x - d[i] * low / m2 >= sure[i]

        def best(i: np.ndarray, c: np.ndarray, x: np.ndarray, stays: np.ndarray, tot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lead = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            gain = x - d[i] * tot / m2
            most = np.repeat(np.maximum.reduceat(gain, lead), np.diff(np.r_[lead, len(i)]))
            got = np.minimum.reduceat(np.where(gain == most, np.where(stays, -1, c), n), lead)
            return i[lead], np.where(got < 0, home[i[lead]], got)

        i, c, x, stays, tot = i[can], c[can], x[can], stays[can], tot[can]
        to = best(i, c, x, stays, tot)[1]
        several = np.bincount(i, minlength=len(nodes))[i] > 1
        i, c, x, stays, tot = i[several], c[several], x[several], stays[several], tot[several]
        while len(i):
            went = np.flatnonzero(to != home)
            when = np.r_[home[went], to[went]] * len(nodes) + np.r_[went, went]
            order = np.argsort(when)
            by, when = np.r_[0.0, np.cumsum(np.r_[-d[went], d[went]][order])], when[order]
            which, goes = best(i, c, x, stays, tot + by[np.searchsorted(when, c * len(nodes) + i)] - by[np.searchsorted(when, c * len(nodes))])
            if (to[which] == goes).all():
                break
            to[which] = goes
        return to

    def at_once(run: np.ndarray) -> int:
        nonlocal now
        lo, hi = starts[run[0]], starts[run[-1] + 1]
        near, own_run = own[dst[lo:hi]], own[run]
        touched = lambda by: np.maximum(np.maximum.reduceat(by[near], starts[run] - lo), by[own_run])
        rest = touched(changed) > asked[run]
        while rest.any():
            nodes = run[rest]
            home, to = own_run[rest], choices(nodes)
            went = np.flatnonzero(to != home)
            both = np.r_[home[went], to[went]]
            mark[both] = True
            more = touched(mark) & ~rest if len(went) else rest & False
            mark[both] = False
            if more.any():  # a run's moves may give turns to others of it
                rest |= more
                continue
            d = degrees[nodes[went]]
            np.add.at(totals, both, np.r_[-d, d])
            own[nodes], asked[nodes] = to, now + np.flatnonzero(rest) + 1
            np.maximum.at(changed, both, np.tile(asked[nodes[went]], 2))
            now += len(run)
            return len(went)
        return 0

    linked = np.flatnonzero(np.diff(starts))
    if not len(linked):
        return own
    before = np.full(n, -1)  # the last of the earlier neighbours
    before[linked] = np.maximum.reduceat(np.where(dst < np.repeat(np.arange(n, dtype=np.int32), np.diff(starts)), dst, -1), starts[linked])
    runs, lo = [], 0
    for k, (i, last) in enumerate(zip(linked.tolist(), before[linked].tolist())):
        if k > lo and (last >= linked[lo] or start[i + 1] - start[linked[lo]] > BLOCK):
            runs.append((lo, k))
            lo = k
    runs.append((lo, len(linked)))
    del before
    parts, lo = [], 0  # runs of many links, and what lies between them in blocks
    for x, y in [*runs, (len(linked), len(linked))]:
        if x == y or start[linked[y - 1] + 1] - start[linked[x]] >= RUN:
            rest = linked[lo:x]
            parts += [(False, q) for q in np.split(rest, np.flatnonzero(np.diff(starts[rest] // BLOCK)) + 1) if len(q)]
            parts += [(True, linked[x:y])] if y > x else []
            lo = y
    moves = len(linked)
    for _ in range(PASSES):
        few = moves * MANY < len(linked)
        moves = sum(at_once(q) if run else turns(q) if few else sum(map(turn, q.tolist())) for run, q in parts)
        if not moves:
            return own
    raise RuntimeError("communities don't settle")


def by_smallest(own: np.ndarray) -> np.ndarray:
    """Communities numbered by their smallest member."""
    _, first, at = np.unique(own, return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int32)
    number[np.argsort(first)] = np.arange(len(first))
    return number[at]


def move_locally(ids: list[str], pairs: list[tuple[str, str, int]]) -> dict[str, int]:
    """The communities of :func:`moved` over ids in order, numbered by smallest member."""
    rank = {x: i for i, x in enumerate(sorted(set(ids)))}
    known = [(rank[a], rank[b], w) for a, b, w in pairs if a in rank and b in rank]
    a, b, w = np.array(known, np.int64).reshape(-1, 3).T
    return dict(zip(rank, by_smallest(moved(len(rank), a, b, w)).tolist()))


def ranked(nodes: DataFrame) -> DataFrame:
    """Nodes with ``rank``, their place by id within the graph, from 0."""
    return nodes.withColumn("rank", F.row_number().over(Window.partitionBy("graph").orderBy("id")) - 1)


def renumbered(nodes: DataFrame) -> DataFrame:
    """Communities numbered from 0 without gaps, by their smallest member; nodes without one (-1) keep that."""
    lead = nodes.where("community >= 0").groupBy("graph", "community").agg(F.min("id").alias("lead"))
    number = lead.withColumn("number", F.row_number().over(Window.partitionBy("graph").orderBy("lead")) - 1).drop("lead")
    out = nodes.join(number, ["graph", "community"], "left").withColumn("community", F.coalesce("number", F.lit(-1)))
    return out.select(nodes.columns)


def numbered_pairs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``graph, id, pos`` of the nodes, numbered over all graphs in order of graph and id, and ``graph, a, b, w``: pairs of these
    numbers with their number of edges. Self-loops are left out; an end without a node is -1. Edges are numbered in
    ``SLICES`` parts that hold both directions of a pair, so that only one part's ids are shuffled at a time."""
    ids = numbered(nodes.select(F.lit("").alias("graph"), F.col("graph").alias("of"), "id").distinct(), "of", "id")
    own, ids = ids, cut(ids.select(F.col("of").alias("graph"), "id", "pos"))
    drop(own)
    side = lambda k: ids.select("graph", F.col("id").alias(k), F.coalesce("pos", F.lit(-1)).alias(f"p{k}")).hint("shuffle_hash")
    part = F.pmod(F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst")), F.lit(SLICES))
    found = []
    for k in range(SLICES):
        e = edges.where("src <> dst").where(part == k).select("graph", "src", "dst")
        for end in ("src", "dst"):
            e = e.join(side(end), ["graph", end], "left").drop(end)
        x, y = (F.coalesce(f"p{end}", F.lit(-1)) for end in ("src", "dst"))
        found.append(cut(e.groupBy("graph", F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(F.count("*").alias("w"))))
        drop()
    return ids, together(found)


def _both(pairs: DataFrame) -> DataFrame:
    """``id, other, w`` of pairs of numbers, in both directions, of ends that are nodes."""
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "w").union(pairs.select("b", "a", "w")).where("id >= 0")


def moved_by_halves(ids: DataFrame, pairs: DataFrame, rounds: int) -> DataFrame:
    """``pos, comm, deg, m2``: the communities of :func:`local_moving` over :func:`numbered_pairs`, each named by a node's
    number."""
    deg = _both(pairs).groupBy(F.col("id").alias("pos")).agg(F.sum("w").alias("deg"))
    m2 = pairs.groupBy("graph").agg((2 * F.sum("w")).alias("m2"))
    own = ids.join(deg, "pos", "left").join(m2, "graph", "left")
    own = cut(own.select("pos", F.col("pos").alias("comm"), F.coalesce("deg", F.lit(0)).alias("deg"), F.coalesce("m2", F.lit(0)).alias("m2")))
    still = 0
    for k in range(rounds):
        drop()
        turn = lambda c: F.pmod(F.xxhash64(c, F.lit(k // 2)), F.lit(2)) == k % 2  # noqa: B023, E731
        now = cut(own.join(own.groupBy("comm").agg(F.sum("deg").alias("tot")), "comm"))
        to = _both(pairs).where(turn("id") & (F.col("other") >= 0))
        to = to.join(now.select(F.col("pos").alias("other"), "comm", "tot").hint("shuffle_hash"), "other").select("id", "comm", "tot", "w")
        home = now.where(turn("pos")).select(F.col("pos").alias("id"), "comm", "tot", F.lit(0).cast("long"))
        choice = to.union(home).repartition("id").groupBy("id", "comm").agg(F.sum("w").alias("w"), F.max("tot").alias("tot"))
        choice = choice.join(now.select(F.col("pos").alias("id"), F.col("comm").alias("home"), "deg", "m2").hint("shuffle_hash"), "id")
        stays = F.col("comm") == F.col("home")
        gain = F.col("w") - F.col("deg") * (F.col("tot") - F.when(stays, F.col("deg")).otherwise(0)) / F.expr("nullif(m2, 0)")
        best = choice.groupBy("id").agg(F.min_by("comm", F.struct(-gain, ~stays, "comm")).alias("best"))
        new = own.join(best.withColumnRenamed("id", "pos"), "pos", "left").withColumn("next", F.coalesce("best", "comm"))
        new = cut(new.select("pos", F.col("next").alias("comm"), "deg", "m2", (F.col("next") != F.col("comm")).alias("moved")))
        still = still + 1 if new.where("moved").isEmpty() else 0
        drop(own, now)
        own = new.drop("moved")
        own._walk = new._walk
        if still == 2:
            break
    return own


def named(ids: DataFrame, own: DataFrame) -> DataFrame:
    """``graph, id, community`` of numbers with their ``comm``; communities are numbered from 0 by their smallest member."""
    got = own.join(own.groupBy("comm").agg(F.min("pos").alias("lead")), "comm").select("pos", "lead")
    lead = ids.join(got.select(F.col("lead").alias("pos")).distinct(), "pos", "left_semi")
    number = numbered(lead.select("graph", F.col("pos").alias("lead")), "lead", name="community")
    return ids.join(got, "pos").join(number.select("lead", "community"), "lead").select("graph", "id", "community")


def local_moving(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """``graph, id, community`` for graphs that no task can hold: all nodes of one half, drawn by hash each
    round, move at once to the neighbouring community of highest ``w - deg * tot / 2m`` (a tie keeps the own, then the
    smallest), until no node of either half moves. Not the result of :func:`louvain`, whose moves follow each other."""
    ids, pairs = numbered_pairs(nodes, edges)
    return named(ids, moved_by_halves(ids, pairs, rounds))


def numbered_modularity(pairs: DataFrame, own: DataFrame, *names: str) -> DataFrame:
    """``graph`` and for each of ``names`` the modularity of that column of ``own`` (``pos, deg``), over :func:`numbered_pairs` all
    of whose ends are nodes. :func:`modularity` takes ids, and ends without a node."""
    side = lambda c: own.select(F.col("pos").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in names]).hint("shuffle_hash")
    met = pairs.join(side("a"), "a").drop("a").join(side("b"), "b")
    inside = [F.sum(F.when(F.col(f"{x}_a") == F.col(f"{x}_b"), F.col("w")).otherwise(0)).alias(f"{x}_in") for x in names]
    out = met.groupBy("graph").agg((2 * F.sum("w")).alias("m2"), *inside)
    for x in names:
        tot = own.groupBy("graph", x).agg(F.sum("deg").cast("double").alias("tot"))
        out = out.join(tot.groupBy("graph").agg(F.sum(F.col("tot") * F.col("tot")).alias(f"{x}_sq")), "graph")
    return out.select("graph", *[(2 * F.col(f"{x}_in") / F.col("m2") - F.col(f"{x}_sq") / F.col("m2") / F.col("m2")).alias(x) for x in names])


def louvain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph, id, community``. The order of moves matters, so each graph is one task; graphs run side by side.
    A task gets aggregated pairs of places instead of ids."""
    ids = numbered(nodes.select("graph", "id").distinct(), "id")
    side = lambda k: ids.select("graph", F.col("id").alias(k), F.col("pos").alias(f"p{k}"))
    pairs = cut(pair_weights(edges))
    for end in "ab":  # one shuffle of ids at a time
        drop()
        own, pairs = pairs, cut(pairs.join(side(end), ["graph", end]).withColumn(end, F.col(f"p{end}")).select("graph", "a", "b", "w"))
        drop(own)
    rows = pairs.union(ids.groupBy("graph").agg(F.count("*").cast("int"), F.lit(-1), F.lit(0).cast("long")))  # and how many nodes there are

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for x in parts:
            graph, pair = x["graph"].array[0], x["b"].to_numpy() >= 0
            found.append([x[c].to_numpy(np.int32)[pair] for c in "abw"])
            if not pair.all():
                n = int(x["a"].to_numpy()[~pair][0])
        a, b, w = (np.concatenate(x) for x in zip(*found))
        del found
        own = by_smallest(moved(n, a, b, w))
        for lo in range(0, len(own), CHUNK):
            part = own[lo : lo + CHUNK]
            yield pd.DataFrame({"graph": graph, "pos": np.arange(lo, lo + len(part), dtype=np.int32), "community": part})

    got = rows.groupBy("graph").applyInPandas(run, "graph string, pos int, community int")
    return got.join(ids, ["graph", "pos"]).select("graph", "id", "community")


def cluster(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their community."""
    return nodes.drop("community").join(louvain(nodes, edges), ["graph", "id"], "left").select(nodes.columns)


def ends(edges: DataFrame) -> DataFrame:
    """``graph, id, degree`` of the ends of edges; a self-loop counts twice."""
    return edges.select("graph", F.explode(F.array("src", "dst")).alias("id")).groupBy("graph", "id").agg(F.count("*").alias("degree"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with ``degree``, both directions; ends without a node count."""
    return nodes.join(ends(edges), ["graph", "id"], "full").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def members(nodes: DataFrame) -> DataFrame:
    return nodes.where("community >= 0").groupBy("graph", "community").agg(F.sort_array(F.collect_list("id")).alias("members"))


def dominant_dirs(nodes: DataFrame) -> DataFrame:
    """``graph, community, dir`` where one directory holds more than half of a community; files at the root
    count as members but not as a directory."""
    inside = nodes.where("community >= 0").withColumn("dir", X.dir_of("file"))
    size = inside.groupBy("graph", "community").agg(F.count("*").alias("size"))
    per = inside.where("dir <> ''").groupBy("graph", "community", "dir").agg(F.count("*").alias("n"))
    top = per.groupBy("graph", "community").agg(F.max(F.struct("n")).alias("m"), F.min_by("dir", F.struct(-F.col("n"), "dir")).alias("dir"))
    return top.join(size, ["graph", "community"]).where("2 * m.n > size").select("graph", "community", "dir")


def central_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Member of highest degree of each community, the smallest id on a tie."""
    inside = degrees(nodes, edges).where("community >= 0")
    return inside.groupBy("graph", "community").agg(F.min_by(F.struct("id", "label", "degree"), F.struct(-F.col("degree"), "id")).alias("c")).select("graph", "community", "c.*")


def name_communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph, id, label, members``."""
    named = members(nodes).join(dominant_dirs(nodes), ["graph", "community"], "left").join(central_members(nodes, edges).select("graph", "community", F.col("label").alias("central")), ["graph", "community"], "left")
    return named.select("graph", F.col("community").alias("id"), F.coalesce(X.dir_label("dir"), F.col("central")).alias("label"), "members")


def modularity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph, q`` of the communities that nodes carry. Edges are counted by the communities of their ends, so what is
    summed up is as small as the pairs of communities that meet."""
    side = lambda k: nodes.select("graph", F.col("id").alias(k), F.struct("community").alias(f"c{k}"))
    met = edges.where("src <> dst").select("graph", "src", "dst").join(side("src"), ["graph", "src"], "left").join(side("dst"), ["graph", "dst"], "left")
    met = met.groupBy("graph", "csrc", "cdst").agg(F.count("*").alias("n"))
    inside = F.when(F.col("csrc") == F.col("cdst"), 2 * F.col("n")).otherwise(0)
    per = met.select("graph", "n", inside.alias("inside"), F.explode(F.array("csrc", "cdst")).alias("c")).groupBy("graph", "c").agg(F.sum("n").alias("tot"), F.sum("inside").alias("inside"))
    sums = per.groupBy("graph").agg((F.sum("inside") / 2).alias("inside"), F.sum("tot").alias("m2"), F.sum(F.when(F.col("c").isNotNull(), F.col("tot") * F.col("tot"))).alias("sq"))
    return sums.select("graph", (F.col("inside") / F.col("m2") - F.col("sq") / F.col("m2") / F.col("m2")).alias("q"))
