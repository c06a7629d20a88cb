"""Lookups and walks: node, neighbours, levels, shortest path, impact."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``; a local one only for local masters."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (base or f"/tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/walk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._walk = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`cut` wrote and nothing reads any more, and shuffle files of finished steps."""
    gc.collect()
    SparkSession.active()._jvm.System.gc()
    for t in tables:
        if path := getattr(t, "_walk", None):
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def together(parts: list[DataFrame]) -> DataFrame:
    """Tables that :func:`cut` wrote, of one schema, as one."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[t._walk for t in parts])


def numbered(rows: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Rows with ``name``, their place from 0 within their graph in an order. A sorted table is numbered part by part and
    the parts' offsets are added, so no task orders a whole graph."""
    rows = cut(rows.orderBy("graph", *order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    each = rows.groupBy("graph", part).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("graph").orderBy("__part")) - F.col("__n")
    parts = each.select("graph", "__part", (before - F.col("__first")).alias("__shift"))
    out = rows.withColumn("__part", part).join(F.broadcast(parts), ["graph", "__part"])
    out = out.withColumn(name, (F.col("__at") + F.col("__shift")).cast("int")).drop("__at", "__part", "__shift")
    out._walk = rows._walk
    return out


def get_node(nodes: DataFrame, id: str) -> DataFrame:
    return nodes.where(F.col("id") == id)


def neighbors(edges: DataFrame, id: str) -> DataFrame:
    """Edges into a node, then out of it: ``direction, other, relation, confidence``."""
    into = edges.where(F.col("dst") == id).select(F.lit("in").alias("direction"), F.col("src").alias("other"), "relation", "confidence")
    return into.union(edges.where(F.col("src") == id).select(F.lit("out"), "dst", "relation", "confidence"))


def both_ways(edges: DataFrame) -> DataFrame:
    keep = edges.where("src <> dst")
    return keep.select("src", "dst").union(keep.select("dst", "src")).distinct()


def fronts(near: DataFrame, start: str) -> Iterator[DataFrame]:
    """The levels of a walk from ``start``, ``id, level, parent, pos`` each, until one is empty.

    ``pos`` grows in the order of discovery: within a level by the parent's, then id, as a queue would find
    them (a sorted table numbered part by part, so no task orders a whole level). Neighbours of a level lie in it, the one
    before or the next, so only two levels are looked at to tell what is new.
    """
    spark = near.sparkSession
    front = cut(spark.createDataFrame([(start, 0, None, 0)], "id string, level int, parent string, pos long"))
    last, level = None, 0
    while not front.isEmpty():
        yield front
        level += 1
        step = near.join(front.select(F.col("id").alias("src"), "pos"), "src")
        for seen in (front, last):
            step = step.join(seen.select(F.col("id").alias("dst")), "dst", "left_anti") if seen is not None else step
        best = step.groupBy("dst").agg(F.min(F.struct("pos", "src")).alias("p")).orderBy("p.pos", "dst")
        new = best.select(F.col("dst").alias("id"), F.lit(level).alias("level"), F.col("p.src").alias("parent"), F.monotonically_increasing_id().alias("pos"))
        last, front = front, cut(new)


def bfs_levels(edges: DataFrame, start: str) -> DataFrame:
    """``id, level, parent, pos`` of all that is reachable, undirected; a level is one join."""
    near = cut(both_ways(edges))
    out = together(list(fronts(near, start)))
    drop(near)
    return out


def levels(edges: DataFrame, start: str) -> DataFrame:
    """``id, level`` of all that is reachable, undirected, without an order within levels."""
    spark, near = edges.sparkSession, cut(both_ways(edges))
    found, level = [cut(spark.createDataFrame([(start, 0)], "id string, level int"))], 0
    while not found[-1].isEmpty():
        level += 1
        step = near.join(found[-1].select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        for seen in found[-2:]:
            step = step.join(seen.select("id"), "id", "left_anti")
        found.append(cut(step.select("id", F.lit(level).alias("level"))))
    drop(near)
    return together(found)


def shortest_path(nodes: DataFrame, edges: DataFrame, a: str, b: str) -> list[str] | None:
    """Ids from a to b, undirected, earliest discovered parents first; None if there is no path, however long."""
    known = {r["id"] for r in nodes.where(F.col("id").isin(a, b)).select("id").distinct().collect()}
    if missing := {a, b} - known:
        raise KeyError(f"unknown node {sorted(missing)[0]}")
    near, found, path = cut(both_ways(edges)), [], None
    for front in fronts(near, a):
        found.append(front)
        if not front.where(F.col("id") == b).isEmpty():
            path = [b]
            for level in reversed(found[1:]):
                path.append(level.where(F.col("id") == path[-1]).select("parent").first()[0])
            break
    drop(near, *found)
    return path[::-1] if path else None


def closure(links: DataFrame, target: str, src: str = "from_service", dst: str = "to_service") -> DataFrame:
    """All that reach ``target`` along links, without itself: ``service``."""
    spark = links.sparkSession
    e = cut(links.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").distinct())
    found = [cut(spark.createDataFrame([(target,)], "service string"))]
    while not found[-1].isEmpty():
        step = e.join(found[-1].select(F.col("service").alias("b")), "b", "left_semi").select(F.col("a").alias("service")).distinct()
        found.append(cut(step.join(together(found), "service", "left_anti")))
    drop(e)
    return together(found).where(F.col("service") != target)


def impact(links: DataFrame, target: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Links into a service (optionally of one key), and all services that depend on it by any key."""
    direct = links.where(F.col("to_service") == target)
    return (direct if key is None else direct.where(F.col("key") == key)), closure(links, target)
