"""Assembly: first writer wins, distinct edges, merge with a guard, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import expr as X
from graphloom.schema import CONFIDENCES, ENDPOINT_KINDS, KINDS, RELATIONS, Graph

EDGE = ["graph", "src", "dst", "relation", "confidence"]


def first_writer(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in the order of extraction. An aggregation, so hot keys combine early."""
    rest = [x for x in rows.columns if x not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return first.select(*keys, *[F.col("__first")[x].alias(x) for x in rest]).select(rows.columns)


def collisions(rows: DataFrame) -> DataFrame:
    """Ids that more than one definition maps to: ``graph, id, n``."""
    return rows.groupBy("graph", "id").agg(F.countDistinct("label", "file", "kind", "line").alias("n")).where("n > 1")


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select(EDGE).distinct()


def assemble(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Graph from extracted rows; ``nodes`` may carry ``seq`` (place in its file)."""
    order = ["file", *(["seq"] if "seq" in nodes.columns else []), "line", "label"]
    keep = first_writer(nodes, ["graph", "id"], order)
    return Graph(keep.drop("seq"), distinct_edges(edges))


def merge(old: DataFrame, new: DataFrame, keys: list[str], prune: bool = False) -> DataFrame:
    """New rows and the old ones they don't replace; with ``prune`` the new ones only."""
    return new if prune else new.unionByName(old.join(new.select(keys), keys, "left_anti"))


def guard_shrink(merged: DataFrame, high_water: int, prune: bool = False) -> DataFrame:
    """Raises if there would be fewer nodes than before."""
    n = merged.count()
    if n < high_water and not prune:
        raise ValueError(f"{n} nodes would replace {high_water}; prune to allow it")
    return merged


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge ends that aren't nodes: ``graph, src, dst, end``."""
    ids = nodes.select("graph", F.col("id").alias("end")).distinct()
    ends = edges.select("graph", "src", "dst", F.explode(F.array_distinct(F.array("src", "dst"))).alias("end"))
    return ends.join(ids, ["graph", "end"], "left_anti")


def validate(graph: Graph) -> DataFrame:
    """All violations, ``graph, rank, rule, subject``; the first by rank and subject is the reported one."""
    found = lambda d, rank, rule, subject, gr="graph": d.select(F.col(gr).alias("graph"), F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), F.coalesce(subject, F.lit("")).alias("subject"))
    n, e = graph.nodes, graph.edges
    out = found(n.where("coalesce(id, '') = ''"), 10, "node without id", F.col("label"))
    out = out.union(found(n.groupBy("graph", "id").count().where("count > 1"), 11, "duplicate id", F.col("id")))
    out = out.union(found(n.where(~F.coalesce(F.col("kind").isin(KINDS), F.lit(False))), 12, "unknown kind", F.col("id")))
    out = out.union(found(n.where("line < 0"), 13, "negative line", F.col("id"))).union(found(n.where("community < -1"), 14, "bad community", F.col("id")))
    link = F.concat_ws(" ", "src", "dst")
    out = out.union(found(e.where("coalesce(src, '') = '' or coalesce(dst, '') = ''"), 19, "edge without an end", link))
    out = out.union(found(e.where(~F.coalesce(F.col("relation").isin(RELATIONS), F.lit(False))), 20, "unknown relation", link))
    out = out.union(found(e.where(~F.coalesce(F.col("confidence").isin(CONFIDENCES), F.lit(False))), 21, "unknown confidence", link))
    out = out.union(found(dangling(e, n), 22, "dangling edge", F.col("end")))
    if graph.endpoints is not None:
        p = graph.endpoints
        for k, direction in enumerate(("provides", "consumes")):
            own = p.where(F.col("direction") == direction)
            out = out.union(found(own.where(~F.coalesce(F.col("kind").isin(ENDPOINT_KINDS), F.lit(False))), 30 + 10 * k, f"{direction}: unknown kind", F.col("key"), "service"))
            out = out.union(found(own.where("coalesce(key, '') = ''"), 31 + 10 * k, f"{direction}: no key", F.col("file"), "service"))
            out = out.union(found(own.where(~F.coalesce(F.col("confidence").isin(CONFIDENCES), F.lit(False))), 32 + 10 * k, f"{direction}: unknown confidence", F.col("key"), "service"))
            out = out.union(found(own.where("line < 0"), 33 + 10 * k, f"{direction}: negative line", F.col("key"), "service"))
    return out


def validate_documents(documents: DataFrame, version: str = "1") -> DataFrame:
    """Violations of stored documents ``graph, version, generated_at, root``, before those of their rows."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = [(1, "version", ~F.col("version").eqNullSafe(F.lit(version))), (2, "generated_at", empty("generated_at")), (3, "root", empty("root"))]
    found = F.array_compact(F.array(*[F.when(wrong, F.struct(F.lit(rank).alias("rank"), F.lit(f"document: {c}").alias("rule"), F.coalesce(c, F.lit("")).alias("subject"))) for rank, c, wrong in rules]))
    return documents.select("graph", F.explode(found).alias("x")).select("graph", "x.*")


def validate_registries(registries: DataFrame, text: str = "text", rows: str = "members", key: str = "alias") -> DataFrame:
    """Violations of registry files ``graph, text``: no JSON, a field that lacks, a row without its key or path."""
    d = X.json_as(text, f"struct<version:string,name:string,{rows}:array<struct<{key}:string,path:string>>>")
    none = lambda x: F.coalesce(x, F.lit("")) == ""
    bad = lambda r: F.exists(r, lambda m: none(m[key]) | none(m["path"]))
    lacks = F.col("d.version").isNull() | F.col("d.name").isNull() | F.col(f"d.{rows}").isNull()
    rule = F.when(lacks, F.lit("field lacks")).when(bad(F.col(f"d.{rows}")), F.lit(f"row without {key} or path"))
    return registries.withColumn("d", d).select("graph", rule.alias("rule")).where("rule is not null")


def validate_overlays(overlays: DataFrame, text: str = "text") -> DataFrame:
    """Violations of overlay files ``graph, text``."""
    d = X.json_as(text, "struct<version:string,links:array<struct<from:string,to:string,relation:string,confidence:string>>>")
    parts = ("from", "to", "relation", "confidence")
    lacks = lambda m: F.array_contains(F.array(*[m[c].isNull() for c in parts]), True)
    rule = F.when(F.col("d.version").isNull() | F.col("d.links").isNull(), F.lit("field lacks")).when(F.exists("d.links", lacks), F.lit("link lacks a field"))
    rule = rule.when(F.exists("d.links", lambda m: ~m["confidence"].isin(CONFIDENCES)), F.lit("unknown confidence"))
    return overlays.withColumn("d", d).select("graph", rule.alias("rule")).where("rule is not null")


def first_violation(violations: DataFrame) -> DataFrame:
    return violations.groupBy("graph").agg(F.min(F.struct("rank", "subject", "rule")).alias("v")).select("graph", "v.*")
