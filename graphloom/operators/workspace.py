"""Workspaces: the links language, overlays, federated graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.schema import RELATIONS, Graph


def parse_links(lines: DataFrame, text: Column | str = "value") -> DataFrame:
    """Lines ``a::id -> b::id [relation]`` as ``src, dst, relation, error``; ``#`` starts a comment line, blank
    lines are skipped, further fields ignored. A faulty line keeps its text in ``line`` and says what is wrong."""
    t = F.btrim(F.col(text) if isinstance(text, str) else text)
    rows = lines.select(t.alias("line")).where("line <> '' and not startswith(line, '#')")
    sides = F.split("line", "->", 2)
    right = F.filter(F.split(F.btrim(F.get(sides, 1)), r"\s+"), lambda x: x != "")
    rows = rows.select("line", F.btrim(F.get(sides, 0)).alias("src"), F.get(right, 0).alias("dst"), F.coalesce(F.get(right, 1), F.lit("references")).alias("relation"))
    full = lambda x: F.coalesce(F.col(x).rlike("^[^:\\s]+::\\S+$"), F.lit(False))
    error = F.when(~F.contains("line", F.lit("->")), F.lit("no arrow")).when(~full("src"), F.lit("bad source")).when(~full("dst"), F.lit("bad target"))
    return rows.withColumn("error", error.when(~F.col("relation").isin(RELATIONS), F.lit("unknown relation")))


def overlay(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links with ``status``: resolved if both ends are nodes of the members (``alias, id``), else unresolved."""
    ids = members.select(F.concat("alias", F.lit("::"), "id").alias("__id")).distinct()
    for end in ("src", "dst"):
        links = links.join(ids.select(F.col("__id").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
    both = F.coalesce(F.col("__src") & F.col("__dst"), F.lit(False))
    return links.select("src", "dst", "relation", F.lit("EXTRACTED").alias("confidence"), F.lit("explicit").alias("via"), F.when(both, F.lit("resolved")).otherwise(F.lit("unresolved")).alias("status"))


def federate(members: Graph, links: DataFrame, name: str = "workspace") -> Graph:
    """All members as one graph, ids and files behind ``alias::``, with the resolved links as edges."""
    full = lambda x: F.concat("graph", F.lit("::"), x)
    n = members.nodes.select(F.lit(name).alias("graph"), full("id").alias("id"), "label", "kind", full("file").alias("file"), "line", F.lit(-1).alias("community"))
    e = members.edges.select(F.lit(name).alias("graph"), full("src").alias("src"), full("dst").alias("dst"), "relation", "confidence")
    return Graph(n, e.union(links.where("status = 'resolved'").select(F.lit(name), "src", "dst", "relation", "confidence")))
