"""Federation of services: matching endpoints, combining graphs, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import expr as X
from graphloom.schema import Graph


def met(rows: DataFrame, others: DataFrame, *on: str) -> DataFrame:
    """Rows with ``n``, how many of ``others`` in another service have the same ``on``."""
    every = others.where("service is not null").groupBy(*on).agg(F.count("*").alias("__all"))
    own = others.groupBy("service", *on).agg(F.count("*").alias("__own"))
    out = rows.join(every, list(on), "left").join(own, ["service", *on], "left")
    n = F.when(F.col("service").isNull(), 0).otherwise(F.coalesce("__all", F.lit(0)) - F.coalesce("__own", F.lit(0)))
    return out.select(*rows.columns, n.alias("n"))


def match(endpoints: DataFrame) -> dict[str, DataFrame]:
    """``links, ambiguous, dangling, orphans``.

    A consumed endpoint meets every provided row of the same kind and key in another service; an http one
    without any meets those of the same path. One candidate makes a link, more are ambiguous, none dangles.
    Providers no candidate pair uses are orphans. Candidates are counted by key and by service, so only the pairs that
    ``links`` and ``ambiguous`` list are made. ``ambiguous`` carries its two sides, for a sink that needs no pairs.
    """
    consumes, provides = (endpoints.where(F.col("direction") == d) for d in ("consumes", "provides"))
    asked = met(consumes, provides, "kind", "key")
    path = X.key_path("key").alias("path")
    rest = asked.where("n = 0 and kind = 'http'").drop("n").select("*", path)
    asked_path = met(rest, provides.where("kind = 'http'").select("*", path), "kind", "path")
    ask = lambda d, at, path_only: d.select("service", "kind", F.col(at).alias("at"), F.lit(path_only).alias("path_only"), "node", "source", "confidence", "n")
    asks = ask(asked, "key", False).union(ask(asked_path, "path", True))
    p = [F.col(x).alias(f"p_{x}") for x in ("service", "key", "node", "confidence", "source")]
    offers = provides.select("kind", F.col("key").alias("at"), F.lit(False).alias("path_only"), *p)
    offers = offers.union(provides.where("kind = 'http'").select("kind", path, F.lit(True), *p))
    pairs = lambda n: asks.where(n).join(offers, ["kind", "at", "path_only"]).where("service <> p_service")
    via = F.concat(F.col("source"), F.lit("->"), F.col("p_source"))
    confidence = F.when(F.col("path_only"), F.lit("INFERRED")).otherwise(X.combine_confidence("confidence", "p_confidence"))
    cols = [F.col("service").alias("from_service"), F.col("p_service").alias("to_service"), F.col("kind"), F.col("p_key").alias("key"), F.col("node").alias("from_node"), F.col("p_node").alias("to_node")]
    links = pairs("n = 1").select(*cols, confidence.alias("confidence"), F.when(F.col("path_only"), F.concat(via, F.lit("+path-only"))).otherwise(via).alias("via"))
    ambiguous = pairs("n > 1").select(*cols, F.lit("AMBIGUOUS").alias("confidence"), via.alias("via"))
    ambiguous._sides = asks.where("n > 1"), offers
    dangling = asked.where("n = 0 and not kind <=> 'http'").drop("n").unionByName(asked_path.where("n = 0").drop("n", "path")).select("service", "kind", "key", "display")
    free = met(provides, consumes, "kind", "key").where("n = 0").drop("n")
    free_path = met(free.where("kind = 'http'").select("*", path), rest, "kind", "path").where("n = 0").drop("n", "path")
    orphans = free.where("not kind <=> 'http'").unionByName(free_path).groupBy("service", "kind", "key").agg(F.min("display").alias("display"))
    return {"links": links, "ambiguous": ambiguous, "dangling": dangling, "orphans": orphans}


def counts(matched: dict[str, DataFrame]) -> dict[str, int]:
    return {k: d.count() for k, d in matched.items()}


def combine(graphs: Graph, links: DataFrame, distinct: bool = False) -> Graph:
    """One graph ``system`` of all services: ids get ``service::`` in front, each service a module node
    ``service::@service``; links become edges between the nodes they name, or the services'."""
    full = lambda g, x: F.concat(g, F.lit("::"), x)
    n, e = graphs.nodes, graphs.edges
    own = n.select(F.lit("system").alias("graph"), full("graph", "id").alias("id"), "label", "kind", full("graph", "file").alias("file"), "line", F.lit(-1).alias("community"))
    hubs = n.select("graph").distinct().select(F.lit("system"), full("graph", F.lit("@service")), "graph", F.lit("module"), F.lit(""), F.lit(0), F.lit(-1))
    nodes = own.union(hubs)
    inner = e.select(F.lit("system").alias("graph"), full("graph", "src").alias("src"), full("graph", "dst").alias("dst"), "relation", "confidence")
    relation = F.when(F.col("kind") == "queue", F.lit("references")).otherwise(F.lit("calls"))
    across = fallback(fallback(links, nodes, "from"), nodes, "to").select(F.lit("system").alias("graph"), F.col("from_id").alias("src"), F.col("to_id").alias("dst"), relation.alias("relation"), "confidence")
    edges = inner.union(across)
    return Graph(nodes, edges.distinct() if distinct else edges)


def fallback(links: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """Links with ``{end}_id``: the named node if it is there, else the service's own."""
    name = F.concat(f"{end}_service", F.lit("::"), F.coalesce(f"{end}_node", F.lit("")))
    known = nodes.select(F.col("id").alias("__id")).distinct()
    got = links.withColumn("__want", name).join(known, F.col("__want") == F.col("__id"), "left")
    return got.withColumn(f"{end}_id", F.coalesce("__id", F.concat(f"{end}_service", F.lit("::@service")))).drop("__id", "__want")


def stale(recorded: DataFrame, current: DataFrame, on: str = "name") -> DataFrame:
    """Members whose recorded hash differs from the current one, or that are gone: ``name, recorded, current``."""
    a, b = recorded.select(on, F.col("map_hash").alias("recorded")), current.select(on, F.col("map_hash").alias("current"))
    return a.join(b, on, "left").where("current is null or recorded <> current")


def upsert(registry: DataFrame, rows: DataFrame, key: str = "name") -> DataFrame:
    return registry.join(rows.select(key), key, "left_anti").unionByName(rows)


def remove(registry: DataFrame, names: list[str], key: str = "name") -> DataFrame:
    return registry.where(~F.col(key).isin(names))
