"""Keyword retrieval: scores, seeds under a token budget, expansion, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import expr as X

BUDGET = 2000


def question_terms(spark: SparkSession, question: str) -> list[str]:
    """Distinct tokens of a question, in order. A scalar, so it is computed on one row."""
    return spark.range(1).select(F.array_distinct(X.tokenize(F.lit(question))).alias("t")).first()["t"]


def doc_freq(nodes: DataFrame) -> DataFrame:
    """Nodes of a graph whose bag of label words and kind holds a term: ``graph, term, df``."""
    bag = F.array_distinct(X.terms("label", "kind"))
    return nodes.select("graph", F.explode(bag).alias("term")).groupBy("graph", "term").agg(F.count("*").alias("df"))


def scores(nodes: DataFrame, words: list[str]) -> DataFrame:
    """Nodes with ``score``: the sum of ln((N + 1) / (df + 1)) over the question's terms in their bag, in the
    question's order (so that equal sums are equal); only scores above 0. Only terms asked for are counted,
    and each graph's weights are one row."""
    if not words:
        return nodes.withColumn("score", F.lit(0.0)).limit(0)
    asked = F.array(*map(F.lit, words))
    own = nodes.withColumn("__own", F.array_intersect(asked, X.terms("label", "kind")))
    df = [F.count_if(F.array_contains("__own", w)).alias(f"df{i}") for i, w in enumerate(words)]
    per = own.groupBy("graph").agg(F.count("*").alias("n"), *df)
    idf = F.array(*[F.log((F.col("n") + 1) / (F.col(f"df{i}") + 1)) for i in range(len(words))])
    per = per.select("graph", F.map_from_arrays(asked, idf).alias("__idf"))
    score = F.aggregate(F.transform("__own", lambda w: F.element_at(F.col("__idf"), w)), F.lit(0.0), lambda a, x: a + x)
    return own.where(F.size("__own") > 0).join(per, "graph").withColumn("score", score).where("score > 0").select(*nodes.columns, "score")


def seeds(scored: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Rows in order of score while their texts fit the budget; the first that doesn't fit ends it."""
    cost = X.token_estimate(X.format_node("id", "kind", "label", "file", "line"))
    order = Window.partitionBy("graph").orderBy(F.desc("score"), "id")
    top = scored.withColumn("cost", cost).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= budget)  # a row costs 1 at least
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("used", F.sum("cost").over(running)).where(F.col("used") <= budget).drop("__r")


def reachable(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Ids within some hops of ``start(graph, id)``, both directions."""
    both = edges.select("graph", F.col("src").alias("id"), F.col("dst").alias("to")).union(edges.select("graph", "dst", "src"))
    seen = front = start.select("graph", "id").distinct()
    for _ in range(hops):
        front = both.join(front, ["graph", "id"], "left_semi").select("graph", F.col("to").alias("id")).distinct().join(seen, ["graph", "id"], "left_anti")
        seen = seen.union(front)
    return seen


def adjacency(edges: DataFrame) -> DataFrame:
    """``graph, id, side, other, relation, confidence, n``: both directions of every edge, each side of a node numbered
    by relation, other end and confidence."""
    both = edges.select("graph", F.col("src").alias("id"), F.lit("out").alias("side"), F.col("dst").alias("other"), "relation", "confidence")
    both = both.union(edges.select("graph", "dst", F.lit("in"), "src", "relation", "confidence"))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("graph", "id", "side").orderBy("relation", "other", "confidence")))


def next_nodes(nodes: DataFrame, edges: DataFrame, queue: list[str], chosen: list[str], room: int) -> list[tuple[str, int]]:
    """Neighbours of a queue of nodes that may still be chosen with ``room`` left, ``(id, cost)`` in order of visits.

    Of each cost only the first ``room // cost`` can be: once so many are chosen, or one of them didn't fit, no other of
    this cost fits either. So what is collected is bounded by ``room`` times its logarithm, whatever a hub's degree.
    """
    spark = nodes.sparkSession
    at = F.broadcast(spark.createDataFrame(list(enumerate(queue)), "pos int, id string"))
    out = edges.join(at, F.col("src") == F.col("id")).select("pos", F.lit(0).alias("side"), "relation", F.col("dst").alias("other"), "confidence")
    into = edges.join(at, F.col("dst") == F.col("id")).select("pos", F.lit(1).alias("side"), "relation", F.col("src").alias("other"), "confidence")
    seen = F.broadcast(spark.createDataFrame([(x,) for x in chosen], "other string"))
    first = out.union(into).join(seen, "other", "left_anti").groupBy("other").agg(F.min(F.struct("pos", "side", "relation", "other", "confidence")).alias("at"))
    cost = X.token_estimate(X.format_node("id", "kind", "label", "file", "line"))
    fit = first.join(nodes.select(F.col("id").alias("other"), cost.alias("cost")), "other").where(F.col("cost") <= room)
    nth = F.row_number().over(Window.partitionBy("cost").orderBy("at"))
    few = fit.withColumn("n", nth).where(F.col("n") <= room).where(F.col("n") <= F.floor(F.lit(room) / F.col("cost")))
    return [(r["other"], r["cost"]) for r in few.orderBy("at").collect()]


def query(nodes: DataFrame, edges: DataFrame, question: str, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Subgraph of one graph that answers a question: nodes and the edges among them.

    Seeds and neighbours are ranked on executors. Which of them are taken depends on the order of visits, so the
    driver decides; the budget bounds what it gets (a node costs 1 at least).
    """
    spark = nodes.sparkSession
    budget = budget if budget > 0 else BUDGET
    start = seeds(scores(nodes, question_terms(spark, question)), budget).orderBy(F.desc("score"), "id").collect()
    chosen, used = [r["id"] for r in start], max([r["used"] for r in start], default=0)
    queue = chosen
    while queue and used < budget:
        found = []
        for x, cost in next_nodes(nodes, edges, queue, chosen, budget - used):
            if used + cost <= budget:
                found.append(x)
                used += cost
        chosen, queue = chosen + found, found
    ids = spark.createDataFrame([(x,) for x in chosen], "id string")
    return nodes.join(F.broadcast(ids), "id", "left_semi"), induced_edges(edges, ids)


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct edges with both ends among ``ids`` (which may carry ``graph``)."""
    keys = ["graph"] if "graph" in ids.columns else []
    for end in ("src", "dst"):
        edges = edges.join(ids.select(*keys, F.col("id").alias(end)).distinct(), [*keys, end], "left_semi")
    return edges.distinct()


def render_text(nodes: DataFrame, edges: DataFrame) -> str:
    """``NODES`` by id and ``EDGES`` in order; for selections, which the budget bounds."""
    n = [r[0] for r in nodes.orderBy("id").select(X.format_node("id", "kind", "label", "file", "line")).collect()]
    e = [r[0] for r in edges.orderBy("src", "dst", "relation", "confidence").select(X.format_edge("src", "dst", "relation", "confidence")).collect()]
    return "".join(f"{x}\n" for x in ["NODES", *n, "", "EDGES", *e])


def search(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose label or file holds a text, whatever its case."""
    return nodes.where(F.contains(X.lower(F.concat_ws(" ", "label", "file")), X.lower(F.lit(text))))
