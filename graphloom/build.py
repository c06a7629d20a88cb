"""A repository as a stored graph: scan, extract, resolve, assemble, cluster, endpoints, pages."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import expr as X
from graphloom.operators import analyze, assemble, cluster, contract, extract, resolve
from graphloom.operators.paths import cut
from graphloom.schema import Graph
from graphloom.sources import maps, scan, viewer
from graphloom.streaming import incremental

FOLDER, MAP, HASHES, FACTS = ".graphloom", "map.json", "hashes.json", "facts"


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def graph_of(files: DataFrame, texts: DataFrame, facts: DataFrame | None = None) -> Graph:
    """Graphs of source files (``scan.scan``) and of the texts that may state endpoints (``scan.contract_files``);
    both may hold many repositories. Files are parsed once: the facts are a table in the shared folder (given, if they
    are known). Raises if the result breaks a rule of the model."""
    nodes, edges, calls = extract.from_facts(cut(extract.facts(files)) if facts is None else facts)
    g = assemble.assemble(nodes, edges.unionByName(resolve.resolve(nodes, calls)))
    edges = cut(g.edges)
    nodes = cut(cluster.cluster(g.nodes, edges))
    wrong = assemble.first_violation(assemble.validate(Graph(nodes, edges))).head(1)
    if wrong:
        raise ValueError(f"{wrong[0]['graph']}: {wrong[0]['rule']}: {wrong[0]['subject']}")
    return Graph(nodes, edges, cut(cluster.name_communities(nodes, edges)), cut(contract.extract(texts, nodes)))


def build(spark: SparkSession, root: str, name: str | None = None) -> Graph:
    name = name or Path(root).resolve().name
    return graph_of(scan.scan(spark, root, name), scan.contract_files(spark, root, name))


def refreshed(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """Facts of files: those stored under the root for files whose content is as it was, the rest parsed anew."""
    folder = Path(root).resolve() / FOLDER
    if not (folder / HASHES).exists() or not (folder / FACTS).exists():
        return cut(extract.facts(files))
    known = json.loads((folder / HASHES).read_text(encoding="utf-8"))
    graph = Path(root).resolve().name
    rows = spark.createDataFrame([(graph, k, v) for k, v in known.items()], "graph string, rel_path string, sha256 string")
    old = spark.read.parquet(f"file://{folder / FACTS}")
    return cut(incremental.refresh(old, files, rows, extract.facts))


def counts(g: Graph) -> dict[str, int]:
    return {"nodes": g.nodes.count(), "edges": g.edges.count(), "communities": g.communities.count()}


def page(g: Graph, title: str) -> str:
    """The Markdown page of one graph; what is collected are a few rows and the districts."""
    link = F.concat_ws(" ", "src", F.concat(F.lit("-"), "relation", F.lit("->")), "dst")
    first = lambda d, *cols: [tuple(r) if len(cols) > 1 else r[0] for r in d.select(*cols).collect()]
    asked = first(analyze.questions(g.nodes, g.edges, g.communities).orderBy("rank"), "question")
    hubs = first(analyze.god_nodes(g.nodes, g.edges).orderBy("rank"), "label", "degree")
    districts = first(g.communities.orderBy("id"), "label", F.size("members").alias("n"))
    odd = first(analyze.surprising_edges(g.nodes, g.edges).orderBy("src", "dst", "relation").limit(20), link.alias("x"))
    return maps.map_markdown(title, counts(g), asked, hubs, districts, odd)


def store(g: Graph, files: DataFrame, root: str, generated_at: str) -> str:
    """Writes map, pages and content hashes under the root; returns the short hash of the map."""
    folder = Path(root) / FOLDER
    folder.mkdir(parents=True, exist_ok=True)
    title = Path(root).resolve().name
    digest = maps.write_map(g, str(folder / MAP), generated_at, title)
    (folder / "MAP.md").write_text(page(g, title), encoding="utf-8")
    viewer.write(g, str(folder / "map.html"), title, generated_at)
    known = {r["rel_path"]: r["sha256"] for r in incremental.hashes(files).orderBy("rel_path").collect()}
    (folder / HASHES).write_text(json.dumps(known, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    return digest


def run(spark: SparkSession, root: str, generated_at: str | None = None) -> dict[str, int]:
    """A build that parses only files that changed since the last one, stored; counts of files, nodes, edges and
    communities. The facts are stored first and the hashes last: if it breaks off between, files are parsed again."""
    name, folder = Path(root).resolve().name, Path(root).resolve() / FOLDER
    files = scan.scan(spark, root, name)
    facts = refreshed(spark, files, root)
    g = graph_of(files, scan.contract_files(spark, root, name), facts)
    (folder / HASHES).unlink(missing_ok=True)
    facts.write.mode("overwrite").parquet(f"file://{folder / FACTS}")
    store(g, files, root, generated_at or now())
    return {"files": files.count(), **counts(g)}


def load(spark: SparkSession, root: str, name: str | None = None) -> Graph:
    """The stored graph of a root, under a name; it is built first if it isn't there."""
    path = Path(root) / FOLDER / MAP
    if not path.exists():
        run(spark, root)
    return rename(maps.load(spark, str(path)), name or Path(root).resolve().name)


def rename(g: Graph, name: str) -> Graph:
    own = lambda d, c="graph": d.withColumn(c, F.lit(name)) if d is not None else None
    return Graph(own(g.nodes), own(g.edges), own(g.communities), own(g.endpoints, "service"))


def union(graphs: list[Graph]) -> Graph:
    out = graphs[0]
    for g in graphs[1:]:
        out = Graph(*[a.unionByName(b) for a, b in ((out.nodes, g.nodes), (out.edges, g.edges), (out.communities, g.communities), (out.endpoints, g.endpoints))])
    return out


def node_line(nodes: DataFrame, id: str) -> str | None:
    got = nodes.where(F.col("id") == id).select(X.format_node("id", "kind", "label", "file", "line")).head(1)
    return got[0][0] if got else None
