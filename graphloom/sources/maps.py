"""Stored graphs: read many map files at once, write one; text and island forms; registries."""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import expr as X
from graphloom.operators.paths import cut, drop, numbered, shared_folder
from graphloom.schema import DOCUMENT, Graph

PART = 100_000  # rows of a map that come to the driver at once
PACKED, HELD, MEMBER = 3_000_000, 1 << 19, 12 << 20  # pairs of a part that is packed, texts of pairs that its task keeps, bytes that come to the driver at once


def load(spark: SparkSession, path: str) -> Graph:
    """Map files (a glob reads many services); the graph's name is the folder that holds the file."""
    raw = spark.read.schema(DOCUMENT).json(path, multiLine=True).withColumn("graph", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1))
    nodes = raw.select("graph", F.explode("nodes").alias("x")).select("graph", "x.*")
    edges = raw.select("graph", F.explode("edges").alias("x")).select("graph", F.col("x.from").alias("src"), F.col("x.to").alias("dst"), "x.relation", "x.confidence")
    comm = raw.select("graph", F.explode("communities").alias("x")).select("graph", "x.*")
    sides = [raw.select("graph", F.explode(s).alias("x")).select(F.col("graph").alias("service"), F.lit(s).alias("direction"), "x.*") for s in ("provides", "consumes")]
    return Graph(nodes, edges, comm, sides[0].union(sides[1]))


def items(rows: DataFrame | None, *order: str) -> Iterator[str]:
    """The rows in order as JSON objects, some to a text; executors make the texts, one part of the order at a time comes here."""
    if rows is None:
        return

    quoted = json.encoder.encode_basestring

    def item(x: dict) -> str:
        if any(isinstance(v, (list, dict)) for v in x.values()):
            return json.dumps(x, indent=2, ensure_ascii=False).replace("\n", "\n    ")
        return "{\n" + ",\n".join([f"      {quoted(k)}: {quoted(v) if isinstance(v, str) else json.dumps(v)}" for k, v in x.items()]) + "\n    }"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            items = [item(x) for x in batch.to_pylist()]
            if items:
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32()), "text": [",\n    ".join(items)]})

    rows = rows.repartitionByRange(rows.count() // PART + 1, *order).sortWithinPartitions(*order)
    texts = cut(rows.mapInArrow(run, "n int, text string"))
    for file in sorted(texts.inputFiles()):  # a part of the order each, named by its number
        for r in texts.sparkSession.read.schema(texts.schema).parquet(file).orderBy("n").collect():
            yield r["text"]
    drop(texts)


def crossed(asks: DataFrame, offers: DataFrame) -> Iterator[bytes]:
    """The ambiguous links between ``asks`` (``service, kind, at, path_only, node, source, n``) and ``offers`` as JSON objects in
    total order, some to a packed text. Pairs are not made as rows: asks are sorted and dealt to parts, each part gets
    the offers of its keys, and puts their texts together."""
    quoted = lambda x: "null" if x is None else json.encoder.encode_basestring(x)
    full = lambda service, node: F.concat_ws("::", F.coalesce(service, F.lit("None")), F.coalesce(node, F.lit("None")))
    on = ("kind", "at", "path_only")
    who = asks.groupBy("service", full("service", "node").alias("from"), *on, "source").agg(F.count("*").cast("int").alias("copies"), F.sum("n").alias("n"))
    who = who.groupBy("service", "from").agg(F.collect_list(F.struct(*on, "source", "copies")).alias("asks"), F.sum("n").alias("n"))
    who = numbered(who.withColumn("graph", F.lit("")), "service", "from").drop("graph")
    froms, n = who.agg(F.count("*"), F.sum("n")).first()
    if not froms:
        drop(who)
        return
    parts = min(froms, n // PACKED + 1)
    own, who = who, cut(who.select("service", "from", "asks", "pos", (F.col("pos").cast("long") * parts / froms).cast("int").alias("part")))
    drop(own)
    keys = who.select(F.col("part").alias("to_part"), F.explode("asks").alias("x")).select("to_part", *[f"x.{k}" for k in on]).distinct()
    what = offers.select(*on, F.col("p_service").alias("service"), full("p_service", "p_node").alias("to"), F.col("p_key").alias("key"), F.col("p_source").alias("source"))
    what = keys.join(what.where("service is not null"), list(on))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lists: dict[tuple, list[tuple]] = {}
        for x in right.to_pylist():
            lists.setdefault(tuple(x[k] for k in on), []).append((x["service"], x["to"], x["kind"], x["key"], x["source"]))
        last, texts, held, out = None, {}, 0, []

        def around(service: str, asked: tuple) -> list[bytes]:
            """What stands between the places of ``from`` in the objects."""
            found = []
            for *key, source, copies in asked:
                for to_service, to, kind, k, p_source in lists[tuple(key)]:
                    if to_service != service:
                        via = None if source is None or p_source is None else f"{source}->{p_source}"
                        x = [to_service, to, kind, k]
                        order = [*(v.encode() for v in x), via is not None, (via or "").encode()]
                        found += [(order, (to, service, to_service, kind, k, via))] * copies
            found.sort(key=lambda x: x[0])
            names = ("to", "from_service", "to_service", "kind", "key", "confidence", "via")
            ends = [",\n" + ",\n".join(f'      "{k}": {quoted(v)}' for k, v in zip(names, (*x[:5], "AMBIGUOUS", x[5]))) + "\n    }" for _, x in found]
            head = '{\n      "from": '
            return [x.encode() for x in (head, *[f"{e},\n    {head}" for e in ends[:-1]], ends[-1])]

        pack, size = zlib.compressobj(1, zlib.DEFLATED, 31, 9), 0
        packed: list[bytes] = []
        for x in left.sort_by("pos").to_pylist():
            asked = tuple(sorted((tuple(a.values()) for a in x["asks"]), key=repr))
            if x["service"] != last or held > HELD:
                last, texts, held = x["service"], {}, 0
            if asked not in texts:
                texts[asked] = around(x["service"], asked)
                held += len(texts[asked])
            for data in (b",\n    " if size else b"", quoted(x["from"]).encode().join(texts[asked])):
                packed.append(pack.compress(data))
                size += len(packed[-1]) + 1
            if size > MEMBER:
                out.append(b"".join([*packed, pack.flush()]))
                pack, size, packed = zlib.compressobj(1, zlib.DEFLATED, 31, 9), 0, []
        if size:
            out.append(b"".join([*packed, pack.flush()]))
        return pa.table({"part": pa.array([left["part"][0].as_py()] * len(out), pa.int32()), "n": pa.array(range(len(out)), pa.int32()), "pack": pa.array(out, pa.binary())})

    texts = who.groupBy("part").cogroup(what.groupBy("to_part")).applyInArrow(run, "part int, n int, pack binary")
    path = f"{shared_folder(texts.sparkSession)}/walk-{uuid.uuid4().hex}"
    texts.write.partitionBy("part", "n").option("compression", "none").parquet(path)
    drop(who)
    local = path.removeprefix("file://")
    if local.startswith("/"):  # the driver reads it, with no detour over its JVM
        at = {tuple(int(k.split("=")[1]) for k in x.parts[-3:-1]): x for x in Path(local).glob("part=*/n=*/*.parquet")}
        for _, file in sorted(at.items()):
            yield pq.read_table(file, columns=["pack"], partitioning=None)["pack"][0].as_py()
            file.unlink()
    else:
        spark = texts.sparkSession
        for part, n in sorted(tuple(r) for r in spark.read.parquet(path).select("part", "n").distinct().collect()):
            one = spark.read.schema("pack binary").parquet(f"{path}/part={part}/n={n}")
            one._walk = f"{path}/part={part}/n={n}"
            yield bytes(one.first()["pack"])
            drop(one)
    texts._walk = path
    drop(texts)


def document(parts: dict[str, str | Iterator[str | bytes]]) -> Iterator[str | bytes]:
    """A JSON document of texts and of lists from :func:`items` or :func:`crossed`, in the layout of ``json.dumps(..., indent=2)``, piece by piece."""
    head = "{"
    for key, value in parts.items():
        yield f'{head}\n  "{key}": '
        head = ","
        if isinstance(value, str):
            yield json.dumps(value, ensure_ascii=False)
            continue
        n = 0
        for n, text in enumerate(value, 1):
            yield "[\n    " if n == 1 else ",\n    "
            yield text
        yield "\n  ]" if n else "[]"
    yield "\n}\n"


def _document(graph: Graph, generated_at: str, root: str) -> Iterator[str]:
    """One graph as its JSON document, in total order, piece by piece."""
    side = lambda s: graph.endpoints.where(F.col("direction") == s).drop("service", "direction") if graph.endpoints is not None else None
    edges = graph.edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "relation", "confidence")
    ends = ("kind", "key", "file", "line", "source")
    return document({"communities": items(graph.communities.drop("graph") if graph.communities is not None else None, "id"), "consumes": items(side("consumes"), *ends), "edges": items(edges, "from", "to", "relation", "confidence"), "generated_at": generated_at, "nodes": items(graph.nodes.drop("graph"), "id"), "provides": items(side("provides"), *ends), "root": root, "version": "1"})


def write_pieces(pieces: Iterator[str | bytes], path: str) -> str:
    """Writes texts one after the other, packed if the path ends with ``.gz``; returns their short hash. Bytes are texts that
    are packed already; they stay so in a packed file, and are hashed as they are."""
    import hashlib

    digest, packed = hashlib.sha256(), path.endswith(".gz")
    with open(path, "wb") as f:
        to = gzip.GzipFile("", "wb", 1, f) if packed else f
        for text in pieces:
            digest.update(data := text if isinstance(text, bytes) else text.encode())
            if isinstance(text, bytes) and packed:  # a member of the file of its own
                to.close()
                f.write(data)
                to = gzip.GzipFile("", "wb", 1, f)
            else:
                to.write(gzip.decompress(data) if isinstance(text, bytes) else data)
        if packed:
            to.close()
    return digest.hexdigest()[:12]


def write_map(graph: Graph, path: str, generated_at: str, root: str) -> str:
    """Writes the JSON document, packed if the path ends with ``.gz``; returns its short hash. A sink: the driver writes what
    it gets, and holds one partition of it at a time."""
    return write_pieces(_document(graph, generated_at, root), path)


def load_laid_out(spark: SparkSession, path: str) -> Graph:
    """Map files of any size in the layout of :func:`write_map`, read item by item: no row holds a document. A packed
    file is one task's. :func:`load` reads any layout, a document at once."""
    item = r"(?s)\n    \{(\n      .*)$"
    raw = spark.read.option("lineSep", "\n    }").text(path)  # a text has an item at most, at its end; strings hold no newline
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    raw = raw.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.regexp_extract("value", r'\n  "(\w+)": \[\n    \{\n', 1).alias("head"), F.regexp_extract("value", item, 1).alias("item"))
    raw = cut(raw.where("item <> ''"))
    heads = raw.where("head <> ''").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "head"))).alias("heads"))
    own = raw.drop("head").join(F.broadcast(heads), "file").withColumn("what", F.expr("element_at(filter(heads, h -> h.at <= at), -1).head"))
    own = own.select(F.regexp_extract("file", "([^/]+)/[^/]+$", 1).alias("graph"), "what", F.concat(F.lit("{"), "item", F.lit("}")).alias("item"))
    kinds = {f.name: f.dataType.elementType for f in spark.createDataFrame([], DOCUMENT).schema if hasattr(f.dataType, "elementType")}
    read = lambda k: own.where(F.col("what") == k).select("graph", F.from_json("item", kinds[k], {"mode": "FAILFAST"}).alias("x"))
    sides = [read(s).select(F.col("graph").alias("service"), F.lit(s).alias("direction"), "x.*") for s in ("provides", "consumes")]
    edges = read("edges").select("graph", F.col("x.from").alias("src"), F.col("x.to").alias("dst"), "x.relation", "x.confidence")
    return Graph(read("nodes").select("graph", "x.*"), edges, read("communities").select("graph", "x.*"), sides[0].union(sides[1]))


def write_tables(graph: Graph, path: str) -> None:
    """The form for large data: Parquet tables partitioned by graph."""
    for name in ("nodes", "edges", "communities"):
        if (d := getattr(graph, name)) is not None:
            d.write.mode("overwrite").partitionBy("graph").parquet(f"{path}/{name}")
    if graph.endpoints is not None:
        graph.endpoints.write.mode("overwrite").partitionBy("service").parquet(f"{path}/endpoints")


def island_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The island as rows: ``graph, pos, label, kind, file, line, deg, cat`` of each node by its place, and
    ``graph, src_pos, dst_pos`` of each edge; no self-loops, no dangling ends."""
    at = numbered(nodes, "id")
    side = lambda k: at.select("graph", F.col("id").alias(k), F.col("pos").alias(f"{k}_pos"))
    pairs, own = edges.where("src <> dst").select("graph", "src", "dst"), None
    for end in ("src", "dst"):  # one shuffle of ids at a time
        pairs = cut(pairs.join(side(end), ["graph", end]).drop(end))
        drop(own)
        own = pairs
    deg = pairs.select("graph", F.explode(F.array("src_pos", "dst_pos")).alias("pos")).groupBy("graph", "pos").agg(F.count("*").alias("deg"))
    rows = at.join(deg, ["graph", "pos"], "left")
    return rows.select("graph", "pos", "label", "kind", "file", "line", F.coalesce("deg", F.lit(0)).alias("deg"), X.category("kind", "label", "file").alias("cat")), pairs.select("graph", "src_pos", "dst_pos")


def island(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Columnar form of each graph: arrays by node position, edges as pairs of positions. One row holds a graph, for a page
    that shows it; :func:`island_rows` has graphs of any size."""
    rows, pairs = island_rows(nodes, edges)
    names = ("label", "kind", "file", "line", "deg", "cat")
    cols = rows.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("pos", *names))).alias("x"))
    links = pairs.groupBy("graph").agg(F.sort_array(F.collect_list(F.array("src_pos", "dst_pos"))).alias("edges"))
    return cols.join(links, "graph", "left").select("graph", *[F.col("x")[c].alias(c) for c in names], F.coalesce("edges", F.array().cast("array<array<int>>")).alias("edges"))


def by_directory(nodes: DataFrame) -> DataFrame:
    """``graph, dir, n, ids``: the plain-text mirror of a drawing."""
    return nodes.groupBy("graph", X.dir_of("file").alias("dir")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Rows numbered from 1 in an order, for sinks that write one document."""
    return rows.withColumn("n", F.row_number().over(Window.orderBy(*order)))


def path_tree(nodes: DataFrame) -> DataFrame:
    """``graph, prefix, n``: the nodes under every prefix of a path."""
    parts = F.split("file", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return nodes.select("graph", F.explode(prefixes).alias("prefix")).groupBy("graph", "prefix").agg(F.count("*").alias("n"))


def map_markdown(title: str, stats: dict[str, int], questions: list[str], hubs: list[tuple[str, int]], districts: list[tuple[str, int]], surprising: list[str]) -> str:
    """A page about a graph from small results: counts, questions, hubs, districts, edges between them."""
    part = lambda head, rows: [f"## {head}", "", *(f"- {x}" for x in rows or ["none"]), ""]
    out = [f"# {title}", "", ", ".join(f"{v} {k}" for k, v in stats.items()), "", *part("Start here", questions)]
    out += part("Landmarks", [f"{a} (degree {n})" for a, n in hubs]) + part("Districts", [f"{a} ({n})" for a, n in districts]) + part("Surprising links", surprising)
    return "\n".join([*out, "Confidence: EXTRACTED is read from the source, INFERRED is resolved, AMBIGUOUS has several targets."]) + "\n"
