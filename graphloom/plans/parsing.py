"""Queries of scanning and extraction: small sources made for every page, and what is to be found in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import assemble, extract, resolve
from graphloom.sources import scan

from .contracts import MARK, files, values

#: query: sources, then the nodes (id, label, kind, line) and edges (src, relation, dst, confidence) to be found
CASES: dict[str, tuple[dict[str, str], list[tuple], list[tuple]]] = {
    "q_extract_go": (
        {"a/m.go": 'package a\n\nimport (\n\t"fmt"\n\tx "net/http"\n)\n\ntype Box§ struct{ n int }\n\nfunc (b *Box§) Put(v int) {\n\tfmt.Println(v) // gone()\n\thelp§(v)\n}\n\nfunc help§(v int) { http.Get("u") }\n'},
        [("a-m-go:a-m-go", "a/m.go", "file", 1), ("module-fmt:fmt", "fmt", "module", 4), ("module-net-http:http", "http", "module", 5), ("a-m-go:box§", "Box§", "class", 8), ("a-m-go:box§-put", "Box§.Put", "method", 10), ("a-m-go:help§", "help§", "function", 15)],
        [("a-m-go:a-m-go", "imports", "module-fmt:fmt", "EXTRACTED"), ("a-m-go:a-m-go", "imports", "module-net-http:http", "EXTRACTED"), ("a-m-go:a-m-go", "contains", "a-m-go:box§", "EXTRACTED"), ("a-m-go:a-m-go", "contains", "a-m-go:box§-put", "EXTRACTED"), ("a-m-go:a-m-go", "contains", "a-m-go:help§", "EXTRACTED"), ("a-m-go:box§-put", "calls", "module-fmt:fmt", "EXTRACTED"), ("a-m-go:box§-put", "calls", "a-m-go:help§", "INFERRED"), ("a-m-go:help§", "calls", "module-net-http:http", "EXTRACTED")],
    ),
    "q_extract_python": (
        {"s.py": "import os\nfrom a.b import c\nclass Svc§:\n    def run(self):\n        help§(os.getcwd())\n\n    def rest(self):\n        def inner(): pass\n        return c()\n\ndef help§(x):\n    '''help§()'''\n    return x\nhelp§(1)\n"},
        [("s-py:s-py", "s.py", "file", 1), ("module-os:os", "os", "module", 1), ("module-a-b:b", "b", "module", 2), ("s-py:svc§", "Svc§", "class", 3), ("s-py:svc§-run", "Svc§.run", "method", 4), ("s-py:svc§-rest", "Svc§.rest", "method", 7), ("s-py:help§", "help§", "function", 11)],
        [("s-py:s-py", "imports", "module-os:os", "EXTRACTED"), ("s-py:s-py", "imports", "module-a-b:b", "EXTRACTED"), ("s-py:s-py", "contains", "s-py:svc§", "EXTRACTED"), ("s-py:s-py", "contains", "s-py:svc§-run", "EXTRACTED"), ("s-py:s-py", "contains", "s-py:svc§-rest", "EXTRACTED"), ("s-py:s-py", "contains", "s-py:help§", "EXTRACTED"), ("s-py:svc§-run", "calls", "s-py:help§", "INFERRED"), ("s-py:svc§-run", "calls", "module-os:os", "EXTRACTED")],
    ),
    "q_extract_javascript": (
        {"m.js": "import { x } from './lib/util§.js';\nclass Cart§ {\n  add(a) { return total§(a); }\n}\nfunction total§(a) { /* no() */ return a; }\n"},
        [("m-js:m-js", "m.js", "file", 1), ("module-lib-util§-js:util§", "util§", "module", 1), ("m-js:cart§", "Cart§", "class", 2), ("m-js:cart§-add", "Cart§.add", "method", 3), ("m-js:total§", "total§", "function", 5)],
        [("m-js:m-js", "imports", "module-lib-util§-js:util§", "EXTRACTED"), ("m-js:m-js", "contains", "m-js:cart§", "EXTRACTED"), ("m-js:m-js", "contains", "m-js:cart§-add", "EXTRACTED"), ("m-js:m-js", "contains", "m-js:total§", "EXTRACTED"), ("m-js:cart§-add", "calls", "m-js:total§", "INFERRED")],
    ),
    "q_extract_typescript": (
        {"m.tsx": "import React from 'react';\ninterface Shape§ { area(): number; }\nclass Sq§ {\n  side(): number { return read§(); }\n}\nfunction read§(): number { return 1; }\n"},
        [("m-tsx:m-tsx", "m.tsx", "file", 1), ("module-react:react", "react", "module", 1), ("m-tsx:shape§", "Shape§", "class", 2), ("m-tsx:sq§", "Sq§", "class", 3), ("m-tsx:sq§-side", "Sq§.side", "method", 4), ("m-tsx:read§", "read§", "function", 6)],
        [("m-tsx:m-tsx", "imports", "module-react:react", "EXTRACTED"), ("m-tsx:m-tsx", "contains", "m-tsx:shape§", "EXTRACTED"), ("m-tsx:m-tsx", "contains", "m-tsx:sq§", "EXTRACTED"), ("m-tsx:m-tsx", "contains", "m-tsx:sq§-side", "EXTRACTED"), ("m-tsx:m-tsx", "contains", "m-tsx:read§", "EXTRACTED"), ("m-tsx:sq§-side", "calls", "m-tsx:read§", "INFERRED")],
    ),
    "q_extract_rust": (
        {"m.rs": "use std::fmt;\nstruct Pt§ { x: i32 }\nimpl Pt§ {\n    fn show(&self) { draw§(self.x); }\n}\nfn draw§(x: i32) {}\n"},
        [("m-rs:m-rs", "m.rs", "file", 1), ("module-std-fmt:fmt", "fmt", "module", 1), ("m-rs:pt§", "Pt§", "class", 2), ("m-rs:pt§-show", "Pt§.show", "method", 4), ("m-rs:draw§", "draw§", "function", 6)],
        [("m-rs:m-rs", "imports", "module-std-fmt:fmt", "EXTRACTED"), ("m-rs:m-rs", "contains", "m-rs:pt§", "EXTRACTED"), ("m-rs:m-rs", "contains", "m-rs:pt§-show", "EXTRACTED"), ("m-rs:m-rs", "contains", "m-rs:draw§", "EXTRACTED"), ("m-rs:pt§-show", "calls", "m-rs:draw§", "INFERRED")],
    ),
    "q_extract_java": (
        {"M.java": "import java.util.List;\nclass Job§ {\n  void run() { this.step§(); }\n  int step§() { return 1; }\n}\n"},
        [("m-java:m-java", "M.java", "file", 1), ("module-java-util-list:list", "List", "module", 1), ("m-java:job§", "Job§", "class", 2), ("m-java:job§-run", "Job§.run", "method", 3), ("m-java:job§-step§", "Job§.step§", "method", 4)],
        [("m-java:m-java", "imports", "module-java-util-list:list", "EXTRACTED"), ("m-java:m-java", "contains", "m-java:job§", "EXTRACTED"), ("m-java:m-java", "contains", "m-java:job§-run", "EXTRACTED"), ("m-java:m-java", "contains", "m-java:job§-step§", "EXTRACTED")],
    ),
    "q_extract_php": (
        {"m.php": "<?php\nuse App\\Str§;\nclass Page§ {\n  public function show() { return make§(1); }\n}\nfunction make§($x) { return $x; }\n"},
        [("m-php:m-php", "m.php", "file", 1), ("module-app-str§:str§", "Str§", "module", 2), ("m-php:page§", "Page§", "class", 3), ("m-php:page§-show", "Page§.show", "method", 4), ("m-php:make§", "make§", "function", 6)],
        [("m-php:m-php", "imports", "module-app-str§:str§", "EXTRACTED"), ("m-php:m-php", "contains", "m-php:page§", "EXTRACTED"), ("m-php:m-php", "contains", "m-php:page§-show", "EXTRACTED"), ("m-php:m-php", "contains", "m-php:make§", "EXTRACTED"), ("m-php:page§-show", "calls", "m-php:make§", "INFERRED")],
    ),
    "q_extract_ambiguous": (
        {"a.py": "def run§():\n    same§()\n\ndef same§():\n    pass\n", "b.js": "function same§() {}\n", "R.md": "# same§()\n"},
        [("a-py:a-py", "a.py", "file", 1), ("a-py:run§", "run§", "function", 1), ("a-py:same§", "same§", "function", 4), ("b-js:b-js", "b.js", "file", 1), ("b-js:same§", "same§", "function", 1), ("r-md:r-md", "R.md", "doc", 1)],
        [("a-py:a-py", "contains", "a-py:run§", "EXTRACTED"), ("a-py:a-py", "contains", "a-py:same§", "EXTRACTED"), ("b-js:b-js", "contains", "b-js:same§", "EXTRACTED")],
    ),
}
IGNORE = "# note\nout/\n*.tmp.js\n!keep.tmp.js\n/top.py\nlogs/**/x.go\n"
#: path, length, whether it is a source, whether it may state endpoints
PATHS = [
    ("a/b.go", 5, "go", 1), ("README.MD", 5, "markdown", 0), ("x.PY", 5, "python", 1), ("m.mjs", 5, "javascript", 1), ("m.cjs", 5, "javascript", 1), ("v.vue", 5, "", 1), ("p.proto", 5, "", 1), ("c.cs", 5, "", 1), ("k.kt", 5, "", 1),
    ("t.tsx", 5, "typescript", 1), ("l.rs", 5, "rust", 1), ("J.java", 5, "java", 1), ("w.php", 5, "php", 1), ("noext", 5, "", 0), ("n.txt", 5, "", 0), ("contract.json", 5, "", 1), ("d/openapi.json", 5, "", 1), ("d/other.json", 5, "", 0),
    ("node_modules/z.js", 5, "", 0), ("q/vendor/z.go", 5, "", 0), (".git/z.py", 5, "", 0), ("dist/z.js", 5, "javascript", 0), ("q/target/z.rs", 5, "rust", 0), ("venv/z.py", 5, "python", 0), ("testdata/z.go", 5, "go", 0),
    ("out/z.go", 5, "", 1), ("q/out/z.go", 5, "", 1), ("s.tmp.js", 5, "", 1), ("q/keep.tmp.js", 5, "javascript", 1), ("top.py", 5, "", 1), ("q/top.py", 5, "python", 1), ("logs/a/b/x.go", 5, "", 1), ("big.go", 2000000, "go", 0),
]


def graph_of(spark: SparkSession, sf_dir: str, case: dict[str, str]):
    texts = files(spark, sf_dir, {k: (v, []) for k, v in case.items()})
    rows = texts.select("graph", F.col("file").alias("rel_path"), scan.language(F.col("file")).alias("lang"), F.col("text").cast("binary").alias("content"))
    nodes, edges, calls = extract.extract(rows)
    return assemble.assemble(nodes, edges.unionByName(resolve.resolve(nodes, calls)))


def query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g, none = graph_of(spark, sf_dir, CASES[name][0]), F.lit("")
        nodes = g.nodes.select("graph", "id", "label", "kind", "line", none.alias("dst"), none.alias("confidence"))
        return nodes.union(g.edges.select("graph", "src", F.lit(""), "relation", F.lit(0), "dst", "confidence"))

    return run


def oracle(name: str) -> str:
    _, nodes, edges = CASES[name]
    rows = [(*n, "", "") for n in nodes] + [(a, "", r, 0, b, c) for a, r, b, c in edges]
    own = ", ".join(f"replace({c}, '{MARK}', 's' || page_id) AS {c}" for c in ("id", "label", "dst"))
    return f"SELECT 's' || page_id AS graph, {own}, kind, CAST(line AS INT) AS line, confidence FROM pages CROSS JOIN (VALUES {values(rows)}) AS v(id, label, kind, line, dst, confidence)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths under a folder for every page."""
    from .tables import table

    made = F.array(*[F.struct(F.lit(p).alias("rel_path"), F.lit(n).cast("long").alias("length")) for p, n, _, _ in PATHS])
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.explode(made).alias("f")).select("page", "f.*")


def q_scan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.sources(_paths(spark, sf_dir), IGNORE).select("page", "rel_path", "lang")


def q_scan_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.statements(_paths(spark, sf_dir)).select("page", "rel_path")


QUERIES = {name: query(name) for name in CASES} | {"q_scan_sources": q_scan_sources, "q_scan_statements": q_scan_statements}
ORACLES = {name: oracle(name) for name in CASES} | {
    "q_scan_sources": f"SELECT page_id AS page, rel_path, lang FROM pages CROSS JOIN (VALUES {values([(p, lang) for p, _, lang, _ in PATHS if lang])}) AS v(rel_path, lang)",
    "q_scan_statements": f"SELECT page_id AS page, rel_path FROM pages CROSS JOIN (VALUES {values([(p,) for p, _, _, own in PATHS if own])}) AS v(rel_path)",
}
