"""Graph operators on small graphs, and every query against its SQL in DuckDB."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from graphloom.functions import expr as X
from graphloom.operators import analyze, assemble, cluster, contract, extract, paths, query, resolve, system, workspace
from graphloom.plans.registry import ORACLES, QUERIES
from graphloom.schema import EDGES, ENDPOINTS, NODES, Graph
from graphloom.sources import maps, registry, scan
from graphloom.streaming import incremental

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    assert ordered(got.collect(), got.columns) == ordered(want.fetchall(), want.columns)


def test_entry(spark):
    assert driver.entry(spark).count() == 7 and set(driver.oracle_sql()) <= set(driver.queries())


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_expressions(spark):
    lit = F.lit
    for text, want in (("foo__bar", "foo-bar"), ("!!!", ""), ("Auth/Session.ts", "auth-session-ts"), ("ΑΣ", "ασ"), ("İx", "ix")):
        assert one(spark, X.slug(lit(text))) == want
    for text, want in (("HTTPServer", ["httpserver"]), ("parseJSON2Map", ["parse", "json2", "map"]), ("", [])):
        assert one(spark, X.tokenize(lit(text))) == want
    for text, want in (("/orders/42", "/orders/{}"), ("users", "/users"), ("/a/:id/?q=1", "/a/{}"), ("/", "/"), ("/x/<int:y>/{z}/", "/x/{}/{}")):
        assert one(spark, X.norm_path(lit(text))) == want
    for text, want in (("java.util.List", "List"), ("./auth/session.js", "session"), ("std::fmt", "fmt"), ("App\\Str", "Str")):
        assert one(spark, X.last_segment(lit(text))) == want


def edges_of(spark, pairs, relation="calls"):
    return spark.createDataFrame([("g", a, b, relation, "EXTRACTED") for a, b in pairs], EDGES)


def nodes_of(spark, ids, community=-1):
    return spark.createDataFrame([("g", i, i, "function", f"src/{i}.go", 1, community) for i in ids], NODES)


def test_two_cliques(spark):
    pairs = [(a, b) for side in ("abcd", "efgh") for a in side for b in side if a < b] + [("d", "e")]
    n, e = nodes_of(spark, "abcdefgh"), edges_of(spark, pairs)
    got = {r["id"]: r["community"] for r in cluster.louvain(n, e).collect()}
    assert got == {x: int(x > "d") for x in "abcdefgh"}
    assert cluster.modularity(cluster.cluster(n, e), e).first()["q"] > 0
    assert {r["community"] for r in cluster.louvain(n, e.limit(0)).collect()} == set(range(8))


def test_moves_in_blocks(monkeypatch):
    """Nodes whose neighbourhood is as it was get no turn; the communities are those of turns for all."""
    import random

    rng = random.Random(3)
    for many, block in ((10**9, 1), (0.5, 4), (0.5, 1 << 16)):
        for _ in range(60):
            n = rng.randint(1, 40)
            pairs = {tuple(sorted(rng.sample(range(n), 2))): rng.randint(1, 3) for _ in range(rng.randint(0, 90) if n > 1 else 0)}
            near = [{b if a == i else a: w for (a, b), w in pairs.items() if i in (a, b)} for i in range(n)]
            deg, own, moving = [sum(x.values()) for x in near], list(range(n)), True
            while moving:
                moving = False
                for i in (i for i in range(n) if near[i]):
                    gain = {c: sum(w for j, w in near[i].items() if own[j] == c) - deg[i] * sum(deg[j] for j in range(n) if own[j] == c and j != i) / sum(deg) for c in {own[i], *(own[j] for j in near[i])}}
                    best = min(gain, key=lambda c: (-gain[c], c != own[i], c))
                    moving, own[i] = moving or best != own[i], best
            number = {}
            monkeypatch.setattr(cluster, "MANY", many)
            monkeypatch.setattr(cluster, "BLOCK", block)
            assert list(cluster.move_locally(list(map("{:02}".format, range(n))), [(f"{a:02}", f"{b:02}", w) for (a, b), w in pairs.items()]).values()) == [number.setdefault(c, len(number)) for c in own]


def test_runs_have_turns_at_once(monkeypatch):
    """A run of nodes that aren't joined, with ties and totals that depend on the turns before, ends as turn by turn does."""
    import numpy as np

    rng = np.random.default_rng(5)
    for k in range(120):
        n, half = int(rng.integers(4, 80)), k % 2
        ends = np.sort(rng.integers(0, n, (int(rng.integers(1, 200)), 2)), axis=1)
        ends = np.unique(ends // 2 + [0, n // 2] if half else ends[ends[:, 0] < ends[:, 1]], axis=0)  # two halves, or any
        a, b, w = *ends.astype(np.int32).T, rng.integers(1, 2 + k % 3, len(ends)).astype(np.int32)
        monkeypatch.setattr(cluster, "BLOCK", int(rng.choice([1, 16, 1 << 16])))
        monkeypatch.setattr(cluster, "RUN", 1 << 40)
        want = cluster.moved(n, a, b, w)
        monkeypatch.setattr(cluster, "RUN", int(rng.choice([1, 4])))
        assert (cluster.moved(n, a, b, w) == want).all()


def test_cycles_and_paths(spark):
    e = edges_of(spark, [("p", "q"), ("q", "p"), ("q", "r")], "imports")
    assert [r["members"] for r in analyze.import_cycles(e).collect()] == [["p", "q"]]
    n, e = nodes_of(spark, "abcd"), edges_of(spark, [("a", "b"), ("c", "b")])
    assert paths.shortest_path(n, e, "a", "c") == ["a", "b", "c"] and paths.shortest_path(n, e, "a", "d") is None
    with pytest.raises(KeyError):
        paths.shortest_path(n, e, "a", "z")


def test_cycles_are_not_spelt_out(spark):
    """Cycles that hold 400 million members together, in the order of their members."""
    import numpy as np

    n = 20_000
    a, b, low, size, _ = analyze.back_edges(n, np.r_[np.arange(n - 1), np.arange(1, n), np.arange(2, n)], np.r_[np.arange(1, n), np.zeros(n - 1, int), np.ones(n - 2, int)])
    assert len(size) == 2 * n - 3 and size.sum(dtype=np.int64) == n * n - 2
    assert list(zip(low[:2], a[:2], b[:2])) == [(0, 1, 0), (0, 2, 0)] and low[-1] == 1
    e = edges_of(spark, [(f"p{i}", f"p{j}") for i in range(12) for j in (i * 7 % 12, (i * 5 + 1) % 12, 0)], "imports")
    whole = analyze.import_cycles(e).orderBy("rank").collect()
    assert [" ".join(r["members"]) for r in whole] == sorted(" ".join(r["members"]) for r in whole)
    assert [(r["rank"], r["n"]) for r in analyze.cycle_sizes(e).orderBy("rank").collect()] == [(r["rank"], len(r["members"])) for r in whole]


def test_long_chain(spark):
    """Walks end where the graph does, not at a number of levels."""
    ids = [f"n{i:03}" for i in range(80)]
    n, e = nodes_of(spark, ids).coalesce(1), edges_of(spark, list(zip(ids, ids[1:]))).coalesce(1)
    assert paths.shortest_path(n, e, ids[0], ids[-1]) == ids
    assert paths.levels(e, ids[0]).agg(F.max("level")).first()[0] == 79


def test_discovery_order(spark):
    e = edges_of(spark, [("s", "b"), ("s", "a"), ("b", "x"), ("a", "y"), ("a", "x"), ("y", "z"), ("x", "z")])
    rows = {r["id"]: (r["level"], r["parent"]) for r in paths.bfs_levels(e, "s").collect()}
    assert rows == {"s": (0, None), "a": (1, "s"), "b": (1, "s"), "x": (2, "a"), "y": (2, "a"), "z": (3, "x")}
    seen = [r["id"] for r in paths.bfs_levels(e, "s").orderBy("level", "pos").collect()]
    assert seen == ["s", "a", "b", "x", "y", "z"]


def test_expansion_against_plain_walk(spark):
    """The budgeted expansion against a walk that holds all neighbours."""
    import random

    rng = random.Random(5)
    names = ["seed one"] + ["w" * rng.randint(1, 60) + str(i) for i in range(120)]
    n = spark.createDataFrame([("g", f"i{i}", x, "function", "f", 1, -1) for i, x in enumerate(names)], NODES)
    pairs = [(f"i{rng.choice((0, 0, 1, rng.randrange(121)))}", f"i{rng.randrange(121)}") for _ in range(400)]
    e = edges_of(spark, pairs)
    cost = {f"i{i}": max(len(f"i{i} [function] {x} @ f:1".encode()) // 4, 1) for i, x in enumerate(names)}
    for budget in (30, 90, 200):
        chosen, queue, used = ["i0"], ["i0"], cost["i0"]
        while queue and used < budget:
            q = queue.pop(0)
            for x in sorted(b for a, b in pairs if a == q) + sorted(a for a, b in pairs if b == q):
                if x not in chosen and used + cost[x] <= budget:
                    chosen.append(x)
                    queue.append(x)
                    used += cost[x]
        assert {r["id"] for r in query.query(n, e, "seed", budget)[0].collect()} == set(chosen)


def test_local_moving(spark):
    pairs = [(a, b) for side in ("abcd", "efgh") for a in side for b in side if a < b] + [("d", "e")]
    got = {r["id"]: r["community"] for r in cluster.local_moving(nodes_of(spark, "abcdefghz"), edges_of(spark, pairs)).collect()}
    assert len({got[x] for x in "abcd"}) == len({got[x] for x in "efgh"}) == 1 and len(set(got.values())) == 3


def test_local_moving_numbers(spark):
    """Both directions of an edge are one pair, an end without a node counts for the degree only, no id is in a round, and the
    modularity over numbers is that over ids."""
    rng = random.Random(5)
    pairs = [(rng.choice("abcdefgh"), rng.choice("abcdefgh")) for _ in range(40)] + [("a", "gone"), ("x", "y"), ("y", "x")]
    n, e = nodes_of(spark, "abcdefghxyz"), edges_of(spark, pairs)
    ids, found = cluster.numbered_pairs(n, e)
    name = {r["pos"]: r["id"] for r in ids.collect()} | {-1: "gone"}
    assert [name[i] for i in range(11)] == list("abcdefghxyz")
    want = {}
    for a, b in pairs:
        if a != b:
            key = frozenset((a, b))
            want[key] = want.get(key, 0) + 1
    assert {frozenset((name[r["a"]], name[r["b"]])): r["w"] for r in found.collect()} == want
    own = cluster.moved_by_halves(ids, found, 20)
    assert set(own.columns) == {"pos", "comm", "deg", "m2"} and {r["m2"] for r in own.collect()} == {2 * sum(want.values())}
    assert {name[r["pos"]]: r["deg"] for r in own.collect()} == {x: sum(w for k, w in want.items() if x in k) for x in "abcdefghxyz"}
    e = edges_of(spark, [(a, b) for a, b in pairs if b != "gone"])
    ids, found = cluster.numbered_pairs(n, e)
    own = cluster.moved_by_halves(ids, found, 20)
    by_id = n.drop("community").join(cluster.named(ids, own), ["graph", "id"])
    got = cluster.numbered_modularity(found, own.join(ids, "pos"), "comm").first()["comm"]
    assert got == pytest.approx(cluster.modularity(by_id, e).first()["q"])


def test_system_overlay_parts(spark, tmp_path, monkeypatch):
    """The overlay is the document that json.dumps makes, whatever part of a list the driver holds at a time."""
    row = lambda s, way, key, node: (s, way, "http", key, key, node, "f", 1, "client", "EXTRACTED")
    rows = [row(s, "provides", "GET /x", f"{s}1") for s in "ab"] + [row("c", "consumes", "GET /x", f"n{i:02}é\"") for i in range(30)] + [row("c", "consumes", "GET /gone", None), row("b", "provides", "GET /own", None), row("a", "consumes", "GET /own", None)]
    found = system.match(spark.createDataFrame(rows, "service string, direction string, kind string, key string, display string, node string, file string, line int, source string, confidence string"))
    monkeypatch.setattr(maps, "PART", 7)
    monkeypatch.setattr(registry.build, "now", lambda: "then")
    tables, own = registry.system_overlay(found, str(tmp_path)), tmp_path / registry.SYSTEM.folder / "overlay.json"
    text = own.read_text(encoding="utf-8")
    got = json.loads(text)
    assert text == json.dumps(got, indent=2, ensure_ascii=False) + "\n" and list(got) == ["version", "generated_at", "links", "ambiguous", "dangling", "orphans"]
    assert got["links"] == [{"from": "a::None", "to": "b::None", "from_service": "a", "to_service": "b", "kind": "http", "key": "GET /own", "confidence": "EXTRACTED", "via": "client->client"}]
    assert [(x["from"], x["to"]) for x in got["ambiguous"]] == [(f"c::n{i:02}é\"", f"{s}::{s}1") for i in range(30) for s in "ab"]
    assert got["dangling"] == [{"service": "c", "kind": "http", "key": "GET /gone", "display": "GET /gone"}] and got["orphans"] == []
    assert {k: d.count() for k, d in tables.items()} == {"links": 1, "ambiguous": 60, "dangling": 1, "orphans": 0}


def test_ambiguous_links_are_not_stored(spark, tmp_path, monkeypatch):
    """Ambiguous links are written from consumers and providers in parts; the list is the one that their rows give in order."""
    import gzip
    import random

    rng = random.Random(2)
    keys = ["GET /x", "GET /y", "POST /x", "/x", "stock"]
    rows = [(rng.choice("abc"), rng.choice(("provides", "consumes")), rng.choice(("http", "queue")), rng.choice(keys), None, rng.choice([None, 'n"1', "n2", "né"]), "f", k % 2, rng.choice(["client", None]), "EXTRACTED") for k in range(160)]
    found = system.match(spark.createDataFrame([*rows, *rows[:40]], "service string, direction string, kind string, key string, display string, node string, file string, line int, source string, confidence string"))
    monkeypatch.setattr(maps, "PACKED", 300)
    monkeypatch.setattr(maps, "MEMBER", 400)
    rows = registry.system_overlay(found, str(tmp_path), packed=True)["ambiguous"]
    text = gzip.decompress((tmp_path / registry.SYSTEM.folder / "overlay.json.gz").read_bytes()).decode()
    got = json.loads(text)
    assert text == json.dumps(got, indent=2, ensure_ascii=False) + "\n"
    assert len(got["ambiguous"]) > 600 and got["ambiguous"] == [r.asDict() for r in rows.orderBy(*registry.OVERLAY_ORDER["ambiguous"]).collect()]
    assert not hasattr(rows, "_walk")


def built(spark, tmp_path, texts):
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    nodes, edges, calls = extract.extract(scan.scan(spark, str(tmp_path), "g"))
    g = assemble.assemble(nodes, edges.unionByName(resolve.resolve(nodes, calls)))
    g = Graph(paths.cut(g.nodes), paths.cut(g.edges))
    kinds = {r["kind"]: r["count"] for r in g.nodes.groupBy("kind").count().collect()}
    relations = {(r["relation"], r["confidence"][0]): r["count"] for r in g.edges.groupBy("relation", "confidence").count().collect()}
    return kinds, relations, len({r["community"] for r in cluster.louvain(g.nodes, g.edges).collect()})


def test_two_packages(spark, tmp_path):
    got = built(spark, tmp_path, {
        "main.go": 'package main\n\nimport (\n\t"fmt"\n\t"demo/greet"\n)\n\nfunc main() {\n\tfmt.Println(greet.Hello("you"))\n}\n',
        "greet/greet.go": 'package greet\n\nimport "strings"\n\nfunc Hello(n string) string { return strings.ToUpper(pad(n)) }\n\nfunc pad(n string) string { return n }\n',
        "greet/box.go": 'package greet\n\ntype Box struct{}\n\nfunc (b *Box) Wrap() string { return Hello("x") }\n',
    })
    assert got == ({"file": 3, "function": 3, "module": 3, "class": 1, "method": 1}, {("contains", "E"): 5, ("imports", "E"): 3, ("calls", "E"): 3, ("calls", "I"): 2}, 3)


def test_six_languages(spark, tmp_path):
    got = built(spark, tmp_path, {
        "svc.py": "import os\nimport api\n\nclass PySvc:\n    def run(self):\n        helper(os.getcwd())\n\ndef helper(x):\n    return x\n",
        "svc.js": "import x from './util.js';\nclass JsSvc {\n  run() { return helper(); }\n}\nfunction helper() { return 1; }\n",
        "svc.ts": "import { a } from './api';\ninterface Shape { area(): number; }\nclass TsSvc {\n  run(): number { return only(); }\n}\nfunction only(): number { return 1; }\n",
        "svc.rs": "use std::fmt;\nstruct RsSvc;\nimpl RsSvc {\n    fn run(&self) { render(); }\n}\nfn render() {}\n",
        "Svc.java": "import java.util.List;\nclass JavaSvc {\n  void run() { step(); }\n  void step() {}\n}\n",
        "svc.php": "<?php\nuse App\\Str;\nclass PhpSvc {\n  public function run() { return render(); }\n}\nfunction render() { return 1; }\n",
    })
    assert got == ({"class": 7, "method": 7, "file": 6, "module": 6, "function": 5}, {("contains", "E"): 19, ("imports", "E"): 7, ("calls", "E"): 1, ("calls", "I"): 1}, 7)


def test_island_rows(spark):
    """The island by rows, places counted within each graph over many partitions."""
    ids = [f"n{i:03}" for i in range(300)]
    n = nodes_of(spark, ids).unionByName(nodes_of(spark, ids[::2]).withColumn("graph", F.lit("h"))).repartition(7)
    e = edges_of(spark, [(a, b) for a, b in zip(ids, ids[1:])] + [("n000", "n000"), ("n001", "gone")])
    rows, pairs = maps.island_rows(n, e)
    got = sorted((r["graph"], r["pos"], r["label"], r["deg"]) for r in rows.collect())
    assert got == [("g", i, x, 2 - (i in (0, 299))) for i, x in enumerate(ids)] + [("h", i, x, 0) for i, x in enumerate(ids[::2])]
    assert sorted((r["src_pos"], r["dst_pos"]) for r in pairs.collect()) == [(i, i + 1) for i in range(299)]
    assert {r["graph"]: r["label"] for r in maps.island(n, e).collect()} == {"g": ids, "h": ids[::2]}


def test_map_in_pieces(spark, tmp_path):
    """A map's text as the library writes it, packed or not; read item by item, odd strings and empty lists included."""
    import gzip
    import json

    odd = ['a"b', "c\n    },\n    {", "\u2028é", '  "nodes": [', "z"]
    n, e = nodes_of(spark, odd).repartition(3), edges_of(spark, list(zip(odd, odd[1:])))
    ends = spark.createDataFrame([("s", d, "http", k, k, k, "f", 1, "INFERRED", "x") for d in ("provides", "consumes") for k in odd[:3]], ENDPOINTS)
    c = spark.createDataFrame([("g", 0, "one", odd), ("g", 1, "two", [])], "graph string, id int, label string, members array<string>")
    for g in (Graph(n, e, c, ends), Graph(n, e.limit(0), None, None), Graph(n.limit(0), e.limit(0), c, ends)):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        plain, packed = str(folder / "map.json"), str(folder / "map.json.gz")
        assert maps.write_map(g, plain, "t", "r") == maps.write_map(g, packed, "t", "r")
        text = open(plain, encoding="utf-8", newline="").read()
        assert text == gzip.open(packed, "rt", encoding="utf-8", newline="").read() == json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n"
        whole = maps.load(spark, plain)
        for got in (maps.load_laid_out(spark, plain), maps.load_laid_out(spark, packed)):
            for k in ("nodes", "edges", "communities", "endpoints"):
                assert sorted(map(str, getattr(got, k).collect())) == sorted(map(str, getattr(whole, k).collect()))


def test_budget(spark):
    n = nodes_of(spark, ["auth", "login", "token"])
    e = edges_of(spark, [("auth", "login")])
    found, among = query.query(n, e, "auth", 2000)
    assert query.render_text(found, among).startswith("NODES\nauth [function] auth @ src/auth.go:1\nlogin")
    assert query.query(n, e, "", 2000)[0].count() == 0
    assert query.query(n, e, "auth", 9)[0].count() == 1 and query.query(n, e, "auth", 8)[0].count() == 0


def test_extract_and_resolve(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\nclass S:\n    def run(self):\n        helper(os.getcwd())\n\ndef helper(x):\n    return x\n")
    (tmp_path / "b.go").write_text('package b\nimport "fmt"\nfunc main() { fmt.Println(1) }\n')
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "c.py").write_text("def no(): pass\n")
    (tmp_path / ".gitignore").write_text("skip/\n")
    files = scan.scan(spark, str(tmp_path), "g")
    assert sorted(r["rel_path"] for r in files.collect()) == ["a.py", "b.go"]
    n, e, calls = extract.extract(files)
    g = assemble.assemble(n, e.unionByName(resolve.resolve(n, calls)))
    ids = {r["id"] for r in g.nodes.collect()}
    assert {"a-py:s-run", "a-py:helper", "b-go:main", "module-os:os", "module-fmt:fmt"} <= ids
    links = {(r["src"], r["dst"], r["confidence"]) for r in g.edges.where("relation = 'calls'").collect()}
    assert links == {("a-py:s-run", "a-py:helper", "INFERRED"), ("a-py:s-run", "module-os:os", "EXTRACTED"), ("b-go:main", "module-fmt:fmt", "EXTRACTED")}
    assert assemble.validate(g).count() == 0
    known = spark.createDataFrame(incremental.hashes(files).collect())  # as stored; a plan would read the files anew
    (tmp_path / "b.go").write_text("package b\nfunc other() {}\n")
    assert [r["rel_path"] for r in incremental.changed(scan.scan(spark, str(tmp_path), "g"), known).collect()] == ["b.go"]
    maps.write_map(g, str(tmp_path / "map.json"), "2024-01-01T00:00:00Z", ".")
    assert maps.load(spark, str(tmp_path / "map.json")).nodes.count() == g.nodes.count()


def test_contract(spark):
    text = {
        "A.java": '@RequestMapping("/api")\nclass A {\n@GetMapping("/x/{id}")\n@RequestMapping(value="/y", method=RequestMethod.POST)\n@KafkaListener(topics = "t1")\n',
        "n.ts": "@Controller('cats')\n@Get(':id')\n@EventPattern('made')\n",
        "page.tsx": 'axios.post("/api/x/1")\napi.get("/y")\n',
        "u.py": 'path("users/<int:id>/", v)\nstub = pb.CartStub(ch)\nstub.Add(1)\nclass CartServicer(object):\n    def Add(self, r): pass\n',
        "C.cs": '[Route("api/[controller]")]\nclass OrdersController {\n[HttpGet("{id}")]\n',
        "k.kt": 'get("/k") {}\n',
        "p.proto": "service Cart {\n  rpc Add (A) returns (B);\n}\n",
        "openapi.json": '{"paths": {"/z/{a}": {"get": {}, "x-note": {}}}}',
        "contract.json": '{"provides": [{"kind": "queue", "topic": "own"}], "consumes": []}',
    }
    files = spark.createDataFrame([("s", k, v) for k, v in text.items()], "graph string, file string, text string")
    none = nodes_of(spark, [""]).limit(0)
    got = {(r["direction"], r["key"], r["source"]) for r in contract.extract(files, none).collect()}
    want = {("provides", k, "route") for k in ("GET /api/x/{}", "POST /api/y", "GET /cats/{}", "made", "GET /users/{}", "GET /api/orders/{}", "GET /k")}
    want |= {("provides", "t1", "kafka"), ("consumes", "GET /api/x/{}", "client"), ("consumes", "POST /api/x/{}", "client"), ("consumes", "GET /y", "client"), ("consumes", "Cart.Add", "grpc"), ("provides", "Cart.Add", "grpcgen"), ("provides", "Cart.Add", "proto"), ("provides", "GET /z/{}", "openapi"), ("provides", "own", "contract")}
    assert got == want


def test_match(spark):
    row = lambda s, d, kind, key: (s, d, kind, key, key, "", "f", 1, "INFERRED", "x")
    ends = spark.createDataFrame([row("a", "provides", "http", "POST /o"), row("b", "consumes", "http", "GET /o"), row("b", "consumes", "queue", "t"), row("c", "provides", "rpc", "S.M"), row("d", "provides", "rpc", "S.M"), row("b", "consumes", "rpc", "S.M"), row("c", "provides", "queue", "u")], ENDPOINTS)
    m = system.match(ends)
    assert system.counts(m) == {"links": 1, "ambiguous": 2, "dangling": 1, "orphans": 1}
    link = m["links"].first()
    assert (link["key"], link["confidence"], link["via"]) == ("POST /o", "INFERRED", "x->x+path-only")
    assert [r["service"] for r in paths.impact(m["links"], "a")[1].collect()] == ["b"]
