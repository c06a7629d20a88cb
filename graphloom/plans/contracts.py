"""Queries of the endpoint recognisers: small files of each framework made for every page, and the endpoints to be found.

``§`` in a text or an expected value stands for a name that each page has of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import contract
from graphloom.schema import NODES

from .tables import table

MARK = "§"
P, C, R, H, Q = "provides", "consumes", "rpc", "http", "queue"


def http(line: int, method: str, key: str, shown: str | None = None, side: str = P, source: str = "route", confidence: str = "INFERRED") -> tuple:
    return (line, side, H, f"{method} {key}", f"{method} {shown or key}", source, confidence)


def queue(line: int, topic: str, verb: str, side: str = P, source: str = "literal") -> tuple:
    return (line, side, Q, topic, f"{verb} {topic}", source, "INFERRED")


def rpc(line: int, key: str, side: str = P, source: str = "grpcgen", confidence: str = "INFERRED") -> tuple:
    return (line, side, R, key, key, source, confidence)


def client(line: int, key: str, shown: str | None = None, method: str = "GET") -> tuple:
    return http(line, method, key, shown, C, "client")


#: query: files with their texts, and the rows that each must give
CASES: dict[str, dict[str, tuple[str, list[tuple]]]] = {
    "q_file_roles": {
        "a.tsx": ('api.get("/a/§")', [client(1, "/a/§")]),
        "b.ts": ("import { ref } from 'vue'\napi.put('/b/§', x)", [client(2, "/b/§", method="PUT")]),
        "c.mjs": ("const app = createApp(Root)\napi.get('/c/§')", [client(2, "/c/§")]),
        "d.js": ("import express from 'express'\napp.get('/d/§', h)", [http(2, "GET", "/d/§")]),
        "e.go": ("// from 'react'\nr.GET(\"/e/§\", h)", [http(2, "GET", "/e/§")]),
    },
    "q_router_calls": {
        "a.go": ('r.GET("/r/§/:id", h)\nr.Group("/v1").POST("/q/§")\nx.get("rel")\nmux.route("/t/§")\nr.options("/w/§/{a}.json")', [http(1, "GET", "/r/§/{}", "/r/§/:id"), http(2, "POST", "/q/§"), http(4, "GET", "/t/§"), http(5, "OPTIONS", "/w/§/{}.json", "/w/§/{a}.json")]),
        "b.py": ('@router.get("/items/§/{item}")\naxios.get("/c/§"); app.get("/d/§")', [http(1, "GET", "/items/§/{}", "/items/§/{item}"), client(2, "/c/§")]),
    },
    "q_frontend_calls": {"a.vue": ('api.post("/p/§", body)\napi.get("nope")\nbus.emit("saved.§")\n@Get("x")', [client(1, "/p/§", method="POST"), queue(3, "saved.§", "publish", C)])},
    "q_handle_calls": {"a.go": ('http.HandleFunc("/h/§", f)\nmux.Handle("/i/§/", g)\nmux.Handle("none", g)', [http(1, "GET", "/h/§"), http(2, "GET", "/i/§", "/i/§/")])},
    "q_client_calls": {"a.py": ("fetch('/f/§')\nawait $fetch(\"/g/§\")\naxios.post(\"/k/§\", b)\naxios.request('/l/§')\nthis.http.get(\"/m/§\")\nhttpClient.delete('/n/§/7')\nuseFetch('/o/§?page=2')", [client(1, "/f/§"), client(2, "/g/§"), client(3, "/k/§"), client(4, "/l/§"), client(5, "/m/§"), client(6, "/n/§/{}", "/n/§/7"), client(7, "/o/§", "/o/§?page=2")])},
    "q_literal_urls": {"a.rs": ('let u = "http://svc:80/o/§/42?x=1";\nlet v = \'https://host\';\nlet w = "ftp://no/§"; let t = "http://a b/§";', [client(1, "/o/§/{}", "/o/§/42?x=1"), client(2, "/")])},
    "q_publish_calls": {"a.js": ('bus.publish("t.§")\nio.emit(\'e.§\', x)\nq.produce("/no/§")\npublish("free.§")', [queue(1, "t.§", "publish", C), queue(2, "e.§", "publish", C)])},
    "q_kafka_send": {"A.java": ('kafkaTemplate.send("k.§", x);\nthis.myProducer.send("l.§");\nmailer.send("m.§");', [queue(1, "k.§", "publish", C, "kafka"), queue(2, "l.§", "publish", C, "kafka")])},
    "q_subscribe_calls": {"a.go": ('nc.Subscribe("q.§", h)\nch.consume("c.§")\nnc.QueueSubscribe("u.§", "g", h)\nnc.Subscribe("/p/§")', [queue(1, "q.§", "subscribe"), queue(2, "c.§", "subscribe"), queue(3, "u.§", "subscribe")])},
    "q_kafka_listeners": {"A.java": ('@KafkaListener(topics = {"a.§", "b.§"})\n@KafkaListener(groupId = "g", destinations = "c.§")\n@KafkaListener(groupId = "g")', [queue(1, "a.§", "subscribe", P, "kafka"), queue(2, "c.§", "subscribe", P, "kafka")])},
    "q_spring_mappings": {"A.java": ('@GetMapping("/free/§")\n@RequestMapping("/api/§/")\nclass A {\n@PutMapping("x/{id}")\n@DeleteMapping("/")', [http(1, "GET", "/free/§"), http(4, "PUT", "/api/§/x/{}", "/api/§/x/{id}"), http(5, "DELETE", "/api/§")])},
    "q_spring_request_mapping": {"A.java": ('@RequestMapping(path = "/p/§")\n@RequestMapping(value = "/s", method = RequestMethod.POST)\n@RequestMapping(method = RequestMethod.GET)\n@RequestMapping(value = {"/t"}, method = {RequestMethod.PUT, RequestMethod.GET})', [http(2, "POST", "/p/§/s"), http(4, "PUT", "/p/§/t")])},
    "q_nest_routes": {"a.ts": ("@Controller('cats/§')\n@Get(':id')\n@Post()\n@All('any')\n@Controller()\n@Patch('§')", [http(2, "GET", "/cats/§/{}", "/cats/§/:id"), http(3, "POST", "/cats/§"), http(4, "GET", "/cats/§/any"), http(6, "PATCH", "/§")])},
    "q_nest_patterns": {"a.ts": ("@MessagePattern('cart.§')\n@EventPattern(\"made.§\")\n@MessagePattern()", [queue(1, "cart.§", "messagepattern", P, "route"), queue(2, "made.§", "eventpattern", P, "route")])},
    "q_django_routes": {
        "urls.py": ("path('users/§/<int:id>/', v.user),\nre_path(r'^orders/§/(?P<oid>\\d+)/$', v.order),\nurl(r'^$', v.home),\n", [http(1, "GET", "/users/§/{}", "/users/§/<int:id>"), http(2, "GET", "/orders/§/{}")]),
        "urls.rb": ("path('no/§')", []),
        "other.go": ('url("/no/§")', []),
    },
    "q_asp_routes": {"C.cs": ('[Route("api/§/[controller]")]\npublic class OrdersController : Base {\n[HttpGet("{id}")]\n[HttpPost]\n[HttpDelete("[action]/x")]\n}\napp.MapPut("/health/§", f);', [http(3, "GET", "/api/§/orders/{}", "/api/§/orders/{id}"), http(4, "POST", "/api/§/orders"), http(5, "DELETE", "/api/§/orders/x"), http(7, "PUT", "/health/§")])},
    "q_ktor_routes": {"r.kt": ('routing {\n  get("/carts/§/{id}") { }\n  route("/in/§") { }\n  post("relative") { }\n}', [http(2, "GET", "/carts/§/{}", "/carts/§/{id}"), http(3, "GET", "/in/§")])},
    "q_grpc_clients": {
        "a.go": ("client := pb.NewCart§Client(conn)\nresp, _ := client.GetCart(ctx, req)\nclient.Close()\nother.Get(x)", [rpc(2, "Cart§.GetCart", C, "grpc")]),
        "b.py": ("stub = x_pb2_grpc.OldStub(ch)\nstub = y.Pay§Stub(ch)\nr = stub.Charge(q)", [rpc(3, "Pay§.Charge", C, "grpc")]),
        "c.js": ("c = NewNo§Client(x)\nc.get(y)", []),
    },
    "q_grpc_chains": {"a.go": ("r, _ := pb.NewCart§Client(conn).GetCart(ctx, req)\npb.NewCart§Client(conn).Close()\nf(NewA§Client(c)).B(d)", [rpc(1, "Cart§.GetCart", C, "grpc")])},
    "q_grpc_go_servers": {"a.go": ("type Cart§Server interface {\n\tAdd(context.Context) error\n\thidden()\n\tUnimplementedX()\n}\n\tAfter()\npb.RegisterCart§Server(s, impl)", [rpc(2, "Cart§.Add")])},
    "q_grpc_py_servicers": {"a.py": ("class Pay§Servicer(object):\n    def Charge(self, r):\n        pass\n    def low(self):\n        pass\ndef Free(self):\n    pass\nadd_Pay§Servicer_to_server(S(), server)", [rpc(2, "Pay§.Charge")])},
    "q_grpc_registered": {
        "d.proto": ("service A§ {\n  rpc One (R) returns (E);\n}\nservice B§ {\n  rpc Two (R) returns (E) {}\n}\nservice D§ {\n  rpc Three (R) returns (E);\n}\nservice E§ {\n  rpc Four (R) returns (E);\n}\nservice F§ {\n  rpc Five (R) returns (E);\n}", [rpc(2, "A§.One", P, "proto", "EXTRACTED"), rpc(5, "B§.Two", P, "proto", "EXTRACTED"), rpc(8, "D§.Three", P, "proto", "EXTRACTED")]),
        "p.cs": ("app.MapGrpcService<A§>();\n// app.MapGrpcService<E§>();", []),
        "J.java": ("class Impl extends G.B§ImplBase {", []),
        "n.js": ("server.addService(pkg.D§.service, {})\nfunc RegisterF§Server(x)", []),
    },
    "q_grpc_shared_contract": {"d.proto": ("service A§ {\n  rpc One (R) returns (E);\n}\nservice B§ {\n  rpc Two (R) returns (E);\n}", []), "c.go": ("pb.NewA§Client(conn).One(ctx)", [rpc(1, "A§.One", C, "grpc")])},
    "q_proto_services": {"d.proto": ('syntax = "proto3";\nmessage M { int32 a = 1; }\nrpc Stray (A) returns (B);\nservice Only§ {\n  // rpc Note\n  rpc One (R) returns (E) {}\n\trpc Two(R) returns (E) {\n  }\n  rpc Late (R) returns (E);\n}', [rpc(6, "Only§.One", P, "proto", "EXTRACTED"), rpc(7, "Only§.Two", P, "proto", "EXTRACTED")])},
    "q_contract_files": {
        "contract.json": (
            '{"provides": [{"kind": "HTTP", "method": "post", "path": "/c/§/9"}, {"kind": "rpc", "name": "S§.M"}, {"kind": "queue", "topic": "t.§", "display": "shown §", "file": "x.go", "line": 7}, {"kind": "lib", "symbol": "L§"}, {"kind": "odd", "key": "k"}, {"kind": "queue"}], "consumes": [{"kind": "http", "path": "d/§"}, {"kind": "lib", "key": "own §", "symbol": "z"}]}',
            [
                (0, P, H, "POST /c/§/{}", "POST /c/§/{}", "contract", "EXTRACTED"),
                (0, P, R, "S§.M", "S§.M", "contract", "EXTRACTED"),
                (0, P, "lib", "L§", "L§", "contract", "EXTRACTED"),
                (0, C, H, "GET /d/§", "GET /d/§", "contract", "EXTRACTED"),
                (0, C, "lib", "own §", "own §", "contract", "EXTRACTED"),
            ],
        ),
        "x.go": ("", [(7, P, Q, "t.§", "shown §", "contract", "EXTRACTED")]),
        "y/contract.json": ("{broken", []),
    },
    "q_openapi_documents": {"openapi.json": ('{"openapi": "3.0", "paths": {"/z/§/{a}": {"get": {"x": 1}, "Post": {}, "x-note": {}, "parameters": []}, "/w/§": {"trace": {}}}}', [http(0, "GET", "/z/§/{}", "/z/§/{a}", P, "openapi", "EXTRACTED"), http(0, "POST", "/z/§/{}", "/z/§/{a}", P, "openapi", "EXTRACTED"), http(0, "TRACE", "/w/§", None, P, "openapi", "EXTRACTED")]), "d/swagger.json": ("no json", [])},
}
COLUMNS = ["service", "file", "line", "direction", "kind", "key", "display", "source", "confidence"]


def files(spark: SparkSession, sf_dir: str, case: dict) -> DataFrame:
    """``graph, file, text``: the files of a case for every page, each page a repository."""
    name = F.concat(F.lit("s"), F.col("page_id").cast("string"))
    made = F.array(*[F.struct(F.lit(f).alias("file"), F.replace(F.lit(text), F.lit(MARK), name).alias("text")) for f, (text, _) in case.items()])
    return table(spark, sf_dir, "pages").select(name.alias("graph"), F.explode(made).alias("f")).select("graph", "f.*")


def query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        none = spark.createDataFrame([], NODES)
        return contract.extract(files(spark, sf_dir, CASES[name]), none).select(COLUMNS)

    return run


def _text(x: object) -> str:
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)


def oracle(name: str) -> str:
    rows = [(f, *row) for f, (_, found) in CASES[name].items() for row in found]
    own = lambda c: f"replace({c}, '{MARK}', 's' || page_id)"
    return f"SELECT 's' || page_id AS service, file, CAST(line AS INT) AS line, direction, kind, {own('key')} AS key, {own('display')} AS display, source, confidence FROM pages CROSS JOIN (VALUES {values(rows)}) AS v(file, line, direction, kind, key, display, source, confidence)"


def q_endpoint_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints of routes on lines 2, 5 and 9 of a file with nodes on lines 3 and 5 (two there)."""
    text = "\n".join(f'r.GET("/{MARK}/{i}x", h)' if i in (2, 5, 9) else "" for i in range(1, 10))
    rows = files(spark, sf_dir, {"a.go": (text, []), "b.go": (text, [])})
    marks = [("a.go", "one", 3), ("a.go", "two", 5), ("a.go", "three", 5), ("c.go", "four", 1)]
    made = F.array(*[F.struct(F.lit(f).alias("file"), F.concat(F.lit(f"{i}:"), F.col("graph")).alias("id"), F.lit(i).alias("label"), F.lit("function").alias("kind"), F.lit(n).alias("line"), F.lit(-1).alias("community")) for f, i, n in marks])
    nodes = rows.select("graph").distinct().select("graph", F.explode(made).alias("n")).select("graph", "n.*")
    return contract.extract(rows, nodes).select("service", "file", "line", "node")


NODES_ORACLE = "SELECT 's' || page_id AS service, file, CAST(line AS INT) AS line, CASE WHEN mark = '' THEN '' ELSE mark || ':s' || page_id END AS node FROM pages CROSS JOIN (VALUES ('a.go', 2, ''), ('a.go', 5, 'two'), ('a.go', 9, 'two'), ('b.go', 2, ''), ('b.go', 5, ''), ('b.go', 9, '')) AS v(file, line, mark)"
QUERIES = {name: query(name) for name in CASES} | {"q_endpoint_nodes": q_endpoint_nodes}
ORACLES = {name: oracle(name) for name in CASES} | {"q_endpoint_nodes": NODES_ORACLE}
