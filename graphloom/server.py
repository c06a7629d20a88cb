"""Four tools over a graph as JSON-RPC, one message a line (MCP over standard input and output)."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any, TextIO

from pyspark.sql import functions as F

from graphloom.build import node_line
from graphloom.functions import expr as X
from graphloom.operators import paths, query
from graphloom.schema import Graph

# Protocol versions (the first is the preferred one), error codes, tools and their arguments.
VERSIONS = ["2025-06-18", "2025-03-26", "2024-11-05"]
PARSE_ERROR, NO_METHOD = -32700, -32601
TOOLS = {
    "query_graph": ("Part of the code graph that answers a question, as text.", {"question": "string", "budget": "integer"}, ["question"]),
    "get_node": ("One node by its id.", {"id": "string"}, ["id"]),
    "get_neighbors": ("A node with the edges into it and out of it.", {"id": "string"}, ["id"]),
    "shortest_path": ("Ids on a shortest path between two nodes, whatever the edges' direction.", {"from": "string", "to": "string"}, ["from", "to"]),
}


class ToolError(Exception):
    """A tool's failure: part of a result, not a protocol error."""


class Server:
    def __init__(self, graph: Graph, name: str = "graphloom", version: str = "1"):
        self.graph, self.info = graph, {"name": name, "version": version}

    def line(self, id: str) -> str:
        if (got := node_line(self.graph.nodes, id)) is None:
            raise ToolError(f"node not found: {id}")
        return got

    def query_graph(self, question: str = "", budget: int = 0) -> str:
        if not isinstance(question, str) or not isinstance(budget, int):
            raise ToolError("invalid arguments for query_graph")
        return query.render_text(*query.query(self.graph.nodes, self.graph.edges, question, budget))

    def get_node(self, id: str = "") -> str:
        return self.line(id)

    def get_neighbors(self, id: str = "") -> str:
        text = X.format_edge("src", "dst", "relation", "confidence")
        out = [self.line(id), "EDGES"]
        for end, other in (("dst", "src"), ("src", "dst")):
            near = self.graph.edges.where(F.col(end) == id).orderBy("relation", other, "confidence")
            out += [r[0] for r in near.select(text).collect()]
        return "".join(f"{x}\n" for x in out)

    def shortest_path(self, **ends: str) -> str:
        a, b = ends.get("from", ""), ends.get("to", "")
        try:
            found = paths.shortest_path(self.graph.nodes, self.graph.edges, a, b)
        except KeyError:
            found = None
        if found is None:
            raise ToolError(f"no path from {a} to {b}")
        return "".join(f"{x}\n" for x in found)

    def call(self, params: Any) -> dict:
        try:
            if not isinstance(params, dict):
                raise ToolError("invalid params")
            name, given = params.get("name"), params.get("arguments") or {}
            if name not in TOOLS:
                raise ToolError(f"unknown tool: {name}")
            if not isinstance(given, dict):
                raise ToolError(f"invalid arguments for {name}")
            text = getattr(self, name)(**{k: v for k, v in given.items() if k in TOOLS[name][1]})
            return {"content": [{"type": "text", "text": text}]}
        except ToolError as e:
            return {"content": [{"type": "text", "text": str(e)}], "isError": True}

    def answer(self, request: dict) -> dict:
        method, params = request.get("method"), request.get("params")
        out = {"jsonrpc": "2.0", "id": request.get("id")}
        if method == "initialize":
            asked = params.get("protocolVersion") if isinstance(params, dict) else None
            return out | {"result": {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}}, "serverInfo": self.info}}
        if method == "tools/list":
            schema = lambda args, need: {"type": "object", "properties": {k: {"type": t} for k, t in args.items()}, "required": need}
            return out | {"result": {"tools": [{"name": k, "description": d, "inputSchema": schema(a, n)} for k, (d, a, n) in TOOLS.items()]}}
        if method == "tools/call":
            return out | {"result": self.call(params)}
        return out | {"error": {"code": NO_METHOD, "message": f"method not found: {method}"}}

    def serve(self, lines: Iterable[str], out: TextIO) -> None:
        """Answers each line; blank lines are skipped, notifications (no id) get no reply."""
        for line in lines:
            if not line.strip():
                continue
            try:
                request = json.loads(line)
                if not isinstance(request, dict):
                    raise ValueError
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "parse error"}}
            else:
                if "id" not in request:
                    continue
                reply = self.answer(request)
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()
