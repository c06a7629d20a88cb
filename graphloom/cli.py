"""Command line: ``python -m graphloom.cli <verb>``. Exit codes: 0 fine, 1 failed or found faults, 2 wrong usage."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from graphloom import __name__ as PROGRAM
from graphloom import build, integrate
from graphloom.operators import paths, query, system
from graphloom.schema import Graph
from graphloom.server import Server
from graphloom.session import local_session
from graphloom.sources import registry as R
from graphloom.sources import viewer

RELEASE = "0.1.0"


class Usage(Exception):
    """Wrong usage: exit code 2."""


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise Usage(f"{message}\n{self.format_usage()}")


def parser() -> Parser:
    top = Parser(prog=PROGRAM)
    verbs = top.add_subparsers(dest="verb", required=True, parser_class=Parser)

    def verb(name: str, *args: tuple, into=verbs, **kw) -> Parser:
        p = into.add_parser(name, **kw)
        for a in args:
            p.add_argument(a[0], **(a[1] if len(a) > 1 else {}))
        return p

    root, flag = ("path", {"nargs": "?", "default": "."}), ("--workspace", {"action": "store_true"})
    at = ("--root", {})
    verb("build", root)
    verb("update", root, flag)
    verb("query", ("question",), root, flag)
    verb("serve", root, flag)
    verb("link", ("paths", {"nargs": "+"}), ("--name", {"default": "workspace"}))
    sub = verb("workspace", at).add_subparsers(dest="what", required=True, parser_class=Parser)
    verb("add", ("path",), ("--as", {"dest": "alias"}), into=sub)
    verb("rm", ("alias",), into=sub)
    verb("list", into=sub)
    verb("render", into=sub)
    verb("links", ("what", {"choices": ["check"]}), at)
    verb("federate", ("--explain", {"action": "store_true"}), at)
    verb("publish", root, ("--to", {}), ("--as", {"dest": "alias"}))
    sub = verb("system", at).add_subparsers(dest="what", required=True, parser_class=Parser)
    for name in ("build", "render", "audit", "status", "list"):
        verb(name, into=sub)
    verb("impact", ("target",), into=sub)
    verb("query", ("question",), into=sub)
    verb("init", root, ("--page", {"default": "AGENTS.md"}), ("--hook", {"action": "store_true"}))
    verb("hook")
    verb("version")
    return top


def found_root(kind: R.Kind, given: str | None) -> str:
    if not (root := given or R.find_root(kind)):
        raise Usage(f"no {kind.file} here or above; pass --root")
    return root


def answer(g: Graph, question: str) -> str:
    return query.render_text(*query.query(g.nodes, g.edges, question))


def workspace_of(spark: SparkSession, a: argparse.Namespace, out: TextIO) -> Graph:
    root = found_root(R.WORKSPACE, None if a.path == "." else a.path)
    if old := R.stale(R.WORKSPACE, root, R.load(R.WORKSPACE, root)):
        print(f"note: stale members: {', '.join(old)}", file=out)
    return R.federated(spark, root)


def do_build(spark, a, inp, out, err):
    n = build.run(spark, a.path)
    print(", ".join(f"{v} {k}" for k, v in n.items()), file=out)


def do_update(spark, a, inp, out, err):
    if not a.workspace:
        return do_build(spark, a, inp, out, err)
    root = found_root(R.WORKSPACE, None if a.path == "." else a.path)
    reg = R.load(R.WORKSPACE, root)
    for alias in R.stale(R.WORKSPACE, root, reg):
        row = next(r for r in reg["members"] if r["alias"] == alias)
        build.run(spark, str(Path(root) / row["path"]))
        reg = R.put(R.WORKSPACE, reg, R.member(spark, root, str(Path(root) / row["path"]), alias))
        print(f"rebuilt {alias}", file=out)
    R.save(R.WORKSPACE, root, reg)
    R.refresh_overlay(spark, root, reg)


def do_query(spark, a, inp, out, err):
    g = workspace_of(spark, a, err) if a.workspace else build.load(spark, a.path)
    out.write(answer(g, a.question))


def do_serve(spark, a, inp, out, err):
    g = workspace_of(spark, a, err) if a.workspace else build.load(spark, a.path)
    Server(Graph(paths.cut(g.nodes), paths.cut(g.edges)), PROGRAM, RELEASE).serve(inp, out)


def do_link(spark, a, inp, out, err):
    if len(a.paths) < 2:
        raise Usage("link needs two projects at least")
    root, reg = R.common_ancestor(a.paths), R.empty(R.WORKSPACE, a.name)
    for p in a.paths:
        reg = R.put(R.WORKSPACE, reg, R.member(spark, root, p))
    R.save(R.WORKSPACE, root, reg)
    got = R.refresh_overlay(spark, root, reg)
    print(f"{len(reg['members'])} members, {len(got['links'])} links at {root}", file=out)


def do_workspace(spark, a, inp, out, err):
    root = found_root(R.WORKSPACE, a.root)
    reg = R.load(R.WORKSPACE, root)
    if a.what == "list":
        print(*[f"{r['alias']}\t{r['path']}" for r in reg["members"]], sep="\n", file=out)
    elif a.what == "render":
        viewer.write(R.federated(spark, root), str(Path(root) / R.WORKSPACE.folder / "workspace.html"), reg["name"], build.now())
    else:
        reg = R.drop(R.WORKSPACE, reg, a.alias) if a.what == "rm" else R.put(R.WORKSPACE, reg, R.member(spark, root, a.path, a.alias))
        R.save(R.WORKSPACE, root, reg)
        R.refresh_overlay(spark, root, reg)


def do_links(spark, a, inp, out, err):
    root = found_root(R.WORKSPACE, a.root)
    got = R.refresh_overlay(spark, root, R.load(R.WORKSPACE, root))
    for x in got.get("unresolved", []):
        print(f"unresolved: {x['from']} -> {x['to']} {x['relation']}", file=out)
    return int("unresolved" in got)


def do_federate(spark, a, inp, out, err):
    root = found_root(R.WORKSPACE, a.root)
    got = R.refresh_overlay(spark, root, R.load(R.WORKSPACE, root))
    for k in ("links", "ambiguous") if a.explain else ():
        for x in got[k]:
            print(f"{k}: {x['from']} -{x['relation']}-> {x['to']} ({x['confidence']}, {x['via']})", file=out)
    print(f"{len(got['links'])} links, {len(got['ambiguous'])} ambiguous", file=out)


def do_publish(spark, a, inp, out, err):
    to = a.to or found_root(R.SYSTEM, None)
    reg = R.publish(spark, a.path, to, a.alias)
    print(f"{len(reg['services'])} services registered", file=out)


def do_system(spark, a, inp, out, err):
    root = found_root(R.SYSTEM, a.root)
    reg = R.load(R.SYSTEM, root)
    if a.what == "list":
        print(*[f"{r['name']}\t{r['path']}\t{r.get('commit') or '-'}" for r in reg["services"]], sep="\n", file=out)
        return 0
    if a.what == "status":
        old = R.stale(R.SYSTEM, root, reg)
        print(f"{len(reg['services'])} services registered; {'stale: ' + ', '.join(old) if old else 'all maps are as recorded'}", file=out)
        return int(bool(old))
    g, found = R.matched(spark, root)
    if a.what in ("build", "audit"):
        got = {k: d.orderBy(*R.OVERLAY_ORDER[k]).collect() for k, d in R.system_overlay(found, root).items()}
        print(f"{len(reg['services'])} services: " + ", ".join(f"{len(got[k])} {k}" for k in ("links", "ambiguous", "dangling", "orphans")), file=out)
        if a.what == "audit":
            for k in ("dangling", "orphans"):
                print(*[f"{k}: {x['service']} {x['kind']} {x['key']}" for x in got[k]], sep="\n", end="\n" if got[k] else "", file=out)
            print(*[f"ambiguous: {x['from']} -> {x['to']} {x['key']}" for x in got["ambiguous"]], sep="\n", end="\n" if got["ambiguous"] else "", file=out)
            return int(bool(got["dangling"]))
    elif a.what == "impact":
        service, _, key = a.target.partition("::")
        direct, all_ = paths.impact(found["links"], service, key or None)
        for r in direct.orderBy("from_service", "from_node", "kind", "key").collect():
            print(f"direct: {r['from_service']} uses {r['kind']} {r['key']} ({r['confidence']})", file=out)
        print("affected: " + ", ".join(r[0] for r in all_.orderBy("service").collect()), file=out)
    else:
        whole = system.combine(g, found["links"])
        if a.what == "query":
            out.write(answer(whole, a.question))
        else:
            viewer.write(whole, str(Path(root) / R.SYSTEM.folder / "system.html"), reg["name"], build.now())
    return 0


def main(args: list[str], inp: TextIO = sys.stdin, out: TextIO = sys.stdout, err: TextIO = sys.stderr, spark: SparkSession | None = None) -> int:
    """Runs one verb; a folder alone means ``build``. Takes the session given, the active one, or a local one."""
    try:
        if args and args[0] not in {*DO, "version", "init", "hook"} and not args[0].startswith("-") and Path(args[0]).is_dir():
            args = ["build", *args]
        a = parser().parse_args(args)
        if a.verb == "version":
            print(f"{PROGRAM} {RELEASE}", file=out)
            return 0
        if a.verb == "hook":
            integrate.nudge(inp, out)
            return 0
        if a.verb == "init":
            print(*[f"{k}: {v}" for k, v in integrate.install(a.path, a.page, a.hook).items()], sep="\n", file=out)
            return 0
        return DO[a.verb](spark or SparkSession.getActiveSession() or local_session(), a, inp, out, err) or 0
    except Usage as e:
        print(e, file=err)
        return 2
    except (OSError, ValueError, KeyError) as e:
        print(f"{PROGRAM}: {e}", file=err)
        return 1


def script() -> None:
    """Entry of the installed command."""
    sys.exit(main(sys.argv[1:]))


DO = {"build": do_build, "update": do_update, "query": do_query, "serve": do_serve, "link": do_link, "workspace": do_workspace, "links": do_links, "federate": do_federate, "publish": do_publish, "system": do_system}

if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
