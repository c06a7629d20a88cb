"""Workspaces (members beside each other) and systems (a store of published maps): registries and overlays on disk."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import build
from graphloom.operators import system, workspace
from graphloom.operators.paths import cut
from graphloom.operators.paths import drop as release
from graphloom.schema import Graph

from . import maps

VERSION = "1"


@dataclass(frozen=True)
class Kind:
    """Where a registry lies, what it lists and by what key."""

    folder: str
    file: str
    rows: str
    key: str
    digits: int  # of a map's hash


WORKSPACE = Kind(".graphloom-workspace", "workspace.json", "members", "alias", 64)
SYSTEM = Kind(".graphloom-system", "system.json", "services", "name", 12)


def find_root(kind: Kind, start: str = ".") -> str | None:
    """The nearest folder upwards that has a registry."""
    here = Path(start).resolve()
    return next((str(p) for p in [here, *here.parents] if (p / kind.folder / kind.file).exists()), None)


def common_ancestor(paths: list[str]) -> str:
    return os.path.commonpath([str(Path(p).resolve()) for p in paths])


def write_json(path: Path, value: dict) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def load(kind: Kind, root: str) -> dict:
    got = json.loads((Path(root) / kind.folder / kind.file).read_text(encoding="utf-8"))
    if not got.get("version") or any(not r.get(kind.key) or not r.get("path") for r in got[kind.rows]):
        raise ValueError(f"{kind.file}: a version and each row's {kind.key} and path are needed")
    return got | {kind.rows: sorted(got[kind.rows], key=lambda r: r[kind.key])}


def empty(kind: Kind, name: str) -> dict:
    return {"version": VERSION, "name": name, "generated_at": build.now(), kind.rows: []}


def save(kind: Kind, root: str, registry: dict) -> None:
    rows = sorted(registry[kind.rows], key=lambda r: r[kind.key])
    write_json(Path(root) / kind.folder / kind.file, registry | {"generated_at": build.now(), kind.rows: rows})


def put(kind: Kind, registry: dict, row: dict) -> dict:
    return registry | {kind.rows: [r for r in registry[kind.rows] if r[kind.key] != row[kind.key]] + [row]}


def drop(kind: Kind, registry: dict, key: str) -> dict:
    if all(r[kind.key] != key for r in registry[kind.rows]):
        raise KeyError(f"no {kind.rows[:-1]} {key!r}")
    return registry | {kind.rows: [r for r in registry[kind.rows] if r[kind.key] != key]}


def map_path(kind: Kind, root: str, row: dict) -> Path:
    base = Path(root) / row["path"]
    return base / build.FOLDER / build.MAP if kind is WORKSPACE else base / build.MAP


def map_hash(kind: Kind, path: Path) -> str:
    return hashlib.sha256(path.read_bytes()).hexdigest()[: kind.digits] if path.exists() else ""


def stale(kind: Kind, root: str, registry: dict) -> list[str]:
    """Keys of rows whose map is gone or differs from what the registry recorded."""
    return [r[kind.key] for r in registry[kind.rows] if map_hash(kind, map_path(kind, root, r)) != r.get("map_hash")]


def graphs(spark: SparkSession, kind: Kind, root: str, registry: dict) -> Graph:
    """The stored graphs of all rows, each under its key."""
    if not registry[kind.rows]:
        raise ValueError(f"the registry lists no {kind.rows}")
    return build.union([build.rename(maps.load(spark, str(map_path(kind, root, r))), r[kind.key]) for r in registry[kind.rows]])


def member(spark: SparkSession, root: str, path: str, alias: str | None = None) -> dict:
    """A workspace row for a project, which is built if it has no map."""
    own = Path(path).resolve()
    if not (own / build.FOLDER / build.MAP).exists():
        build.run(spark, str(own))
    row = {"alias": alias or own.name, "path": Path(os.path.relpath(own, root)).as_posix()}
    return row | {"map_hash": map_hash(WORKSPACE, map_path(WORKSPACE, root, row))}


def refresh_overlay(spark: SparkSession, root: str, registry: dict) -> dict:
    """Reads the links file (``links`` beside the registry), sorts links into resolved and unresolved, and
    stores the overlay. Raises on a faulty line."""
    path = Path(root) / WORKSPACE.folder / "links"
    lines = path.read_text(encoding="utf-8").splitlines() if path.exists() else []
    rows = workspace.parse_links(spark.createDataFrame([(x,) for x in lines], "value string"))
    if wrong := rows.where("error is not null").head(1):
        raise ValueError(f"links: {wrong[0]['error']}: {wrong[0]['line']}")
    found = []
    if registry[WORKSPACE.rows]:
        ids = graphs(spark, WORKSPACE, root, registry).nodes.select(F.col("graph").alias("alias"), "id")
        found = workspace.overlay(rows, ids).orderBy("src", "dst", "relation").collect()
    link = lambda r: {"from": r["src"], "to": r["dst"], "relation": r["relation"], "confidence": r["confidence"], "via": r["via"]}
    out = {"version": VERSION, "generated_at": build.now(), "source_hashes": {r["alias"]: r["map_hash"] for r in registry["members"]}, "links": [link(r) for r in found if r["status"] == "resolved"], "ambiguous": []}
    if open_ := [link(r) for r in found if r["status"] != "resolved"]:
        out["unresolved"] = open_
    write_json(Path(root) / WORKSPACE.folder / "overlay.json", out)
    return out


def load_overlay(root: str) -> dict:
    got = json.loads((Path(root) / WORKSPACE.folder / "overlay.json").read_text(encoding="utf-8"))
    by = lambda r: (r["from"], r["to"], r["relation"])
    return got | {k: sorted(got[k], key=by) for k in ("links", "ambiguous", "unresolved") if k in got}


def federated(spark: SparkSession, root: str) -> Graph:
    """The workspace as one graph, with the links that resolve."""
    registry = load(WORKSPACE, root)
    links = [(r["from"], r["to"], r["relation"], r["confidence"], r["via"], "resolved") for r in refresh_overlay(spark, root, registry)["links"]]
    over = spark.createDataFrame(links, "src string, dst string, relation string, confidence string, via string, status string")
    return workspace.federate(graphs(spark, WORKSPACE, root, registry), over, registry["name"])


def commit_of(root: str) -> str:
    got = subprocess.run(["git", "-C", root, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=False)
    return got.stdout.strip() if got.returncode == 0 else ""


def publish(spark: SparkSession, service: str, to: str, name: str | None = None) -> dict:
    """Copies a service's map into a system's store and registers it with its commit and hash."""
    own = Path(service).resolve()
    name = name or own.name
    source = own / build.FOLDER / build.MAP
    if not source.exists():
        build.run(spark, str(own))
    row = {"name": name, "path": f"{SYSTEM.folder}/services/{name}"}
    target = map_path(SYSTEM, to, row)
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.copyfile(source, target)
    row |= {"commit": c} if (c := commit_of(str(own))) else {}
    row["map_hash"] = map_hash(SYSTEM, target)
    there = (Path(to) / SYSTEM.folder / SYSTEM.file).exists()
    registry = put(SYSTEM, load(SYSTEM, to) if there else empty(SYSTEM, Path(to).resolve().name), row)
    save(SYSTEM, to, registry)
    return registry


def matched(spark: SparkSession, root: str) -> tuple[Graph, dict]:
    g = graphs(spark, SYSTEM, root, load(SYSTEM, root))
    return g, system.match(g.endpoints)


OVERLAY_ORDER = {k: ("from_service", "from", "to_service", "to", "kind", "key", "via") for k in ("links", "ambiguous")} | {k: ("service", "kind", "key", "display") for k in ("dangling", "orphans")}


def system_overlay(found: dict, root: str, packed: bool = False) -> dict[str, DataFrame]:
    """Stores what matching found, in total order, and returns its tables. A sink: the driver writes what it gets, and
    holds a part of one list at a time. Ambiguous links are written from their two sides and are no stored table."""
    full = lambda end: F.concat_ws("::", F.coalesce(f"{end}_service", F.lit("None")), F.coalesce(f"{end}_node", F.lit("None"))).alias(end)
    link = [full("from"), full("to"), "from_service", "to_service", "kind", "key", "confidence", "via"]
    rows, lists = {}, {}
    for k, cols in OVERLAY_ORDER.items():  # one list's shuffles at a time
        rows[k] = found[k].select(link) if k in ("links", "ambiguous") else found[k]
        if sides := getattr(found[k], "_sides", None):  # as many as asks times offers
            lists[k] = maps.crossed(*sides)
        else:
            rows[k] = cut(rows[k])
            lists[k] = maps.items(rows[k], *cols)
        release()
    path = Path(root) / SYSTEM.folder / ("overlay.json.gz" if packed else "overlay.json")
    path.parent.mkdir(parents=True, exist_ok=True)
    maps.write_pieces(maps.document({"version": VERSION, "generated_at": build.now()} | lists), str(path))
    return rows
