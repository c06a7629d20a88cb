"""A page that shows a graph in a browser: one file, no requests, scripts allowed by their hash only."""

from __future__ import annotations

import base64
import hashlib
import html
import json
from pathlib import Path

from graphloom.schema import Graph

from . import maps

STYLE = "body{font:14px system-ui;margin:0;display:flex}canvas{flex:1;height:100vh}aside{width:24em;height:100vh;overflow:auto;padding:1em;box-sizing:border-box}input{width:100%}li.off{display:none}"
SCRIPT = """
const g = JSON.parse(document.getElementById("data").textContent), c = document.getElementById("c"), p = c.getContext("2d");
const colors = ["#4269d0", "#3ca951", "#9498a0"], find = document.getElementById("find"), n = g.label.length;
const order = [...g.file.keys()].sort((a, b) => g.file[a] < g.file[b] ? -1 : g.file[a] > g.file[b] ? 1 : a - b), at = [];
const hit = i => !find.value || (g.label[i] + " " + g.file[i]).toLowerCase().includes(find.value.toLowerCase());
function draw() {
  c.width = c.clientWidth; c.height = c.clientHeight;
  const r = Math.min(c.width, c.height) * 0.45;
  order.forEach((i, k) => { const a = 2 * Math.PI * k / n; at[i] = [c.width / 2 + r * Math.cos(a), c.height / 2 + r * Math.sin(a)]; });
  p.strokeStyle = "rgba(128,128,128,.25)"; p.beginPath();
  for (const [a, b] of g.edges) { p.moveTo(...at[a]); p.quadraticCurveTo(c.width / 2, c.height / 2, ...at[b]); }
  p.stroke();
  colors.forEach((color, cat) => {
    p.fillStyle = color; p.beginPath();
    for (let i = 0; i < n; i++) if (g.cat[i] === cat && hit(i)) { const s = 2 + Math.sqrt(g.deg[i]); p.moveTo(at[i][0] + s, at[i][1]); p.arc(...at[i], s, 0, 7); }
    p.fill();
  });
}
find.oninput = () => { draw(); document.querySelectorAll("li").forEach(x => x.classList.toggle("off", !x.textContent.toLowerCase().includes(find.value.toLowerCase()))); };
window.onresize = draw; draw();
"""


def sha(text: str) -> str:
    return "sha256-" + base64.b64encode(hashlib.sha256(text.encode()).digest()).decode()


def render(island: dict, folders: list[dict], title: str, generated_at: str) -> str:
    """The page; each inlined body is allowed by the hash of its exact bytes, and ``<`` is escaped in the data."""
    data = json.dumps(island, ensure_ascii=False, separators=(",", ":")).replace("<", "\\u003c")
    policy = f"default-src 'none'; script-src '{sha(SCRIPT)}' '{sha(data)}'; style-src '{sha(STYLE)}'"
    lists = "".join(f"<h3>{html.escape(f['dir'] or '/')} ({f['n']})</h3><ul>{''.join(f'<li>{html.escape(x)}</li>' for x in f['ids'])}</ul>" for f in folders)
    return (
        f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{policy}"><title>{html.escape(title)}</title><style>{STYLE}</style></head>\n'
        f'<body data-generated-at="{html.escape(generated_at)}"><canvas id="c" aria-hidden="true"></canvas><aside><h1>{html.escape(title)}</h1><p>{len(island["label"])} nodes, {len(island["edges"])} edges</p>'
        f'<input id="find" type="search" aria-label="search">{lists}</aside>\n<script type="application/json" id="data">{data}</script>\n<script>{SCRIPT}</script></body></html>\n'
    )


def write(graph: Graph, path: str, title: str, generated_at: str) -> None:
    """One graph as a page; a sink for what a browser can show."""
    got = maps.island(graph.nodes, graph.edges).drop("graph").head(1)
    island = got[0].asDict() if got else {x: [] for x in ("label", "kind", "file", "line", "deg", "cat", "edges")}
    folders = [r.asDict() for r in maps.by_directory(graph.nodes).orderBy("dir").collect()]
    Path(path).write_text(render(island, folders, title, generated_at), encoding="utf-8")
