"""A repository from its files to pages, tools and a system of services."""

import io
import json
import re

import pytest

from graphloom import build, cli
from graphloom.sources import registry, viewer


@pytest.fixture(scope="module")
def repos(tmp_path_factory):
    top = tmp_path_factory.mktemp("repos")
    for name, files in {
        "shop": {"a.py": "import os\nclass Shop:\n    def buy(self):\n        total(os.getcwd())\n\ndef total(x):\n    return x\n", "api/r.py": 'def serve(app):\n    app.get("/orders/{id}", total)\n', "R.md": "# <b>\n"},
        "web": {"w.go": 'package w\nimport "net/http"\nfunc Load() { http.Get("http://shop/orders/7") }\n', "gone.go": 'package w\nfunc Old() { client.Get("http://shop/none") }\n'},
    }.items():
        for path, text in files.items():
            (top / name / path).parent.mkdir(parents=True, exist_ok=True)
            (top / name / path).write_text(text)
    return top


def run(spark, *args, given=""):
    out, err = io.StringIO(), io.StringIO()
    code = cli.main([str(a) for a in args], io.StringIO(given), out, err, spark)
    return code, out.getvalue(), err.getvalue()


def test_build_and_tools(spark, repos):
    code, said, err = run(spark, "build", repos / "shop")
    assert code == 0 and said.startswith("3 files"), err
    folder = repos / "shop" / build.FOLDER
    doc = json.loads((folder / "map.json").read_text())
    ids = {n["id"] for n in doc["nodes"]}
    assert {"a-py:shop-buy", "a-py:total", "module-os:os", "r-md:r-md"} <= ids and doc["root"] == "shop" and [p["key"] for p in doc["provides"]] == ["GET /orders/{}"]
    assert doc["provides"][0]["node"] == "api-r-py:serve" and all(n["community"] >= 0 for n in doc["nodes"])
    assert "## Landmarks" in (folder / "MAP.md").read_text() and set(json.loads((folder / "hashes.json").read_text())) == {"a.py", "api/r.py", "R.md"}
    first = (folder / "map.json").read_text()
    build.run(spark, str(repos / "shop"), doc["generated_at"])
    assert (folder / "map.json").read_text() == first
    call = lambda i, tool, **a: json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": tool, "arguments": a}})
    lines = [json.dumps({"id": 0, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}}), "", json.dumps({"method": "initialized"}), "{", json.dumps({"id": 1, "method": "no"}), json.dumps({"id": 2, "method": "tools/list"})]
    lines += [call(3, "get_node", id="a-py:total"), call(4, "get_node", id="zz"), call(5, "get_neighbors", id="a-py:total"), call(6, "shortest_path", **{"from": "a-py:shop-buy", "to": "a-py:shop"}), call(7, "query_graph", question="total"), call(8, "other"), call(9, "shortest_path", **{"from": "zz", "to": "a-py:shop"})]
    code, said, err = run(spark, "serve", repos / "shop", given="\n".join(lines))
    got = [json.loads(x) for x in said.splitlines()]
    assert code == 0 and [g["id"] for g in got] == [0, None, 1, 2, 3, 4, 5, 6, 7, 8, 9], err
    assert got[0]["result"]["protocolVersion"] == "2024-11-05" and got[1]["error"]["code"] == -32700 and got[2]["error"]["code"] == -32601 and len(got[3]["result"]["tools"]) == 4
    text = [g["result"]["content"][0]["text"] for g in got[4:]]
    assert text[0] == "a-py:total [function] total @ a.py:6" and text[3] == "a-py:shop-buy\na-py:a-py\na-py:shop\n" and text[4].startswith("NODES\n")
    assert text[2].splitlines()[2:] == ["a-py:shop-buy -calls-> a-py:total (INFERRED)", "a-py:a-py -contains-> a-py:total (EXTRACTED)"]
    assert [bool(g["result"].get("isError")) for g in got[4:]] == [False, True, False, False, False, True, True]


def test_page_is_closed():
    page = viewer.render({"label": ["</script>"], "file": ["f"], "kind": ["function"], "line": [1], "deg": [0], "cat": [0], "edges": []}, [{"dir": "", "n": 1, "ids": ["<x>"]}], "a & b", "2024")
    body = re.findall(r"<script[^>]*>(.*?)</script>", page, re.S)
    assert len(body) == 2 and json.loads(body[0])["label"] == ["</script>"] and all(viewer.sha(b) in page for b in body) and "&lt;x&gt;" in page and "a &amp; b" in page


def test_workspace(spark, repos):
    assert run(spark, "link", repos / "shop")[0] == 2 and run(spark, "nonsense")[0] == 2 and run(spark, "version")[0] == 0
    assert run(spark, "link", repos / "shop", repos / "web")[0] == 0
    (repos / registry.WORKSPACE.folder / "links").write_text("# across\nweb::w-go:load -> shop::api-r-py:serve calls\nweb::none -> shop::a-py:total\n")
    code, said, _ = run(spark, "links", "check", "--root", repos)
    assert code == 1 and said == "unresolved: web::none -> shop::a-py:total references\n"
    over = registry.load_overlay(str(repos))
    assert [x["from"] for x in over["links"]] == ["web::w-go:load"] and set(over["source_hashes"]) == {"shop", "web"}
    code, said, _ = run(spark, "query", "load", repos, "--workspace")
    assert code == 0 and "web::w-go:load -calls-> shop::api-r-py:serve (EXTRACTED)" in said
    assert run(spark, "workspace", "--root", repos, "list")[1] == "shop\tshop\nweb\tweb\n"
    path = repos / "web" / build.FOLDER / build.MAP
    path.write_text(path.read_text() + "\n")
    assert registry.stale(registry.WORKSPACE, str(repos), registry.load(registry.WORKSPACE, str(repos))) == ["web"]
    assert run(spark, "update", repos, "--workspace")[1] == "rebuilt web\n"
    assert run(spark, "workspace", "--root", repos, "rm", "web")[0] == 0 and run(spark, "workspace", "--root", repos, "rm", "web")[0] == 1


def test_system(spark, repos):
    for name in ("shop", "web"):
        assert run(spark, "publish", repos / name, "--to", repos)[0] == 0
    code, said, _ = run(spark, "system", "--root", repos, "audit")
    assert code == 1 and said.splitlines()[0] == "2 services: 1 links, 0 ambiguous, 1 dangling, 0 orphans" and "dangling: web http GET /none" in said
    code, said, _ = run(spark, "system", "--root", repos, "impact", "shop::GET /orders/{}")
    assert code == 0 and said.startswith("direct: web uses http GET /orders/{}") and said.endswith("affected: web\n")
    assert run(spark, "system", "--root", repos, "status")[0] == 0
    assert "web::w-go:load -calls-> shop::api-r-py:serve" in run(spark, "system", "--root", repos, "query", "load")[1]
    assert run(spark, "system", "--root", repos, "render")[0] == 0 and (repos / registry.SYSTEM.folder / "system.html").stat().st_size > 1000


def test_only_changed_files_are_parsed(spark, repos):
    import pandas as pd

    root = repos / "again"
    root.mkdir()
    (root / "a.py").write_text("def one(): pass\n")
    (root / "b.py").write_text("def two(): pass\n")
    assert build.run(spark, str(root))["files"] == 2
    stored = root / build.FOLDER / build.FACTS
    old = spark.read.parquet(str(stored)).toPandas()
    old.loc[old["label"] == "one", "label"] = "kept"  # shows whether a file was parsed again
    spark.createDataFrame(pd.DataFrame(old), spark.read.parquet(str(stored)).schema).write.parquet(str(stored) + "2")
    for f in (*stored.glob("*"), *stored.glob(".*")):
        f.unlink(missing_ok=True)
    for f in (root / build.FOLDER / (build.FACTS + "2")).glob("*.parquet"):
        f.rename(stored / f.name)
    (root / "b.py").write_text("def three(): pass\n")
    (root / "c.py").write_text("def four(): pass\n")
    build.run(spark, str(root))
    labels = lambda: {n["label"] for n in json.loads((root / build.FOLDER / build.MAP).read_text())["nodes"] if n["kind"] == "function"}
    assert labels() == {"kept", "three", "four"}
    (root / "b.py").unlink()
    (root / build.FOLDER / build.HASHES).unlink()
    build.run(spark, str(root))
    assert labels() == {"one", "four"}


def test_integration(repos, tmp_path):
    (tmp_path / "AGENTS.md").write_text("# Mine")
    first = run(None, "init", tmp_path, "--hook")
    assert first[0] == 0 and first[1].splitlines() == ["note: created", "page: updated", "hook: created"]
    assert run(None, "init", tmp_path, "--hook")[1].splitlines() == ["note: unchanged", "page: unchanged", "hook: unchanged"]
    page = (tmp_path / "AGENTS.md").read_text()
    assert page.startswith("# Mine\n") and page.count("begin -->") == 1
    (tmp_path / "AGENTS.md").write_text(page.replace("Asking", "Old") + "after\n")
    assert run(None, "init", tmp_path)[1].splitlines() == ["note: unchanged", "page: updated"] and (tmp_path / "AGENTS.md").read_text() == page + "after\n"
    (tmp_path / build.FOLDER / "settings.json").write_text("[]")
    assert run(None, "init", tmp_path, "--hook")[0] == 1
    assert run(None, "hook", given="no json") == (0, "", "") and run(None, "hook", given=json.dumps({"cwd": str(tmp_path)})) == (0, "", "")
    (tmp_path / build.FOLDER / build.MAP).write_text("{}")
    assert "MAP.md" in json.loads(run(None, "hook", given=json.dumps({"cwd": str(tmp_path)}))[1])["context"]
