"""Definitions, imports and calls of source files in seven languages.

A file is masked first (comments and strings blanked, offsets kept); scopes are then found by matching
braces, or by indentation. What is emitted are facts; ids are made of them by column expressions.
Function bodies are searched for calls, not for further definitions (Go has none to find).
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import expr as X


@dataclass(frozen=True)
class Spec:
    """How a language is read: comment and string forms, class-like, method and function headers, imports."""

    masks: str
    types: str
    functions: str
    methods: str
    imports: str
    name_only: bool = False  # a call is known by its last name alone


C_LIKE = r"//[^\n]*|/\*.*?\*/"
STR = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
SPECS = {
    "go": Spec(rf"{C_LIKE}|`[^`]*`|{STR}", "", "", "", ""),
    "python": Spec(rf'"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\'|#[^\n]*|{STR}', "", "", "", r"^(?:import\s+([\w.]+)|from\s+([\w.]+)\s+import\b)"),
    "javascript": Spec(rf"{C_LIKE}|`(?:\\.|[^`\\])*`|{STR}", r"\bclass\s+([\w$]+)", r"\bfunction\s*\*?\s*([\w$]+)\s*\(", r"(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*\*?#?([\w$]+)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{};]+)?(?=\{)", r"^\s*import\b[^;'\"]*?['\"]([^'\"\n]+)['\"]"),
    "rust": Spec(rf'{C_LIKE}|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\\n])\'', r"\b(?:struct|enum|trait)\s+(\w+)|\b(impl)\b(?:\s*<[^>{]*>)?\s+(?:[\w]+::)*(\w+)", r"\bfn\s+(\w+)", r"\bfn\s+(\w+)", r"^\s*(?:pub\s+)?use\s+([^;]+);"),
    "java": Spec(rf"{C_LIKE}|{STR}", r"\b(?:class|interface|enum|record)\s+(\w+)", "", r"(?:[\w<>\[\],.?@]+\s+)+(\w+)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s+[\w.,\s]+)?(?=[{;])", r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", True),
    "php": Spec(rf"{C_LIKE}|#[^\n]*|{STR}", r"\b(?:class|interface|trait)\s+(\w+)", r"\bfunction\s+&?(\w+)\s*\(", r"\bfunction\s+&?(\w+)\s*\(", r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)[^;]*;", True),
}
SPECS["typescript"] = Spec(SPECS["javascript"].masks, r"\b(?:class|interface)\s+([\w$]+)", SPECS["javascript"].functions, SPECS["javascript"].methods, SPECS["javascript"].imports)
#: Words before a parenthesis that call nothing.
NO_CALL = set("if for while switch catch return function func fn def class new match elif else and or not in is lambda yield await async with assert del print_ sizeof typeof super select case defer go throw do try array list isset unset empty echo declare fun impl use where loop move".split()) - {"super", "print_"}
CALL = re.compile(r"(?:(?<=\W)|^)((?:[A-Za-z_$][\w$]*)(?:(?:\.|::|->|\?\.)[A-Za-z_$][\w$]*)*)\s*\(")
BEFORE = re.compile(r"(?:\bnew|\bfunction\s*\*?|\bfn|\bfunc|\bdef|\bclass)\s+$")


def mask(text: str, pattern: str) -> str:
    """Text with comments and strings as blanks; line ends stay."""
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def closing(text: str, at: int) -> int:
    """Place of the brace that closes the one at ``at``, or the end."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(text)


class File:
    """Facts of one file: ``(fact, label, kind, line, name, owner)``."""

    def __init__(self, text: str, lang: str):
        self.raw, self.spec, self.lang = text, SPECS[lang], lang
        self.text = mask(text, self.spec.masks)
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]
        self.facts: list[tuple] = []

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def define(self, label: str, kind: str, at: int, body: tuple[int, int] | None) -> None:
        self.facts.append(("def", label, kind, self.line(at), "", ""))
        for m in CALL.finditer(self.text, *body) if body else ():
            name = re.split(r"\.|::|->|\?\.", m[1])[-1] if self.spec.name_only else m[1]
            if m[1] in NO_CALL or BEFORE.search(self.text, max(0, m.start() - 20), m.start()):
                continue
            self.facts.append(("call", "", "", self.line(m.start(1)), name.replace("?.", "."), label))

    def imports(self) -> None:
        for m in re.finditer(self.spec.imports, self.raw, re.M):
            name = next((g for g in m.groups() if g), "").strip()
            blank = self.text[m.start() : m.end()].strip() == ""
            if name and not blank:
                self.facts.append(("import", "", "", self.line(m.start() + len(m[0]) - len(m[0].lstrip())), name, ""))

    def braces(self, lo: int, hi: int, owner: str = "") -> None:
        """Definitions between two places; inside a class its methods."""
        inner = self.spec.methods if owner else self.spec.functions
        rx = re.compile("|".join(f"(?P<{k}>{p})" for k, p in (("type", self.spec.types), ("func", inner)) if p))
        at = lo
        while m := rx.search(self.text, at, hi):
            name = next((g for g in m.groups()[1:] if g and g != m[0] and g != "impl"), "")
            stop = re.compile(r"[{;]").search(self.text, m.end(), hi)
            body = (stop.start() + 1, closing(self.text, stop.start())) if stop and stop[0] == "{" else None
            at = body[1] + 1 if body else (stop.end() if stop else m.end())
            if m.group("type"):
                if not m[0].startswith("impl"):
                    self.define(name, "class", m.start(), None)
                if body:
                    self.braces(*body, owner=name)
            elif name in NO_CALL:
                at = m.end()
            elif owner:
                self.define(f"{owner}.{name}", "method", m.start() + len(m[0]) - len(m[0].lstrip()), body)
            else:
                self.define(name, "function", m.start(), body)

    def indented(self) -> None:
        rows = self.text.split("\n")
        head = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+(\w+)")
        scopes: list[tuple[int, str, str]] = []  # indent, what, name
        for k, row in enumerate(rows):
            m = head.match(row)
            if not m:
                continue
            indent = len(m[1].expandtabs())
            scopes = [s for s in scopes if s[0] < indent]
            if not any(s[1] == "def" for s in scopes):
                owner, end = (scopes[-1][2] if scopes else ""), k + 1
                while end < len(rows) and (not rows[end].strip() or len(rows[end]) - len(rows[end].lstrip()) > len(m[1]) or rows[end].lstrip()[0] in ")]}"):
                    end += 1
                last = self.starts[end] if end < len(self.starts) else len(self.text)
                at = self.starts[k] + len(m[1])
                if m[2] == "class":
                    self.define(m[3], "class", at, None)
                else:
                    self.define(f"{owner}.{m[3]}" if owner else m[3], "method" if owner else "function", at, (self.starts[k] + m.end(), last))
            scopes.append((indent, m[2], m[3]))

    def go(self) -> None:
        for m in re.finditer(r"^\s*import\s*(?:\(([^)]*)\)|[^\n]*)", self.text, re.M):
            for x in re.finditer(r'"([^"\n]+)"|`([^`]+)`', self.raw[m.start() : m.end()]):
                at = m.start() + x.start()
                line = self.raw[self.raw.rfind("\n", 0, at) + 1 : at]
                if "//" not in line:
                    self.facts.append(("import", "", "", self.line(at), x[1] or x[2], ""))
        rx = re.compile(r"^func\s*(?:\(([^)]*)\)\s*)?(\w+)|^\s*type\s+(\w+)|^type\s*\(", re.M)
        for m in rx.finditer(self.text):
            if m[3]:
                self.define(m[3], "class", m.start(3), None)
            elif not m[2]:
                end = self.text.find("\n)", m.end())
                for x in re.finditer(r"^\s*(\w+)\s+[\w*\[\]]", self.text[m.end() : end], re.M):
                    if self.text.count("{", m.end(), m.end() + x.start()) == self.text.count("}", m.end(), m.end() + x.start()):
                        self.define(x[1], "class", m.end() + x.start(1), None)
            else:
                header = self.text.find("{", m.end())
                body = (header + 1, closing(self.text, header)) if header >= 0 else None
                words = re.findall(r"[A-Za-z_]\w*", m[1] or "")
                own = (words[1] if len(words) > 1 else words[0]) if words else ""
                self.define(f"{own}.{m[2]}" if own else m[2], "method" if own else "function", m.start(), body)

    def read(self) -> list[tuple]:
        if self.lang == "go":
            self.go()
        else:
            self.imports()
            self.indented() if self.lang == "python" else self.braces(0, len(self.text))
        return self.facts


PARSERS: dict[str, Callable[[str, str], list[tuple]]] = {lang: lambda text, lang: File(text, lang).read() for lang in SPECS}


def facts(files: DataFrame, parsers: dict[str, Callable] | None = None) -> DataFrame:
    """``graph, file, lang, seq, fact, label, kind, line, name, owner`` of files; parsers may be added by language."""
    known = parsers or PARSERS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for graph, file, lang, content in zip(pdf["graph"], pdf["rel_path"], pdf["lang"], pdf["content"]):
                found = known[lang](bytes(content).decode("utf-8", "replace"), lang) if lang in known else []
                rows += [(graph, file, lang, k, *f) for k, f in enumerate([("file", file, "doc" if lang == "markdown" else "file", 1, "", ""), *found])]
            yield pd.DataFrame(rows, columns=["graph", "file", "lang", "seq", "fact", "label", "kind", "line", "name", "owner"])

    return files.select("graph", "rel_path", "lang", "content").mapInPandas(run, "graph string, file string, lang string, seq int, fact string, label string, kind string, line int, name string, owner string")


def extract(files: DataFrame, parsers: dict[str, Callable] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (with ``seq``), edges and raw calls of files. Parsing runs once if the facts are persisted by the caller."""
    return from_facts(facts(files, parsers))


def from_facts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = X.node_id("file", "file")
    last = F.when(F.col("lang") == "go", X.import_base("name")).otherwise(X.last_segment("name"))
    module = X.node_id(F.concat(F.lit("module:"), "name"), last)
    imports = rows.where("fact = 'import'")
    node = lambda d, id, label, kind: d.select("graph", id.alias("id"), label.alias("label"), kind.alias("kind"), "file", "line", F.lit(-1).alias("community"), "seq")
    nodes = node(rows.where("fact in ('file', 'def')"), X.node_id("file", "label"), F.col("label"), F.col("kind")).unionByName(node(imports, module, last, F.lit("module")))
    edge = lambda d, dst, relation: d.select("graph", own.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.lit("EXTRACTED").alias("confidence"))
    edges = edge(rows.where("fact = 'def'"), X.node_id("file", "label"), "contains").unionByName(edge(imports, module, "imports"))
    listed = imports.groupBy("graph", "file").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]).alias("imports"))
    calls = rows.where("fact = 'call'").join(listed, ["graph", "file"], "left")
    calls = calls.select("graph", X.node_id("file", "owner").alias("from_id"), F.col("name").alias("callee"), "line", "file", F.coalesce("imports", F.array().cast("array<string>")).alias("imports"))
    return nodes, edges, calls
