"""Repositories as tables of files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which files count, and which folders don't.
LANGUAGES = {".go": "go", ".md": "markdown", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".rs": "rust", ".java": "java", ".php": "php"}
SKIP = [".git", "node_modules", "vendor"]
CONTRACT_SKIP = [*SKIP, "dist", "build", "target", ".venv", "venv", "__pycache__", ".next", "testdata"]
CONTRACT_EXT = [".go", ".py", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".vue", ".svelte", ".rs", ".java", ".php", ".cs", ".kt", ".proto"]
CONTRACT_NAMES = ["contract.json", "openapi.json", "swagger.json"]
MOST = 1 << 20


def read_files(spark: SparkSession, root: str, graph: str, own: str = ".graphloom") -> DataFrame:
    """All files under a folder (any file system Spark reads): ``graph, path, rel_path, length, content``.
    ``content`` is read only where it is used."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content").union(hidden_files(spark, root))
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace(F.col("path"), rf"^.*?\Q{base}\E/+", "")
    out = raw.select(F.lit(graph).alias("graph"), "path", rel.alias("rel_path"), "length", "content")
    return out.where(~_under(F.col("rel_path"), [own]))


def hidden_files(spark: SparkSession, root: str) -> DataFrame:
    """Files whose own name starts with ``_`` or ``.`` (``__init__.py``, ``.gitignore``). Spark's readers leave them out, even
    when they are named, so the driver reads them; only sources and the ignore file count, which are few."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, rows = fs.listFiles(path, True), []
    while found.hasNext():
        f = found.next()
        name = f.getPath().getName().lower()
        if name[:1] in "._" and (name == ".gitignore" or any(name.endswith(x) for x in {*LANGUAGES, *CONTRACT_EXT})):
            stream = fs.open(f.getPath())
            try:
                rows.append((f.getPath().toString(), f.getLen(), bytearray(stream.readAllBytes())))
            finally:
                stream.close()
    return spark.createDataFrame(rows, "path string, length long, content binary")


def _under(rel: Column, names: list[str]) -> Column:
    return rel.rlike(rf"(^|/)({'|'.join(map(re.escape, names))})/")


class Ignore:
    """Patterns of an ignore file: later ones win, ``!`` takes back, a slash anchors, a trailing slash means folders."""

    def __init__(self, text: str):
        self.rules = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            no, only = line.startswith("!"), line.endswith("/")
            body = line.lstrip("!").rstrip("/") if no else line.rstrip("/")
            anchored = "/" in body
            body = body.lstrip("/")
            out, i = "", 0
            while i < len(body):
                if body.startswith("**/", i):
                    out, i = out + "(?:.*/)?", i + 3
                elif body.startswith("**", i):
                    out, i = out + ".*", i + 2
                elif body[i] == "*":
                    out, i = out + "[^/]*", i + 1
                elif body[i] == "?":
                    out, i = out + "[^/]", i + 1
                elif body[i] == "[" and "]" in body[i + 2 :]:
                    j = body.index("]", i + 2)
                    out, i = out + "[" + body[i + 1 : j].replace("!", "^", 1 if body[i + 1] == "!" else 0) + "]", j + 1
                else:
                    out, i = out + re.escape(body[i]), i + 1
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + out), no, only))

    def matches(self, rel: str, folder: bool) -> bool:
        hit = False
        for rx, no, only in self.rules:
            if (folder or not only) and rx.fullmatch(rel):
                hit = not no
        return hit

    def ignored(self, rel: str) -> bool:
        """Whether a file or one of its folders is ignored."""
        parts = rel.split("/")
        return any(self.matches("/".join(parts[:k]), True) for k in range(1, len(parts))) or self.matches(rel, False)


def extension(rel: Column) -> Column:
    return F.lower(F.regexp_extract(rel, r"(\.[^./]*)$", 1))


def language(rel: Column) -> Column:
    """Language by extension, null for other files."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(known, extension(rel))


def sources(files: DataFrame, ignore: str = "") -> DataFrame:
    """Of files with ``rel_path``, those with a known ``lang`` outside skipped folders that the ignore file's text lets pass."""
    kept = files.withColumn("lang", language(F.col("rel_path"))).where(F.col("lang").isNotNull() & ~_under(F.col("rel_path"), SKIP))
    if not ignore.strip():
        return kept

    @F.pandas_udf("boolean")
    def passes(paths: pd.Series) -> pd.Series:
        own = Ignore(ignore)
        return paths.map(lambda x: not own.ignored(x))

    return kept.where(passes("rel_path"))


def statements(files: DataFrame) -> DataFrame:
    """Of files with ``rel_path`` and ``length``, those that may state endpoints."""
    name = F.regexp_extract("rel_path", "([^/]*)$", 1)
    known = extension(F.col("rel_path")).isin(CONTRACT_EXT) | name.isin(CONTRACT_NAMES)
    return files.where(known & ~_under(F.col("rel_path"), CONTRACT_SKIP) & (F.col("length") <= MOST))


def scan(spark: SparkSession, root: str, graph: str, gitignore: bool = True) -> DataFrame:
    """Source files ``graph, path, rel_path, lang, length, content`` without skipped folders and, by the
    ignore file at the root, without ignored files."""
    files = read_files(spark, root, graph)
    rules = files.where("rel_path = '.gitignore'").select("content").head(1) if gitignore else []
    text = bytes(rules[0]["content"]).decode("utf-8", "replace") if rules else ""
    return sources(files, text).select("graph", "path", "rel_path", "lang", "length", "content")


def contract_files(spark: SparkSession, root: str, graph: str) -> DataFrame:
    """Files that may state endpoints, ``graph, file, text``: more kinds, up to 1 MiB, whatever is ignored."""
    return statements(read_files(spark, root, graph)).select("graph", F.col("rel_path").alias("file"), F.col("content").cast("string").alias("text"))
