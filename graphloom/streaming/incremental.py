"""Incremental builds: only changed files are parsed again; a file stream for services."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.assemble import merge


def hashes(files: DataFrame) -> DataFrame:
    return files.select("graph", "rel_path", F.sha2("content", 256).alias("sha256"))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or whose content differs from ``known(graph, rel_path, sha256)``."""
    return files.withColumn("sha256", F.sha2("content", 256)).join(known, ["graph", "rel_path", "sha256"], "left_anti").drop("sha256")


def gone(files: DataFrame, known: DataFrame) -> DataFrame:
    return known.select("graph", "rel_path").join(files.select("graph", "rel_path"), ["graph", "rel_path"], "left_anti")


def refresh(old_facts: DataFrame, files: DataFrame, known: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Facts after a change: those of changed files anew, those of files that went dropped, the rest as they were."""
    new = changed(files, known)
    stale = new.select("graph", F.col("rel_path").alias("file")).union(gone(files, known))
    return old_facts.join(stale, ["graph", "file"], "left_anti").unionByName(parse(new))


def watch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A stream of ``binaryFile`` rows in micro-batches; ``sink`` merges each into the stored tables."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    return merge(stored, batch, keys)
