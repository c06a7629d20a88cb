"""Call resolution: names to definitions, selectors to modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import expr as X

DEFINITIONS = ["function", "method", "class"]


def label_index(defs: DataFrame) -> DataFrame:
    """One row per label that is defined in a single file: ``graph, label, target``. Labels meet calls only
    as one row each, so a name like ``main`` doesn't fan out."""
    named = defs.where(F.col("kind").isin(DEFINITIONS)).groupBy("graph", "label")
    return named.agg(F.countDistinct("file").alias("files"), F.min("id").alias("target")).where("files = 1").select("graph", "label", "target")


def resolve_bare(defs: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls without a dot, to the one file that defines the label."""
    bare = calls.where(X.selector("callee").isNull())
    hit = bare.join(label_index(defs).withColumnRenamed("label", "callee"), ["graph", "callee"])
    return hit.select("graph", F.col("from_id").alias("src"), F.col("target").alias("dst"), F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"))


def resolve_selector(modules: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls through an imported name, to that import's module: exactly one import entry must match."""
    own = F.filter("imports", lambda i: X.import_base(i) == X.selector("callee"))
    hit = calls.where(X.selector("callee").isNotNull()).withColumn("own", own).where(F.size("own") == 1).withColumn("imp", F.get("own", 0))
    # ids are made once for each import, not for each call
    module = hit.select("graph", "imp").distinct().withColumn("dst", X.node_id(F.concat(F.lit("module:"), F.col("imp")), X.import_base("imp")))
    known = modules.where("kind = 'module'").select("graph", F.col("id").alias("dst"))
    module = module.join(known, ["graph", "dst"], "left_semi")
    return hit.join(module, ["graph", "imp"]).select("graph", F.col("from_id").alias("src"), "dst", F.lit("calls").alias("relation"), F.lit("EXTRACTED").alias("confidence"))


def resolve(defs: DataFrame, calls: DataFrame) -> DataFrame:
    return resolve_bare(defs, calls).unionByName(resolve_selector(defs, calls)).distinct()
