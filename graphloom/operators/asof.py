"""As-of joins and carried state, as windows: one shuffle, no range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(points: DataFrame, marks: DataFrame, by: list[str], at: str, mark: str, tie: str) -> DataFrame:
    """Points with ``mark``: that of the last mark at or before ``at`` within ``by``; of several there, the
    one of largest ``tie``."""
    p = points.withColumn("__is", F.lit(1)).withColumn("__mark", F.lit(None).cast(marks.schema[mark].dataType)).withColumn("__tie", F.lit(None).cast(marks.schema[tie].dataType))
    m = marks.select(*by, at, F.lit(0).alias("__is"), F.col(mark).alias("__mark"), F.col(tie).alias("__tie"))
    order = Window.partitionBy(*by).orderBy(at, "__is", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(m, allowMissingColumns=True)
    return both.withColumn(mark, F.last("__mark", ignorenulls=True).over(order)).where("__is = 1").drop("__is", "__mark", "__tie")


def carry(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Rows with the last non-null ``value`` up to each."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))
