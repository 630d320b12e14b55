"""Order and geometry of lines as window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def draw_order(rows: DataFrame, by: list[str], sort_key: str, ordinal: str) -> DataFrame:
    """Adds draw_order (from 1): by sort key (null counts as 0), then ordinal."""
    w = Window.partitionBy(*by).orderBy(F.coalesce(F.col(sort_key).cast("double"), F.lit(0.0)), ordinal)
    return rows.withColumn("draw_order", F.row_number().over(w))


def segments(vertices: DataFrame, by: list[str], ordinal: str, x: str, y: str) -> DataFrame:
    """One row per consecutive pair of vertices: length, and start (the length of the line before it)."""
    w = Window.partitionBy(*by).orderBy(ordinal)
    pairs = vertices.withColumns({"nx": F.lead(x).over(w), "ny": F.lead(y).over(w)}).filter("nx IS NOT NULL")
    dx, dy = F.col("nx") - F.col(x), F.col("ny") - F.col(y)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return pairs.withColumn("length", F.sqrt(dx * dx + dy * dy)).withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0.0)))
