"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import dropped, stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, label (the smallest id that is reachable) for every node that isn't its own label.
    Each step is written to the shared folder; nothing but a count reaches the driver."""
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    while not stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u").select("u", "v", "m")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = stored(small.distinct(), "edges")
        dropped(e)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


def stars(e: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: nothing is left to do then."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select("v", F.lit(0), F.lit(1)).toDF("node", "out", "into"))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.filter("out > 1 OR (out = 1 AND into = 1)").limit(1).count() == 0
