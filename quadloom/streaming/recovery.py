"""Recovery of substituted tiles as exact resources arrive on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["source_id", "z", "x", "y"]


def recover(substituted: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recovered, still substituted): an arrival counts if its bytes have its digest, and only for a tile that
    is substituted; the first by arrival time, then digest, wins."""
    good = arrived.filter(F.sha2("bytes", 256) == F.col("digest"))
    first = good.groupBy(*KEYS).agg(F.min_by(F.struct("bytes", "digest"), F.struct("at", "digest")).alias("a"))
    recovered = first.join(substituted.select(*KEYS).distinct(), KEYS, "left_semi").select(*KEYS, "a.bytes", "a.digest")
    return recovered, substituted.join(recovered.select(*KEYS), KEYS, "left_anti")


def recovery_stream(arrivals: DataFrame, substituted: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of recovered tiles, each once: arrivals (source_id, z, x, y, bytes, digest, at) that replace a
    substitute. Repeats within ``late`` are dropped by state that the watermark bounds."""
    good = arrivals.filter(F.sha2("bytes", 256) == F.col("digest")).withWatermark("at", late)
    return good.join(substituted.select(*KEYS).distinct(), KEYS, "left_semi").dropDuplicatesWithinWatermark(KEYS)


def start(arrivals: DataFrame, substituted: DataFrame, sink: str, checkpoint: str):
    """Writes recovered tiles to a Parquet sink; what fails keeps its substitute."""
    return recovery_stream(arrivals, substituted).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Arrivals for each window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
