"""Sessions: prepared styles and batches, their ownership and lifetime, export, exact recovery and metrics.

An Engine owns what it prepared. A batch holds its acquired resources as a written table, so a lost executor or a
failed render never fetches again.
"""

from __future__ import annotations

import threading
import uuid
from collections import Counter
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import style
from quadloom.functions import tiles
from quadloom.plans import planner
from quadloom.sources import mvt, store
from quadloom.types import METRICS, EngineError


#: The resource class of each kind of source that has tiles; GeoJSON is part of the style.
CLASSES = {"vector": "VECTOR_TILE", "raster": "RASTER_TILE", "raster-dem": "DEM_TILE"}


class SingleFlight:
    """One computation for all callers of a key that come while it runs."""

    def __init__(self):
        self._lock, self._running = threading.Lock(), {}

    def run(self, key, compute: Callable):
        with self._lock:
            mine = key not in self._running
            flight = self._running.setdefault(key, Future())
        if mine:
            try:
                flight.set_result(compute())
            except BaseException as e:
                flight.set_exception(e)
            finally:
                with self._lock:
                    self._running.pop(key, None)
        return flight.result()


class Batch:
    """Acquired tiles of a style: ``resources`` (source_id, kind, class, z, x, y, data, digest) by output tile.
    Tiles that failed within the budget have null data: nothing is put in their place."""

    def __init__(self, engine: Engine, program: style.Prepared, requested: DataFrame, resources: DataFrame):
        self.engine, self.program, self.requested, self.resources = engine, program, requested, resources
        self.closed, self.leases = False, 0

    def _open(self) -> None:
        if self.closed:
            raise EngineError("PREPARED_BATCH_CLOSED", "the batch is closed")

    def features(self, wanted: list[str] | None = None) -> DataFrame:
        self._open()
        return mvt.decode_tiles(self.resources.filter("kind = 'vector' AND data IS NOT NULL").dropDuplicates(["source_id", "z", "x", "y"]), wanted)

    def content_keys(self, size: int = 512) -> DataFrame:
        self._open()
        rows = self.resources.filter("digest IS NOT NULL").select(F.col("out_z").alias("z"), F.col("out_x").alias("x"), F.col("out_y").alias("y"), F.when(F.col("kind") == "vector", "vector").otherwise("raster").alias("kind"), F.concat_ws("/", "source_id", "z", "x", "y").alias("identity"), "digest")
        return planner.content_keys(rows, self.program.digest, size)

    def subset(self, asked: DataFrame) -> DataFrame:
        """The asked tiles; an error where one isn't in the batch."""
        self._open()
        if planner.missing_from(asked, self.requested).limit(1).count():
            raise EngineError("TILE_NOT_IN_PREPARED_BATCH", "a tile isn't in the batch")
        return asked

    def retry_exact(self) -> DataFrame:
        """Fetches again what failed, and returns the diagnostics of what recovered; the rest stays as it was."""
        self._open()
        lost = self.resources.filter("data IS NULL")
        wanted = lost.select("stable_id", "class", "url").distinct()
        got = store.acquire(wanted, self.engine.store, self.engine.transport).filter("bytes IS NOT NULL").select("stable_id", "class", "bytes", F.col("digest").alias("new_digest"))
        merged = self.resources.join(got, ["stable_id", "class"], "left").withColumns({"data": F.coalesce("data", "bytes"), "digest": F.coalesce("digest", "new_digest"), "recovered": F.col("bytes").isNotNull()})
        kept = self.engine.written(merged.drop("bytes", "new_digest"))
        self.resources = kept.drop("recovered")
        rows = kept.filter("recovered")
        self.engine.metrics["TILE_EXACT_RECOVERED"] += rows.count()
        return rows.select(F.lit("TILE_EXACT_RECOVERED").alias("code"), F.lit("INFO").alias("severity"), "out_z", "out_x", "out_y")

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Batch:
        self._open()
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Engine:
    """Prepares styles and batches over a raw store and a host's transport."""

    def __init__(self, spark: SparkSession, path: str, transport: store.Transport | None = None):
        self.spark, self.path, self.transport = spark, path, transport
        self.store, self.flights, self.closed = store.RawStore(spark, f"{path}/raw"), SingleFlight(), False
        self.metrics: Counter = Counter(dict.fromkeys(METRICS, 0))

    def _open(self) -> None:
        if self.closed:
            raise EngineError("RASTERIZER_CLOSED", "the engine is closed")

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def prepare(self, document: bytes | str | dict, **options) -> style.Prepared:
        self._open()
        made = style.prepare(document, **options)
        made.owner = self
        return made

    def prepare_url(self, url: str, **options) -> style.Prepared:
        """A style fetched through the transport; it isn't cached."""
        self._open()
        status, body = store.exchange(self.transport, url)
        if body is None:
            raise EngineError("RESOURCE_ACQUISITION_FAILED", f"style: status {status}")
        return self.prepare(body, base_url=url, **options)

    def prepare_batch(self, program: style.Prepared, requested: DataFrame, mode: str = "NORMAL", budget: int = 0) -> Batch:
        """Acquires the vector, raster and elevation tiles of the requested tiles; failures beyond the budget, over
        all of them, fail the batch, after what was fetched has been stored."""
        self._check(program, requested)
        return Batch(self, program, requested, self._acquired(self._sampled(program, requested, list(CLASSES)), mode, budget))

    def _check(self, program: style.Prepared, requested: DataFrame) -> None:
        self._open()
        if program.owner is not self:
            raise EngineError("FOREIGN_PREPARED_STYLE", "the style is another engine's")
        if planner.duplicate_tiles(requested).limit(1).count() or requested.filter(~tiles.valid(F.col("z"), F.col("y"))).limit(1).count():
            raise EngineError("INVALID_TILE_ID", "repeated or invalid tiles")

    def _sampled(self, program: style.Prepared, requested: DataFrame, kinds: list[str]) -> DataFrame:
        """The source tiles of the layers that are active; a hillshade also reads the eight around its own."""
        layers, sources, _ = program.tables(self.spark)
        used = layers.filter("source_id IS NOT NULL").select("source_id", "min_zoom", "max_zoom")
        active = planner.active_layers(requested, used).select("z", "x", "y", "source_id").distinct()
        sampled = planner.samples(active, sources.filter(F.col("kind").isin(kinds)))
        steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
        own = F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy")))
        side = tiles.pow2(F.col("source_z"))
        around = sampled.withColumn("step", F.explode(F.when(F.col("kind") == "raster-dem", steps).otherwise(own)))
        around = around.withColumns({"source_x": F.pmod(F.col("source_x") + F.col("step.dx"), side), "source_y": F.col("source_y") + F.col("step.dy")})
        return around.filter((F.col("source_y") >= 0) & (F.col("source_y") < side)).drop("step").dropDuplicates(["z", "x", "y", "source_id", "source_z", "source_x", "source_y"])

    def _acquired(self, sampled: DataFrame, mode: str, budget: int) -> DataFrame:
        url = tiles.tile_url(F.col("templates"), F.col("source_z"), F.col("source_x"), F.col("source_y"), F.col("scheme") == "tms")
        kind_class = F.create_map(*(F.lit(v) for pair in CLASSES.items() for v in pair))[F.col("kind")]
        wanted = sampled.withColumns({"url": url, "class": kind_class}).withColumn("stable_id", store.stable_id(F.col("url")))
        rows = wanted.select(F.col("z").alias("out_z"), F.col("x").alias("out_x"), F.col("y").alias("out_y"), "source_id", "kind", "encoding", F.col("source_z").alias("z"), F.col("source_x").alias("x"), F.col("source_y").alias("y"), "child_scale", "child_x", "child_y", "class", "url", "stable_id")
        asked = rows.select("stable_id", "class", "url").distinct()
        got = self.written(store.acquire(asked, self.store, self.transport, mode))
        counted = {r.from_cache: r["count"] for r in got.groupBy("from_cache").count().collect()}
        self.metrics["RAW_CACHE_HIT"] += counted.get(True, 0)
        self.metrics["RAW_CACHE_MISS"] += counted.get(False, 0)
        joined = rows.join(got.select("stable_id", "class", F.col("bytes").alias("data"), "digest", "status"), ["stable_id", "class"])
        outcomes = joined.select(F.col("out_z").alias("z"), F.col("out_x").alias("x"), F.col("out_y").alias("y"), F.col("data").isNull().alias("failed"), "class", "status")
        planner.check_budget(outcomes, budget)
        return self.written(joined)

    def label_tiles(self, program: style.Prepared, requested: DataFrame, mode: str = "NORMAL") -> DataFrame:
        """The bytes of the requested vector tiles: all of them, or an error."""
        self._check(program, requested)
        return self._acquired(self._sampled(program, requested, ["vector"]), mode, 0).select("source_id", "z", "x", "y", "data", "digest").distinct()

    def terrain_tiles(self, program: style.Prepared, requested: DataFrame, mode: str = "NORMAL") -> DataFrame:
        """The style's terrain: the elevation tile of each requested tile (out_z, out_x, out_y, source_id, z, x, y,
        encoding, data, digest), all of them or an error; no rows without a terrain."""
        self._check(program, requested)
        t = program.terrain
        row = [(t["source_id"], t["kind"], t["templates"], t["scheme"], t["min_zoom"], t["max_zoom"], *t["bounds"], t["tile_size"], t.get("encoding"))] if t else []
        source = self.spark.createDataFrame(row, program.tables(self.spark)[1].schema)
        sampled = planner.samples(requested.select("z", "x", "y").crossJoin(source.select("source_id")), source)
        return self._acquired(sampled, mode, 0).select("out_z", "out_x", "out_y", "source_id", "z", "x", "y", "encoding", "data", "digest")

    def close(self) -> None:
        self.closed = True
