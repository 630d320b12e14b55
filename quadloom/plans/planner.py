"""Plans over tiles, layers, sources and resources.

Dimension tables (layers, sources, sprites) are compiled from one style document, whose size is limited
(``Limits.style_bytes``), so they are broadcast; facts (tiles, resources, features) are joined on their
computed keys (source, z, x, y) and never broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions import identity, tiles
from quadloom.types import EngineError


def duplicate_tiles(requested: DataFrame) -> DataFrame:
    """Tiles asked for more than once."""
    return requested.groupBy("z", "x", "y").count().filter("count > 1")


def active_layers(requested: DataFrame, layers: DataFrame) -> DataFrame:
    """Each tile with the layers whose zoom range [min_zoom, max_zoom) holds it."""
    return requested.join(F.broadcast(layers), (F.col("z") >= F.col("min_zoom")) & (F.col("z") < F.col("max_zoom")))


def within_bounds(rows: DataFrame, west: Column, south: Column, east: Column, north: Column) -> DataFrame:
    return rows.filter(tiles.intersects(tiles.bounds(F.col("z"), F.col("x"), F.col("y")), west, south, east, north))


def samples(planned: DataFrame, sources: DataFrame) -> DataFrame:
    """Each planned (tile, source_id) with the source tile that covers it, where source bounds allow."""
    joined = planned.join(F.broadcast(sources.withColumnRenamed("min_zoom", "source_min").withColumnRenamed("max_zoom", "source_max")), "source_id")
    kept = within_bounds(joined.filter("z >= source_min"), *(F.col(c) for c in ("west", "south", "east", "north")))
    return kept.withColumns(tiles.covering(F.col("z"), F.col("x"), F.col("y"), F.col("source_max")))


def representatives(sampled: DataFrame, identity_: str, order: str) -> DataFrame:
    """One sample of each identity, the last by ``order``: what is acquired once for all."""
    rest = [c for c in sampled.columns if c != identity_]
    return sampled.groupBy(identity_).agg(F.max_by(F.struct(*rest), order).alias("s")).select(identity_, "s.*")


def fallback(wanted: DataFrame, stored: DataFrame, max_distance: int = 2) -> DataFrame:
    """What serves each (source_id, z, x, y): itself, its four children if all are there, else its nearest
    ancestor within ``max_distance``. Adds via (exact, children, ancestor or missing), distance and digests.

    Candidate keys are exploded from the wanted tiles and joined once, so the stored table is shuffled
    once; the rank window runs over at most 7 rows of a tile.
    """
    keys = ["source_id", "z", "x", "y"]
    c = F.col
    exact = F.array(F.struct(F.lit(0).alias("rank"), c("z").alias("kz"), c("x").cast("long").alias("kx"), c("y").cast("long").alias("ky")))
    kids = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.lit(1).alias("rank"), (c("z") + 1).alias("kz"), (c("x") * 2 + i % 2).cast("long").alias("kx"), (c("y") * 2 + F.call_function("div", i, F.lit(2))).cast("long").alias("ky")))
    ups = F.array(*(F.struct(F.lit(1 + d).alias("rank"), (c("z") - d).alias("kz"), tiles.idiv(c("x"), F.lit(1 << d)).alias("kx"), tiles.idiv(c("y"), F.lit(1 << d)).alias("ky")) for d in range(1, max_distance + 1)))
    wide = wanted.select(*keys).distinct().withColumn("k", F.explode(F.concat(exact, kids, ups))).select(*keys, "k.*")
    have = stored.select("source_id", F.col("z").alias("kz"), F.col("x").cast("long").alias("kx"), F.col("y").cast("long").alias("ky"), "digest")
    hits = wide.join(have, ["source_id", "kz", "kx", "ky"], "left")
    per = hits.groupBy(*keys, "rank").agg(F.count("digest").alias("n"), F.array_sort(F.collect_list(F.struct("ky", "kx", "digest"))).alias("found"))
    whole = per.filter(F.col("n") == F.when(F.col("rank") == 1, 4).otherwise(1))
    best = whole.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).filter("r = 1")
    out = wanted.join(best.select(*keys, "rank", "found"), keys, "left")
    via = F.when(F.col("rank").isNull(), "missing").when(F.col("rank") == 0, "exact").when(F.col("rank") == 1, "children").otherwise("ancestor")
    return out.select(*wanted.columns, via.alias("via"), F.when(F.col("rank") >= 2, F.col("rank") - 1).alias("distance"), F.transform("found", lambda f: f.digest).alias("digests"))


def eligible(resource_class: Column, status: Column) -> Column:
    """Whether a failed acquisition may be substituted."""
    return resource_class.isin("VECTOR_TILE", "RASTER_TILE", "DEM_TILE") & (status.isNull() | status.isin(404, 408, 429) | (status >= 500))


def failed_tiles(outcomes: DataFrame) -> DataFrame:
    """The number of distinct output tiles with a failure, and of those that can't be substituted."""
    key = F.struct("z", "x", "y")
    return outcomes.filter("failed").agg(F.countDistinct(key).alias("failed_tiles"), F.countDistinct(F.when(~eligible(F.col("class"), F.col("status")), key)).alias("fatal_tiles"))


def check_budget(outcomes: DataFrame, budget: int) -> None:
    """All or nothing: EngineError where failures can't be substituted or exceed the budget."""
    row = failed_tiles(outcomes).first()
    if row.fatal_tiles:
        raise EngineError("BATCH_RENDER_FAILED", f"{row.fatal_tiles} tiles failed for good")
    if row.failed_tiles > budget:
        raise EngineError("TILE_SUBSTITUTION_LIMIT_EXCEEDED", f"{row.failed_tiles} tiles failed; {budget} may be substituted")


def content_keys(resources: DataFrame, style_digest: str, size: int = 512) -> DataFrame:
    """A key for each tile (z, x, y) from its resources (kind, identity, digest), whatever their order.
    A tile has a bounded number of resources: one for each of the style's sources."""
    header = F.concat_ws("\n", F.lit(identity.OUTPUT_VERSION), F.lit(style_digest), F.concat_ws("/", F.col("z"), tiles.canonical_x(F.col("x"), F.col("z")), F.col("y")), F.lit(str(size)))
    grouped = resources.groupBy("z", "x", "y").agg(F.collect_set(F.struct("kind", "identity", "digest")).alias("r"))
    return grouped.select("z", "x", "y", identity.content_key(header, F.col("r")).alias("content_key"))


def recoverable(substituted: DataFrame, arrived: DataFrame, keys: list[str]) -> DataFrame:
    """Arrived resources that replace a substitute."""
    return arrived.join(substituted.select(*keys).distinct(), keys, "left_semi")


def still_substituted(substituted: DataFrame, arrived: DataFrame, keys: list[str]) -> DataFrame:
    return substituted.join(arrived.select(*keys).distinct(), keys, "left_anti")


def missing_from(requested: DataFrame, batch: DataFrame) -> DataFrame:
    """Requested tiles that the batch doesn't hold (an error unless empty)."""
    return requested.join(batch.select("z", "x", "y").distinct(), ["z", "x", "y"], "left_anti")


def merged_children(features: DataFrame) -> DataFrame:
    """Layers of four child tiles (child 0 to 3) as one: the extent of the first child that has the layer,
    features in order of child and ordinal, coordinates in the parent's extent. Children of several sources and
    parents (source_id, parent_z, parent_x, parent_y, where there) are kept apart."""
    keys = [k for k in ("source_id", "parent_z", "parent_x", "parent_y", "layer") if k in features.columns]
    extents = features.groupBy(*keys).agg(F.min_by("extent", "child").alias("parent_extent"))
    place = Window.partitionBy(*keys).orderBy("child", "ord")
    moved = features.join(extents, keys)
    q = lambda c, quadrant: tiles.rescaled(c, F.col("extent"), F.col("parent_extent"), quadrant).cast("int")
    dx, dy = F.col("child") % 2, F.call_function("div", F.col("child"), F.lit(2))
    parts = F.transform("parts", lambda part: F.transform(part, lambda p: F.struct(q(p.x, dx).alias("x"), q(p.y, dy).alias("y"))))
    return moved.withColumns({"parts": parts, "ord": F.row_number().over(place) - 1}).withColumn("extent", F.col("parent_extent")).drop("parent_extent")
