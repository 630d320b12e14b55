"""Tile addressing as integer and mercator Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LATITUDE = 85.0511287798066
EXTENT = 4096
EARTH_CIRCUMFERENCE = 40_075_016.68557849


def pow2(z: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int"))


def idiv(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("long"), b.cast("long"))


def canonical_x(x: Column, z: Column) -> Column:
    """x wraps around the world."""
    return F.pmod(x.cast("long"), pow2(z))


def valid(z: Column, y: Column, low: int = 0, high: int = 22) -> Column:
    """The zoom is in the policy's range and y on the map; x may be anything."""
    return (z >= low) & (z <= high) & (y >= 0) & (y < pow2(z))


def covering(z: Column, x: Column, y: Column, max_zoom: Column) -> dict[str, Column]:
    """The source tile that covers an output tile, at most at ``max_zoom``, and the output's place in it."""
    source_z = F.least(z, max_zoom)
    scale = pow2(z - source_z)
    wrapped = canonical_x(x, z)
    return {
        "source_z": source_z.cast("int"), "source_x": idiv(wrapped, scale), "source_y": idiv(y, scale),
        "child_scale": scale, "child_x": F.pmod(wrapped, scale), "child_y": F.pmod(y.cast("long"), scale),
    }


def children(rows: DataFrame, max_zoom: int = 22) -> DataFrame:
    """The four tiles of the next zoom, row by row (``child`` from 0 to 3); none from ``max_zoom`` on."""
    grid = rows.filter(F.col("z") < max_zoom).withColumn("child", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return grid.withColumns({"child_z": F.col("z") + 1, "child_tile_x": F.col("x") * 2 + F.col("child") % 2, "child_tile_y": F.col("y") * 2 + F.call_function("div", F.col("child"), F.lit(2))})


def ancestor(z: Column, x: Column, y: Column, distance: int, scale: Column | None = None, child_x: Column | None = None, child_y: Column | None = None) -> dict[str, Column]:
    """The tile ``distance`` zooms up, and where a window of the tile lies in it."""
    step = 1 << distance
    scale, child_x, child_y = scale if scale is not None else F.lit(1).cast("long"), child_x if child_x is not None else F.lit(0).cast("long"), child_y if child_y is not None else F.lit(0).cast("long")
    return {
        "ancestor_z": (z - distance).cast("int"), "ancestor_x": idiv(x, F.lit(step)), "ancestor_y": idiv(y, F.lit(step)), "ancestor_scale": scale * step,
        "window_x": F.pmod(x.cast("long"), F.lit(step)) * scale + child_x, "window_y": F.pmod(y.cast("long"), F.lit(step)) * scale + child_y,
    }


def neighbours(rows: DataFrame, reach: int = 1) -> DataFrame:
    """The tiles around (and at) each tile: x wraps, y does not."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    grid = rows.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
    placed = grid.withColumns({"nx": canonical_x(F.col("x") + F.col("dx"), F.col("z")), "ny": (F.col("y") + F.col("dy")).cast("long")})
    return placed.filter((F.col("ny") >= 0) & (F.col("ny") < pow2(F.col("z"))))


def tile_url(templates: Column, z: Column, x: Column, y: Column, tms: Column) -> Column:
    """The template chosen by (31 z + 17 x + y) modulo their number, with z, x and y filled in; the tms
    scheme turns y around, and {-y} is the other one."""
    wrapped = canonical_x(x, z)
    flipped = pow2(z) - 1 - y
    template = F.element_at(templates, (F.pmod(z * 31 + wrapped * 17 + y, F.size(templates)) + 1).cast("int"))
    own = F.when(tms, flipped).otherwise(y.cast("long"))
    out = F.replace(F.replace(template, F.lit("{z}"), z.cast("string")), F.lit("{x}"), wrapped.cast("string"))
    return F.replace(F.replace(out, F.lit("{-y}"), flipped.cast("string")), F.lit("{y}"), own.cast("string"))


def bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """West, south, east and north in degrees."""
    n = pow2(z)
    latitude = lambda v: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * v / n))))
    return {"west": canonical_x(x, z) / n * 360 - 180, "south": latitude(y + 1), "east": (canonical_x(x, z) + 1) / n * 360 - 180, "north": latitude(y)}


def intersects(tile: dict[str, Column], west: Column, south: Column, east: Column, north: Column) -> Column:
    """Touching counts; a west edge east of the east edge spans the antimeridian."""
    tall = (tile["north"] >= south) & (tile["south"] <= north)
    wide = F.when(west <= east, (tile["east"] >= west) & (tile["west"] <= east)).otherwise((tile["east"] >= west) | (tile["west"] <= east))
    return tall & wide


def world_x(lon: Column) -> Column:
    return (lon + 180) / 360


def world_y(lat: Column) -> Column:
    s = F.sin(F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat))))
    return 0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)


def tile_of(lon: Column, lat: Column, z: Column) -> tuple[Column, Column]:
    n = pow2(z)
    last = n - 1
    at = lambda w: F.greatest(F.lit(0), F.least(last, F.floor(w * n))).cast("long")
    return at(world_x(lon)), at(world_y(lat))


def to_pixels(px: Column, extent: Column | int, scale: Column, child: Column, size: int) -> Column:
    """A source tile coordinate in output pixels."""
    return (px / extent * scale - child) * size


def shoelace(ring: Column) -> Column:
    """Twice the signed area of a ring of <x, y> points (closed or not)."""
    n = F.size(ring)
    after = F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, after, lambda p, q: p.x.cast("long") * q.y - q.x.cast("long") * p.y), F.lit(0).cast("long"), lambda a, v: a + v)


def rescaled(c: Column, extent_from: Column, extent_to: Column, quadrant: Column) -> Column:
    """A child tile's coordinate in its parent's extent, rounded half up."""
    return F.floor((quadrant * extent_to + c * extent_to / extent_from) / 2 + 0.5).cast("long")


def metres_per_pixel(world_y_: Column, z: Column, size: int) -> Column:
    latitude = F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * world_y_)))
    return F.greatest(F.lit(0.01), F.lit(EARTH_CIRCUMFERENCE) * F.cos(latitude) / (pow2(z) * size))


def clip_segment(x0: Column, y0: Column, x1: Column, y1: Column, low: float = -0.125, high: float = 1.125) -> dict[str, Column]:
    """The part of a segment in the square [low, high] (tile units) by its entering and leaving parameter;
    ``inside`` is false where nothing is left."""
    dx, dy = x1 - x0, y1 - y0

    def edges(p: Column, d: Column) -> tuple[Column, Column, Column]:
        a, b = (low - p) / F.when(d != 0, d), (high - p) / F.when(d != 0, d)
        still = F.when(d == 0, (p >= low) & (p <= high)).otherwise(F.lit(True))
        return F.coalesce(F.least(a, b), F.lit(0.0)), F.coalesce(F.greatest(a, b), F.lit(1.0)), still

    ax, bx, okx = edges(x0, dx)
    ay, by, oky = edges(y0, dy)
    t0, t1 = F.greatest(F.lit(0.0), ax, ay), F.least(F.lit(1.0), bx, by)
    return {"cx0": x0 + dx * t0, "cy0": y0 + dy * t0, "cx1": x0 + dx * t1, "cy1": y0 + dy * t1, "inside": okx & oky & (t0 <= t1)}
