"""GeoJSON: documents of LineStrings to features, and their projection into virtual tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import tiles
from quadloom.functions.expr import TAGGED

LAYER = "__geojson__"
FEATURE = "struct<type:string,id:string,properties:string,geometry:struct<type:string,coordinates:array<array<double>>>>"


def properties_of(json: Column) -> Column:
    """A JSON object of scalars as a map of tagged values; other values are left out."""
    raw = F.from_json(json, "map<string,variant>")
    kind = lambda v: F.schema_of_variant(v)

    def tagged(k, v):
        t = kind(v)
        number = t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
        code = F.when(t == "VOID", 0).when(t == "BOOLEAN", 1).when(number, 2).when(t == "STRING", 3)
        return F.struct(
            code.cast("tinyint").alias("t"),
            F.when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).alias("b"),
            F.when(number, F.try_variant_get(v, "$", "double")).alias("n"),
            F.when(t == "STRING", F.try_variant_get(v, "$", "string")).alias("s"),
        )

    return F.map_filter(F.transform_values(raw, tagged), lambda k, v: v.t.isNotNull()).cast(f"map<string,{TAGGED}>")


def read_lines(docs: DataFrame, text: str = "json") -> DataFrame:
    """Features of FeatureCollections, Features and bare LineStrings: ord, props and coordinates, and ``problem``
    where a feature isn't a LineString of at least two finite 2-D positions on the globe."""
    j = F.col(text)
    one = F.from_json(j, "struct<type:string>")["type"]
    many = F.from_json(j, f"struct<features:array<{FEATURE}>>")["features"]
    feature = F.from_json(j, FEATURE)
    bare = F.struct(F.lit("Feature").alias("type"), F.lit(None).cast("string").alias("id"), F.lit("{}").alias("properties"), F.from_json(j, "struct<type:string,coordinates:array<array<double>>>").alias("geometry")).cast(FEATURE)
    rows = docs.withColumn("kind", one).withColumn("all", F.when(F.col("kind") == "FeatureCollection", many).when(F.col("kind") == "Feature", F.array(feature)).otherwise(F.array(bare)))
    flat = rows.select(*docs.columns, F.posexplode("all").alias("ord", "f"))
    line = F.col("f.geometry.coordinates")
    off = lambda p: (F.size(p) != 2) | p[0].isNull() | p[1].isNull() | (F.abs(p[0]) > 180) | (F.abs(p[1]) > 90)
    problem = F.when(F.coalesce(F.col("f.geometry.type"), F.lit("")) != "LineString", "not a LineString").when(F.coalesce(F.size(line), F.lit(0)) < 2, "too short").when(F.exists(line, off), "bad position")
    return flat.select(*docs.columns, "ord", properties_of(F.coalesce("f.properties", F.lit("{}"))).alias("props"), line.alias("coordinates"), problem.alias("problem"))


def project(lines: DataFrame, z: int, key: list[str], extent: int = tiles.EXTENT) -> DataFrame:
    """Segments of the lines in the tiles of zoom z that they touch (an eighth of a tile beyond the edges
    included): layer, tile and clipped end points on the extent's grid; points are dropped.

    Longitudes are unwrapped along the shortest way over the antimeridian, and the line is laid out in
    three copies of the world. A segment goes only to the tiles of its bounding box.
    """
    n = 1 << z
    span = F.array_max(F.transform("coordinates", lambda p: p[0])) - F.array_min(F.transform("coordinates", lambda p: p[0]))

    def onward(acc, p):
        last = F.element_at(acc, -1)
        turn = F.when(F.col("span") >= 359.999, F.lit(0.0)).otherwise(F.floor((p[0] - last["lon"] + 180) / 360) * 360)
        return F.array_append(acc, F.struct((p[0] - turn).alias("lon"), p[1].alias("lat")))

    first = F.array(F.struct(F.col("coordinates")[0][0].alias("lon"), F.col("coordinates")[0][1].alias("lat")))
    unwrapped = F.aggregate(F.slice("coordinates", 2, F.size("coordinates")), first, onward)
    rows = lines.withColumn("span", span).withColumn("line", unwrapped).select(*key, "props", F.posexplode(F.arrays_zip(F.slice("line", 1, F.size("line") - 1).alias("a"), F.slice("line", 2, F.size("line")).alias("b"))).alias("segment", "s"))
    world = rows.withColumn("copy", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    at = lambda p: ((tiles.world_x(F.col(p + ".lon")) + F.col("copy")) * n, tiles.world_y(F.col(p + ".lat")) * n)
    (x0, y0), (x1, y1) = at("s.a"), at("s.b")
    wide = world.select(*key, "props", "segment", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    reach = lambda a, b: F.sequence(F.greatest(F.lit(0), F.floor(F.least(a, b) - 0.125)), F.greatest(F.lit(-1), F.least(F.lit(n - 1), F.floor(F.greatest(a, b) + 0.125))), F.lit(1))
    some = (F.greatest("x0", "x1") >= -0.125) & (F.least("x0", "x1") < n + 0.125)
    tiled = wide.filter(some & (F.greatest(F.lit(0), F.floor(F.least("x0", "x1") - 0.125)) <= F.least(F.lit(n - 1), F.floor(F.greatest("x0", "x1") + 0.125)))).withColumn("x", F.explode(reach(F.col("x0"), F.col("x1")))).withColumn("y", F.explode(reach(F.col("y0"), F.col("y1"))))
    cut = tiled.withColumns(tiles.clip_segment(F.col("x0") - F.col("x"), F.col("y0") - F.col("y"), F.col("x1") - F.col("x"), F.col("y1") - F.col("y"))).filter("inside")
    grid = lambda v: F.floor(F.col(v) * extent + 0.5).cast("int")
    out = cut.select(*key, F.lit(LAYER).alias("layer"), F.lit(z).alias("z"), "x", "y", "segment", "props", *(grid(v).alias(v) for v in ("cx0", "cy0", "cx1", "cy1")))
    return out.filter("cx0 <> cx1 OR cy0 <> cy1")
