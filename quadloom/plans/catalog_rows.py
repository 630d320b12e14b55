"""Queries whose operators run Python kernels, and metadata queries, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadloom import style
from quadloom.functions import identity, tiles
from quadloom.operators import placement, render
from quadloom.sources import geojson, metadata, mvt

c = F.col
QUERIES: dict = {}
SQL: dict = {}

STYLE = {
    "version": 8,
    "sources": {"base": {"type": "vector", "tiles": ["https://t.example/{z}/{x}/{y}.mvt?key=secret"], "maxzoom": 14}},
    "layers": [
        {"id": "sky", "type": "background", "paint": {"background-color": "#204060"}},
        {"id": "land", "type": "fill", "source": "base", "source-layer": "land", "filter": ["==", "status", "F"], "paint": {"fill-color": "hsl(120, 50%, 40%)", "fill-opacity": {"stops": [[0, 0.2], [10, 1]]}}},
        {"id": "roads", "type": "line", "source": "base", "source-layer": "land", "filter": ["==", "$type", "LineString"], "paint": {"line-width": ["interpolate", ["linear"], ["get", "price"], 0, 1, 300000, 8], "line-color": "white"}},
    ],
}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def shapes(spark, sf_dir):
    """Orders as features with geometry in pixels of a 256-pixel tile: squares, lines or points by key."""
    from quadloom.plans.catalog import features

    f = features(spark, sf_dir, 3)
    px, py, r = c("o_orderkey") * 37 % 256, c("o_orderkey") * 91 % 256, 4 + c("o_orderkey") % 9
    at = lambda dx, dy: F.struct((px + dx * r).cast("int").alias("x"), (py + dy * r).cast("int").alias("y"))
    parts = F.when(c("geom_type") == "Polygon", F.array(F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1)))).when(c("geom_type") == "LineString", F.array(F.array(at(-2, 0), at(2, 1)))).otherwise(F.array(F.array(at(0, 0))))
    return f.withColumns({"z": F.lit(3), "parts": parts, "layer": F.lit("land"), "source_id": F.lit("base"), "ord": c("o_orderkey")})


@query()
def icon_greedy(spark, sf_dir):
    icons = shapes(spark, sf_dir).withColumns({"layer_order": (c("o_orderkey") % 2).cast("int"), "sort_key": c("o_totalprice"), "spacing": F.lit(40.0), "dx": F.lit(0.0), "dy": F.lit(0.0), "width": F.lit(12.0), "height": F.lit(8.0)})
    boxed = placement.candidates(icons, 256).withColumn("allow_overlap", F.lit(False))
    return placement.place(boxed, ["z", "x", "y"], ["sort_key", "stable_order"]).select("z", "x", "y", "layer_order", "stable_order", F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"))


@query()
def render_tiles(spark, sf_dir):
    """The style over the orders' shapes: a PNG and its brightness for each tile."""
    p = style.prepare(STYLE)
    f = shapes(spark, sf_dir)
    columns = ["z", "x", "y", "layer_order", "draw_order", "op", "rgba", "opacity", "width", "parts"]
    rgba = lambda name: F.array(*(c(name)[k] for k in "rgba"))
    sky, land, roads = p.layers
    tile = f.select("z", "x", "y").distinct()
    empty = F.lit(None).cast("array<array<struct<x:int,y:int>>>")
    back = sky.project(tile.withColumns({"geom_type": F.lit(None).cast("string"), "id": F.lit(None).cast("long"), "props": F.lit(None).cast("map<string,struct<t:tinyint,b:boolean,n:double,s:string>>")}))
    rows = back.select("z", "x", "y", "layer_order", F.lit(0).cast("long").alias("draw_order"), F.lit("background").alias("op"), rgba("background_color").alias("rgba"), c("background_opacity").alias("opacity"), F.lit(0.0).alias("width"), empty.alias("parts"))
    areas = land.project(f).select("z", "x", "y", "layer_order", c("ord").alias("draw_order"), F.lit("fill").alias("op"), rgba("fill_color").alias("rgba"), c("fill_opacity").alias("opacity"), F.lit(0.0).alias("width"), "parts")
    lines = roads.project(f).select("z", "x", "y", "layer_order", c("ord").alias("draw_order"), F.lit("line").alias("op"), rgba("line_color").alias("rgba"), c("line_opacity").alias("opacity"), c("line_width").alias("width"), "parts")
    drawn = rows.unionByName(areas).unionByName(lines).select(columns)
    bright = F.pandas_udf(lambda s: s.map(render.luma), "double")
    return render.render(drawn).select("z", "x", "y", F.sha2("png", 256).alias("digest"), F.round(bright("png"), 6).alias("luma"))


@query("""SELECT count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS ids, count(DISTINCT o_orderstatus) AS statuses FROM orders""")
def mvt_round_trip(spark, sf_dir):
    """Orders encoded as vector tiles by tile and decoded again."""
    import pandas as pd

    f = shapes(spark, sf_dir).filter("TRUE").select("x", "y", "o_orderkey", "geom_type", "parts", "o_orderstatus", "o_totalprice")

    def one(key, g: pd.DataFrame) -> pd.DataFrame:
        made = [{"id": int(r.o_orderkey), "geom_type": r.geom_type, "props": {"status": r.o_orderstatus, "price": float(r.o_totalprice)}, "parts": [[(p["x"], p["y"]) for p in part] for part in r.parts]} for r in g.itertuples(index=False)]
        return pd.DataFrame({"source_id": ["orders"], "z": [3], "x": [key[0]], "y": [key[1]], "data": [mvt.encode([{"name": "land", "features": made}])]})

    encoded = f.groupBy("x", "y").applyInPandas(one, "source_id string, z int, x int, y int, data binary")
    decoded = mvt.decode_tiles(encoded, ["land"])
    return decoded.agg(F.count("*").alias("n"), F.sum(c("id").cast("long")).alias("ids"), F.countDistinct(c("props")["status"]["s"]).alias("statuses"))


@query("""SELECT o_orderkey, 2::BIGINT AS n FROM orders WHERE o_orderkey % 7 <> 0""")
def geojson_lines(spark, sf_dir):
    """A LineString for each order (every seventh is malformed), read and checked."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lon, lat = (c("o_orderkey") % 180).cast("string"), (c("o_orderkey") % 80).cast("string")
    second = F.when(c("o_orderkey") % 7 == 0, "[999,0]").otherwise(F.concat(F.lit("["), lon, F.lit(".5,"), lat, F.lit(".25]")))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"s":"'), c("o_orderstatus"), F.lit('","n":1},"geometry":{"type":"LineString","coordinates":[['), lon, F.lit(","), lat, F.lit("],"), second, F.lit("]}}]}"))
    read = geojson.read_lines(o.select("o_orderkey", text.alias("json")))
    return read.filter("problem IS NULL").select("o_orderkey", F.size("coordinates").cast("long").alias("n"))


@query()
def geojson_tiles(spark, sf_dir):
    """The same lines cut into tiles of zoom 4."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lon, lat = (c("o_orderkey") % 180).cast("double"), (c("o_orderkey") % 80).cast("double")
    line = F.array(F.array(lon, lat), F.array(lon + 40, lat - 20), F.array(lon + 41, lat - 19))
    wrapped = F.transform(line, lambda p: F.array(F.pmod(p[0] + 180, F.lit(360.0)) - 180, p[1]))
    rows = o.select("o_orderkey", F.create_map().cast("map<string,struct<t:tinyint,b:boolean,n:double,s:string>>").alias("props"), wrapped.alias("coordinates"))
    return geojson.project(rows, 4, ["o_orderkey"]).select("o_orderkey", "x", "y", "segment", "cx0", "cy0", "cx1", "cy1")


@query("""SELECT * FROM (VALUES ('sky', 0, 0.0::DOUBLE, 31.0::DOUBLE), ('land', 1, 0.0, 31.0), ('roads', 2, 0.0, 31.0)) AS t(layer_id, layer_order, min_zoom, max_zoom)""")
def style_layers(spark, sf_dir):
    layers, _, _ = style.prepare(STYLE).tables(spark)
    return layers.select("layer_id", "layer_order", "min_zoom", "max_zoom")


@query("""WITH l AS (SELECT p_partkey, (p_partkey % 97) / 97.0 AS ar, (p_partkey % 89) / 89.0 AS ag, (p_partkey % 83) / 83.0 AS ab, (p_size % 7) / 7.0 AS dr, (p_size % 11) / 11.0 AS dg, (p_size % 13) / 13.0 AS db,
  cos(radians(p_partkey % 90)) AS down FROM part), k AS (SELECT *, 1 - 0.3 * least(0.2126 * dr + 0.7152 * dg + 0.0722 * db, 1) * (1 - least(down + 1, 1)) AS kept FROM l)
SELECT p_partkey, round(pow(ar * kept + dr * down, 1 / 2.2), 9) AS r, round(pow(ag * kept + dg * down, 1 / 2.2), 9) AS g, round(pow(ab * kept + db * down, 1 / 2.2), 9) AS b FROM k""")
def ground_radiance(spark, sf_dir):
    """Light on flat ground, with a pair of lights for each part."""
    key, size = c("p_partkey"), c("p_size")
    ambient, direct = [key % n / float(n) for n in (97, 89, 83)], [size % n / float(n) for n in (7, 11, 13)]
    lit = style.lit_ground(ambient, direct, F.cos(F.radians(key % 90)), F.pow, lambda a, b: F.least(a, F.lit(b)))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *(F.round(v, 9).alias(k) for k, v in zip("rgb", lit, strict=True)))


@query("""SELECT o_orderkey, source_id FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS source_id FROM orders) WHERE source_id = 'a'""")
def layer_source(spark, sf_dir):
    """Two sources with a layer of one name: a style layer draws its own source's features alone."""
    p = style.prepare(STYLE | {"sources": {k: STYLE["sources"]["base"] for k in "ab"}, "layers": [{"id": "x", "type": "symbol", "source": "a", "source-layer": "land", "layout": {"icon-image": "dot"}}]})
    f = shapes(spark, sf_dir).withColumn("source_id", F.when(c("o_orderkey") % 3 == 0, "a").otherwise("b"))
    return p.layers[0].project(f, ["dot"]).select("o_orderkey", "source_id")


@query("""SELECT page_id, 'https://s.example/a' || page_id || '.json?k=1#f' AS url FROM pages""")
def sprite_url(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    before, after = metadata.sprite_url("https://s.example/a{id}?k=1#f", ".json").split("{id}")
    return p.select("page_id", F.concat(F.lit(before), c("page_id").cast("string"), F.lit(after)).alias("url"))


@query("""SELECT p_partkey, p_size AS width, p_size + 1 AS height FROM part""")
def png_dimensions(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    word = lambda v: F.unhex(F.lpad(F.hex(v), 8, "0"))
    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), word(c("p_size")), word(c("p_size") + 1))
    return p.select("p_partkey", metadata.png_side(head, "width").cast("int").alias("width"), metadata.png_side(head, "height").cast("int").alias("height"))


@query("""SELECT page_id, sha256(url) AS digest FROM pages""")
def resource_digest(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", identity.sha256(c("url")).alias("digest"))


@query("""SELECT l_orderkey, l_linenumber, floor((l_partkey % 2 * 4096 + (l_suppkey % 512) * 4096 / 512) / 2 + 0.5)::BIGINT AS x FROM lineitem""")
def child_rescale(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return p.select("l_orderkey", "l_linenumber", tiles.rescaled(c("l_suppkey") % 512, F.lit(512), F.lit(4096), c("l_partkey") % 2).alias("x"))
