"""The registered queries of the library and their SQL.

The driver's tables hold no tiles, so rows get places by a fixed rule (``places``): a longitude and latitude
from their key, hence a tile at each zoom. Each query applies operators of the library to whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.functions import color, identity, pixels, tiles
from quadloom.functions.expr import NUM, STR, Context, compile_expression, compile_filter, compile_property, props_of
from quadloom.plans import planner
from quadloom.types import Kind

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str, z: int = 10) -> DataFrame:
    """Orders with lon, lat and the tile (z, x, y) they fall in."""
    o = read(spark, sf_dir, "orders")
    at = o.withColumns({"lon": F.pmod(c("o_orderkey") * 7919, F.lit(360000)) / 1000.0 - 180, "lat": F.pmod(c("o_orderkey") * 104729, F.lit(170000)) / 1000.0 - 85})
    x, y = tiles.tile_of(c("lon"), c("lat"), F.lit(z))
    return at.withColumns({"z": F.lit(z), "x": x, "y": y})


def places_sql(z: int = 10) -> str:
    return f"""(SELECT *, {z} AS z,
      greatest(0, least({2**z} - 1, floor((lon + 180) / 360 * {2**z})))::BIGINT AS x,
      greatest(0, least({2**z} - 1, floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * {2**z})))::BIGINT AS y
    FROM (SELECT *, (o_orderkey * 7919 % 360000) / 1000.0::DOUBLE - 180 AS lon, (o_orderkey * 104729 % 170000) / 1000.0::DOUBLE - 85 AS lat FROM orders))"""


def features(spark: SparkSession, sf_dir: str, z: int = 10) -> DataFrame:
    """Orders as point features: zoom from 0 to 22 by key, and a property map; clerk is missing for a fifth."""
    o = places(spark, sf_dir, z)
    props = props_of(status=(c("o_orderstatus"), STR), price=(c("o_totalprice"), NUM), priority=(c("o_orderpriority"), STR))
    extra = props_of(clerk=(F.when(c("o_orderkey") % 3 == 0, c("o_orderpriority")), STR))
    return o.select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.pmod(c("o_orderkey"), F.lit(23)).cast("int").alias("z"), "x", "y",
        F.when(c("o_orderkey") % 4 == 0, "Point").when(c("o_orderkey") % 4 == 1, "LineString").otherwise("Polygon").alias("geom_type"),
        c("o_orderkey").alias("id"), F.when(c("o_orderkey") % 5 == 0, props).otherwise(F.map_concat(props, extra)).alias("props"),
    )


FEATURES_SQL = """(SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, (o_orderkey % 23)::INTEGER AS z,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Point' WHEN o_orderkey % 4 = 1 THEN 'LineString' ELSE 'Polygon' END AS geom_type,
  o_orderkey % 5 <> 0 AS has_clerk, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 THEN o_orderpriority END AS clerk FROM orders)"""


# ---- addressing


@query(f"""SELECT o_orderkey, z, x, y, least(z, 6)::INTEGER AS source_z, x // 16 AS source_x, y // 16 AS source_y, 16::BIGINT AS child_scale,
  x % 16 AS child_x, y % 16 AS child_y FROM {places_sql()}""")
def tile_address(spark, sf_dir):
    p = places(spark, sf_dir)
    return p.select("o_orderkey", "z", "x", "y", *(v.alias(k) for k, v in tiles.covering(c("z"), c("x"), c("y"), F.lit(6)).items()))


@query(f"""SELECT o_orderkey, child, (z + 1)::INTEGER AS child_z, x * 2 + child % 2 AS child_tile_x, y * 2 + child // 2 AS child_tile_y
  FROM {places_sql()}, (SELECT unnest([0, 1, 2, 3]) AS child)""")
def tile_children(spark, sf_dir):
    return tiles.children(places(spark, sf_dir)).select("o_orderkey", "child", "child_z", "child_tile_x", "child_tile_y")


@query(f"""SELECT o_orderkey, 8::INTEGER AS ancestor_z, x // 4 AS ancestor_x, y // 4 AS ancestor_y, 4::BIGINT AS ancestor_scale, x % 4 AS window_x, y % 4 AS window_y
  FROM {places_sql()}""")
def tile_ancestor(spark, sf_dir):
    return places(spark, sf_dir).select("o_orderkey", *(v.alias(k) for k, v in tiles.ancestor(c("z"), c("x"), c("y"), 2).items()))


@query(f"""SELECT o_orderkey, dx, dy, (x + dx + 4) % 4 AS nx, y + dy AS ny FROM {places_sql(2)}, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)
  WHERE y + dy >= 0 AND y + dy < 4""")
def tile_neighbors(spark, sf_dir):
    return tiles.neighbours(places(spark, sf_dir, 2)).select("o_orderkey", "dx", "dy", "nx", "ny")


@query(f"""SELECT o_orderkey, x, y FROM {places_sql(5)} WHERE degrees(atan(sinh(pi() * (1 - 2 * y / 32)))) >= -40.5 AND degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 32)))) <= 12.25
  AND (x / 32 * 360 - 180 <= -120.3 OR (x + 1) / 32 * 360 - 180 >= 150.7)""")
def tile_bounds_filter(spark, sf_dir):
    kept = planner.within_bounds(places(spark, sf_dir, 5), F.lit(150.7), F.lit(-40.5), F.lit(-120.3), F.lit(12.25))
    return kept.select("o_orderkey", "x", "y")


@query(f"""SELECT o_orderkey, CASE WHEN (31 * z + 17 * x + y) % 2 = 0 THEN 'https://a.example/' || z || '/' || x || '/' || (1023 - y) || '.pbf'
  ELSE 'https://b.example/' || z || '/' || x || '/' || (1023 - y) || '?k=1' END AS url FROM {places_sql()}""")
def tms_url(spark, sf_dir):
    templates = F.array(F.lit("https://a.example/{z}/{x}/{y}.pbf"), F.lit("https://b.example/{z}/{x}/{-y}?k=1"))
    u = tiles.tile_url(templates, c("z"), c("x"), c("y"), F.lit(True))
    return places(spark, sf_dir).select("o_orderkey", u.alias("url"))


@query(f"""SELECT o_orderkey, y >= 0 AND y < 1024 AND o_orderkey % 25 <= 22 AS ok, ((x - o_orderkey) % 1024 + 1024) % 1024 AS wrapped FROM {places_sql()}""")
def tile_validity(spark, sf_dir):
    p = places(spark, sf_dir)
    return p.select("o_orderkey", (tiles.valid(c("z"), c("y")) & (c("o_orderkey") % 25 <= 22)).alias("ok"), tiles.canonical_x(c("x") - c("o_orderkey"), c("z")).alias("wrapped"))


# ---- filters


def _filter(name: str, document, where: str) -> None:
    def run(spark, sf_dir):
        return features(spark, sf_dir).filter(compile_filter(document)(Context())).select("o_orderkey", "z")

    QUERIES[name], SQL[name] = run, f"SELECT o_orderkey, z FROM {FEATURES_SQL} WHERE {where}"


_filter("filter_legacy_all", ["all", ["==", "status", "F"], ["==", "$type", "Point"], [">=", "price", 1000]], "o_orderstatus = 'F' AND geom_type = 'Point' AND o_totalprice >= 1000")
_filter("filter_legacy_any", ["any", ["==", "status", "P"], ["<", "price", 900], [">", "priority", "4"]], "o_orderstatus = 'P' OR o_totalprice < 900 OR o_orderpriority > '4'")
_filter("filter_legacy_in", ["in", "status", "F", "P", 3], "o_orderstatus IN ('F', 'P')")
_filter("filter_legacy_notin", ["!in", "clerk", "1-URGENT", "2-HIGH"], "clerk IS NULL OR clerk NOT IN ('1-URGENT', '2-HIGH')")
_filter("filter_legacy_has", ["all", ["has", "clerk"], ["has", "$id"]], "has_clerk")
_filter("filter_legacy_not_has", ["!has", "clerk"], "NOT has_clerk")
_filter("filter_legacy_neq", ["all", ["!=", "status", "F"], ["!=", "price", "F"]], "o_orderstatus <> 'F'")  # a mismatch of types is unequal
_filter("filter_legacy_compare", ["any", ["all", ["<=", "price", 200000], ["<", "status", "P"]], ["<", "missing", 4]], "o_totalprice <= 200000 AND o_orderstatus < 'P'")
_filter("filter_expr", ["all", ["==", ["get", "status"], "O"], [">=", ["zoom"], 12], ["<=", ["get", "price"], 150000]], "o_orderstatus = 'O' AND z >= 12 AND o_totalprice <= 150000")
_filter("filter_mixed_dialect", ["all", ["==", "status", "F"], [">=", ["zoom"], 12]], "false")  # compares two literals
_filter("filter_expr_null_strict", ["!", ["all", ["==", ["get", "status"], "F"], ["boolean", ["get", "nothing"]]]], "false")
_filter("filter_none", None, "true")


# ---- expressions and properties


def _expression(name: str, document, sql: str, kind: Kind | None = None, prop: bool = False) -> None:
    def run(spark, sf_dir):
        node = (compile_property if prop else compile_expression)(document, kind)
        v = node.make(Context())
        if node.kind is Kind.VALUE:
            v = F.coalesce(v["s"], v["n"].cast("string"), v["b"].cast("string"))
        elif node.kind is Kind.NUMBER:
            v = F.round(v, 6)
        elif node.kind is Kind.COLOR:
            v = F.concat_ws(",", *(v[k].cast("string") for k in "rgba"))
        return features(spark, sf_dir).select("o_orderkey", v.alias("v"))

    QUERIES[name], SQL[name] = run, f"SELECT o_orderkey, {sql} AS v FROM {FEATURES_SQL}"


_expression("expr_case", ["case", ["==", ["get", "status"], "F"], 1, [">=", ["get", "price"], 100000], 2, 3], "CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_totalprice >= 100000 THEN 2 ELSE 3 END::DOUBLE")
_expression("expr_match", ["match", ["get", "priority"], ["1-URGENT", "2-HIGH"], "high", "5-LOW", "low", "other"], "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'other' END")
_expression("expr_step", ["step", ["get", "price"], "low", 50000, "middle", 150000.5, "high", 250000, "top"], "CASE WHEN o_totalprice >= 250000 THEN 'top' WHEN o_totalprice >= 150000.5 THEN 'high' WHEN o_totalprice >= 50000 THEN 'middle' ELSE 'low' END")
_expression("expr_interp_linear", ["interpolate", ["linear"], ["get", "price"], 1000, 0, 50000, 10, 300000, 100], "round(CASE WHEN o_totalprice <= 1000 THEN 0 WHEN o_totalprice >= 300000 THEN 100 WHEN o_totalprice < 50000 THEN 10 * (o_totalprice - 1000) / 49000 ELSE 10 + 90 * (o_totalprice - 50000) / 250000 END::DOUBLE, 6)")
_expression("expr_interp_exp", ["interpolate", ["exponential", 1.5], ["zoom"], 5, 1, 18, 40], "round(CASE WHEN z <= 5 THEN 1 WHEN z >= 18 THEN 40 ELSE 1 + 39 * (pow(1.5, z - 5) - 1) / (pow(1.5, 13) - 1) END::DOUBLE, 6)")
_expression("expr_interp_color", ["interpolate", ["linear"], ["zoom"], 0, "#102030", 20, "rgba(250, 100, 0, 0.5)"], """
  (floor(16 + (250 - 16) * least(1, z / 20) + 0.5)::BIGINT || ',' || floor(32 + (100 - 32) * least(1, z / 20) + 0.5)::BIGINT || ',' || floor(48 + (0 - 48) * least(1, z / 20) + 0.5)::BIGINT || ',' || floor(255 + (128 - 255) * least(1, z / 20) + 0.5)::BIGINT)""", Kind.COLOR)
_expression("expr_coalesce", ["coalesce", ["get", "nothing"], ["get", "clerk"], ["get", "status"]], "coalesce(clerk, o_orderstatus)")
_expression("expr_to_number", ["*", ["to-number", ["get", "status"], ["get", "nothing"], "4.5"], ["+", ["zoom"], 1, 2]], "round(4.5 * (z + 3), 6)::DOUBLE")
_expression("expr_in_substring", ["in", "URG", ["get", "priority"]], "contains(o_orderpriority, 'URG')")
_expression("expr_in_array", ["in", ["get", "status"], ["literal", ["F", "O", 3]]], "o_orderstatus IN ('F', 'O')")
_expression("expr_null_eq", ["==", ["get", "nothing"], ["get", "clerk"]], "clerk IS NULL")
_expression("expr_type_exact", ["==", ["get", "price"], "3"], "false")
_expression("expr_has", ["any", ["has", "clerk"], ["!", ["==", ["geometry-type"], "Polygon"]]], "has_clerk OR geom_type <> 'Polygon'")
_expression("legacy_fn_exp", {"base": 1.6, "stops": [[1, 40], [5, 12], [11, 12], [11, 30], [19, 90]]}, "round(CASE WHEN z < 1 THEN 40 WHEN z < 5 THEN 40 - 28 * (pow(1.6, z - 1) - 1) / (pow(1.6, 4) - 1) WHEN z < 11 THEN 12 WHEN z < 19 THEN 30 + 60 * (pow(1.6, z - 11) - 1) / (pow(1.6, 8) - 1) ELSE 90 END::DOUBLE, 6)", prop=True)
_expression("legacy_fn_interval", {"type": "interval", "stops": [[0, "minor"], [10, "major"]]}, "CASE WHEN z < 10 THEN 'minor' ELSE 'major' END", prop=True)
_expression("legacy_fn_identity", {"type": "identity", "property": "clerk", "default": "none"}, "CASE WHEN has_clerk THEN clerk ELSE 'none' END", prop=True)


# ---- colours and identity


@query("""WITH h AS (SELECT p_partkey, (p_partkey * 37 % 720)::DOUBLE - 180 AS hue, p_size / 50.0 AS s, (p_partkey % 101) / 100.0 AS l FROM part),
k AS (SELECT *, s * least(l, 1 - l) AS a, ((hue % 360 + 360) % 360) / 30 AS q FROM h),
t AS (SELECT *, q % 12 AS k0, (q + 8) % 12 AS k8, (q + 4) % 12 AS k4 FROM k)
SELECT p_partkey, least(255, greatest(0, floor(round((l - a * greatest(-1, least(k0 - 3, 9 - k0, 1))) * 255, 9) + 0.5)))::INTEGER AS r,
  least(255, greatest(0, floor(round((l - a * greatest(-1, least(k8 - 3, 9 - k8, 1))) * 255, 9) + 0.5)))::INTEGER AS g,
  least(255, greatest(0, floor(round((l - a * greatest(-1, least(k4 - 3, 9 - k4, 1))) * 255, 9) + 0.5)))::INTEGER AS b FROM t""")
def hsl_to_rgb(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    r, g, b = color.hsl_columns((F.pmod(c("p_partkey") * 37, F.lit(720))).cast("double") - 180, c("p_size") / 50.0, (c("p_partkey") % 101) / 100.0)
    return p.select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


@query("""SELECT page_id, CASE WHEN strpos(url, '?') = 0 THEN url ELSE regexp_replace(url, '([?&])(page|ref)=[^&#]*', '\\1\\2=<redacted>', 'g') END AS plain, url AS redacted FROM
  (SELECT page_id, url FROM pages)""")
def url_redact(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    # the same operator, over urls whose parameters are renamed to authenticating ones and back
    marked = F.replace(F.replace(c("url"), F.lit("page="), F.lit("key=")), F.lit("ref="), F.lit("Token="))
    shown = F.replace(F.replace(identity.redacted(marked), F.lit("key="), F.lit("page=")), F.lit("Token="), F.lit("ref="))
    return p.select("page_id", shown.alias("plain"), identity.redacted(c("url")).alias("redacted"))


@query(f"""SELECT o_orderkey, sha256('quadloom-request-1' || chr(10) || 'style' || chr(10) || z || '/' || x || '/' || y || chr(10) || '512') AS request_key FROM {places_sql()}""")
def request_key(spark, sf_dir):
    return places(spark, sf_dir).select("o_orderkey", identity.request_key(F.lit("style"), c("z"), c("x"), c("y"), F.lit(512)).alias("request_key"))


@query(f"""SELECT z, x, y, sha256('quadloom-output-1' || chr(10) || 'style' || chr(10) || z || '/' || x || '/' || y || chr(10) || '512' || chr(10) ||
  string_agg(kind || ':' || identity || ':' || digest, chr(10) ORDER BY kind, identity, digest)) AS content_key FROM (
  SELECT DISTINCT z, x, y, CASE WHEN o_orderkey % 2 = 0 THEN 'raster' ELSE 'vector' END AS kind, o_orderpriority AS identity, sha256(o_orderstatus) AS digest FROM {places_sql(4)})
  GROUP BY z, x, y""")
def content_key(spark, sf_dir):
    r = places(spark, sf_dir, 4).select("z", "x", "y", F.when(c("o_orderkey") % 2 == 0, "raster").otherwise("vector").alias("kind"), c("o_orderpriority").alias("identity"), identity.sha256(c("o_orderstatus")).alias("digest"))
    return planner.content_keys(r, "style")


# ---- joins and aggregates of the planner


@query(f"SELECT z, x, y, count(*)::BIGINT AS n FROM {places_sql(6)} GROUP BY z, x, y HAVING count(*) > 1")
def dup_tiles(spark, sf_dir):
    return planner.duplicate_tiles(places(spark, sf_dir, 6)).select("z", "x", "y", c("count").alias("n"))


@query(f"""SELECT x || '/' || y AS identity, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM {places_sql(6)} GROUP BY 1""")
def representative(spark, sf_dir):
    p = places(spark, sf_dir, 6).select(F.concat_ws("/", "x", "y").alias("identity"), "o_orderkey", "o_orderstatus")
    return planner.representatives(p, "identity", "o_orderkey")


@query("""SELECT p_partkey, layer, layer_order FROM (SELECT p_partkey, (p_size % 23)::INTEGER AS z FROM part)
  JOIN (VALUES ('land', 0, 0, 31), ('roads', 1, 5, 14), ('poi', 2, 14, 23)) AS l(layer, layer_order, min_zoom, max_zoom) ON z >= min_zoom AND z < max_zoom""")
def layer_zoom_join(spark, sf_dir):
    layers = spark.createDataFrame([("land", 0, 0, 31), ("roads", 1, 5, 14), ("poi", 2, 14, 23)], "layer string, layer_order int, min_zoom int, max_zoom int")
    p = read(spark, sf_dir, "part").select("p_partkey", (c("p_size") % 23).cast("int").alias("z"))
    return planner.active_layers(p, layers).select("p_partkey", "layer", "layer_order")


@query(f"""SELECT o_orderkey, source_id, source_z, x // (1 << (10 - source_z)) AS source_x, y // (1 << (10 - source_z)) AS source_y FROM (
  SELECT o_orderkey, x, y, s.source_id, least(10, s.source_max)::INTEGER AS source_z, s.west, s.east FROM {places_sql()} p
  JOIN (VALUES ('base', 0, 6, -180.0, 180.0), ('east', 3, 14, 10.5, 180.0), ('deep', 12, 14, -180.0, 180.0)) AS s(source_id, source_min, source_max, west, east)
    ON (p.o_custkey % 3 = 0 AND s.source_id = 'base' OR p.o_custkey % 3 = 1 AND s.source_id = 'east' OR p.o_custkey % 3 = 2 AND s.source_id = 'deep') AND 10 >= s.source_min
  WHERE (x + 1) / 1024 * 360 - 180 >= s.west AND x / 1024 * 360 - 180 <= s.east)""")
def source_samples(spark, sf_dir):
    sources = spark.createDataFrame([("base", 0, 6, -180.0, -90.0, 180.0, 90.0), ("east", 3, 14, 10.5, -90.0, 180.0, 90.0), ("deep", 12, 14, -180.0, -90.0, 180.0, 90.0)], "source_id string, min_zoom int, max_zoom int, west double, south double, east double, north double")
    p = places(spark, sf_dir).withColumn("source_id", F.when(c("o_custkey") % 3 == 0, "base").when(c("o_custkey") % 3 == 1, "east").otherwise("deep"))
    return planner.samples(p, sources).select("o_orderkey", "source_id", "source_z", "source_x", "source_y")


@query(f"""WITH p AS {places_sql(6)}, wanted AS (SELECT DISTINCT z, x, y FROM p), have AS (
  SELECT DISTINCT k.z, k.x, k.y FROM (SELECT o_orderkey, 6 AS z, x, y FROM p UNION ALL SELECT o_orderkey, 5, x // 2, y // 2 FROM p UNION ALL SELECT o_orderkey, 4, x // 4, y // 4 FROM p) k
  WHERE (k.z * 7 + k.x * 3 + k.y) % 3 = 0 AND k.z < 7)
SELECT w.z, w.x, w.y, CASE WHEN e.z IS NOT NULL THEN 'exact' WHEN a1.z IS NOT NULL OR a2.z IS NOT NULL THEN 'ancestor' ELSE 'missing' END AS via,
  CASE WHEN e.z IS NOT NULL THEN NULL WHEN a1.z IS NOT NULL THEN 1 WHEN a2.z IS NOT NULL THEN 2 END::INTEGER AS distance
FROM wanted w LEFT JOIN have e ON e.z = w.z AND e.x = w.x AND e.y = w.y LEFT JOIN have a1 ON a1.z = w.z - 1 AND a1.x = w.x // 2 AND a1.y = w.y // 2
LEFT JOIN have a2 ON a2.z = w.z - 2 AND a2.x = w.x // 4 AND a2.y = w.y // 4""")
def fallback_nearest(spark, sf_dir):
    p = places(spark, sf_dir, 6)
    wanted = p.select(F.lit("s").alias("source_id"), "z", "x", "y").distinct()
    levels = F.explode(F.array(*(F.struct(F.lit(6 - d).alias("z"), tiles.idiv(c("x"), F.lit(1 << d)).alias("x"), tiles.idiv(c("y"), F.lit(1 << d)).alias("y")) for d in (0, 1, 2))))
    have = p.select(levels.alias("k")).select("k.*").distinct().filter("(z * 7 + x * 3 + y) % 3 = 0").withColumns({"source_id": F.lit("s"), "digest": F.lit("d")})
    return planner.fallback(wanted, have).select("z", "x", "y", "via", "distance")


@query(f"""SELECT count(DISTINCT z || '/' || x || '/' || y) AS failed_tiles, count(DISTINCT CASE WHEN NOT (kind IN ('VECTOR_TILE', 'RASTER_TILE', 'DEM_TILE') AND (status IS NULL OR status IN (404, 408, 429) OR status >= 500)) THEN z || '/' || x || '/' || y END) AS fatal_tiles
  FROM (SELECT *, CASE WHEN o_custkey % 4 = 0 THEN 'STYLE' ELSE 'VECTOR_TILE' END AS kind, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 503 ELSE 429 END AS status FROM {places_sql()} WHERE o_orderstatus = 'F')""")
def substitution_budget(spark, sf_dir):
    status = F.when(c("o_orderkey") % 5 == 1, 404).when(c("o_orderkey") % 5 == 2, 403).when(c("o_orderkey") % 5 == 3, 503).when(c("o_orderkey") % 5 == 4, 429)
    o = places(spark, sf_dir).withColumns({"failed": c("o_orderstatus") == "F", "class": F.when(c("o_custkey") % 4 == 0, "STYLE").otherwise("VECTOR_TILE"), "status": status})
    return planner.failed_tiles(o)


@query(f"""WITH p AS {places_sql(7)}, sub AS (SELECT DISTINCT z, x, y FROM p WHERE o_orderstatus = 'F'), arr AS (SELECT DISTINCT z, x, y FROM p WHERE o_orderstatus = 'O')
SELECT s.z, s.x, s.y, a.z IS NOT NULL AS recovered FROM sub s LEFT JOIN arr a ON s.z = a.z AND s.x = a.x AND s.y = a.y""")
def source_semi_anti(spark, sf_dir):
    p, keys = places(spark, sf_dir, 7), ["z", "x", "y"]
    sub, arr = (p.filter(c("o_orderstatus") == s).select(*keys).distinct() for s in ("F", "O"))
    back, left = planner.recoverable(sub, arr, keys), planner.still_substituted(sub, arr, keys)
    return back.withColumn("recovered", F.lit(True)).unionByName(left.withColumn("recovered", F.lit(False)))


@query(f"""WITH p AS {places_sql(5)} SELECT DISTINCT z, x, y FROM p WHERE (z, x, y) NOT IN (SELECT (z, x, y) FROM p WHERE o_orderpriority = '1-URGENT')""")
def subset_check(spark, sf_dir):
    p = places(spark, sf_dir, 5)
    return planner.missing_from(p.select("z", "x", "y").distinct(), p.filter(c("o_orderpriority") == "1-URGENT"))


# ---- order and geometry


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity END, l_linenumber)::INTEGER AS draw_order FROM lineitem""")
def line_sort_order(spark, sf_dir):
    from quadloom.operators.lines import draw_order

    rows = read(spark, sf_dir, "lineitem").withColumn("sort_key", F.when(c("l_returnflag") != "N", c("l_quantity")))
    return draw_order(rows, ["l_orderkey"], "sort_key", "l_linenumber").select("l_orderkey", "l_linenumber", "draw_order")


@query("""SELECT l_orderkey, l_linenumber, round(len_, 6) AS length, round(coalesce(sum(len_) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start FROM (
  SELECT *, sqrt((nx - px) * (nx - px) + (ny - py) * (ny - py)) AS len_ FROM (
    SELECT l_orderkey, l_linenumber, px, py, lead(px) OVER w AS nx, lead(py) OVER w AS ny FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS px, (max(l_partkey) % 100)::DOUBLE AS py FROM lineitem GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))) WHERE len_ IS NOT NULL""")
def segment_pairs(spark, sf_dir):
    from quadloom.operators.lines import segments

    v = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("px"), (F.max("l_partkey") % 100).cast("double").alias("py"))
    return segments(v, ["l_orderkey"], "l_linenumber", "px", "py").select("l_orderkey", "l_linenumber", F.round("length", 6).alias("length"), F.round("start", 6).alias("start"))


@query("""SELECT o_orderkey, sum(px * coalesce(ny, fy) - coalesce(nx, fx) * py)::BIGINT AS area2 FROM (
  SELECT *, lead(px) OVER w AS nx, lead(py) OVER w AS ny, first_value(px) OVER w AS fx, first_value(py) OVER w AS fy FROM (
    SELECT l_orderkey AS o_orderkey, l_linenumber, (max(l_partkey) % 4096)::BIGINT AS px, (max(l_suppkey) * 31 % 4096)::BIGINT AS py FROM lineitem GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY o_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY o_orderkey""")
def shoelace_area(spark, sf_dir):
    points = read(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey"), "l_linenumber").agg((F.max("l_partkey") % 4096).alias("x"), (F.max("l_suppkey") * 31 % 4096).alias("y"))
    v = points.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "x", "y"))).alias("ring"))
    return v.select("o_orderkey", tiles.shoelace(c("ring")).alias("area2"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity / 25 - 0.5 AS x0, (l_partkey % 300)::DOUBLE / 100 - 1 AS y0, l_discount * 20 - 0.5 AS x1, (l_suppkey % 40)::DOUBLE / 20 - 0.5 AS y1 FROM lineitem),
d AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM s),
t AS (SELECT *, greatest(0, CASE WHEN dx = 0 THEN 0 ELSE least((-0.125 - x0) / dx, (1.125 - x0) / dx) END, CASE WHEN dy = 0 THEN 0 ELSE least((-0.125 - y0) / dy, (1.125 - y0) / dy) END) AS t0,
  least(1, CASE WHEN dx = 0 THEN 1 ELSE greatest((-0.125 - x0) / dx, (1.125 - x0) / dx) END, CASE WHEN dy = 0 THEN 1 ELSE greatest((-0.125 - y0) / dy, (1.125 - y0) / dy) END) AS t1 FROM d)
SELECT l_orderkey, l_linenumber, floor((x0 + dx * t0) * 4096 + 0.5000001)::BIGINT AS cx0, floor((y0 + dy * t0) * 4096 + 0.5000001)::BIGINT AS cy0, floor((x0 + dx * t1) * 4096 + 0.5000001)::BIGINT AS cx1, floor((y0 + dy * t1) * 4096 + 0.5000001)::BIGINT AS cy1 FROM t
WHERE t0 <= t1 AND (dx <> 0 OR x0 BETWEEN -0.125 AND 1.125) AND (dy <> 0 OR y0 BETWEEN -0.125 AND 1.125)""")
def mercator_clip(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_quantity") / 25 - 0.5).alias("x0"), ((c("l_partkey") % 300) / 100.0 - 1).alias("y0"), (c("l_discount") * 20 - 0.5).alias("x1"), ((c("l_suppkey") % 40) / 20.0 - 0.5).alias("y1"))
    cut = s.withColumns(tiles.clip_segment(c("x0"), c("y0"), c("x1"), c("y1"))).filter("inside")
    return cut.select("l_orderkey", "l_linenumber", *(F.floor(c(k) * 4096 + 0.5000001).alias(k) for k in ("cx0", "cy0", "cx1", "cy1")))


@query(f"""SELECT o_orderkey, floor(256 * ((x % 16) + 0.5) + 0.5)::BIGINT AS px, floor(((o_custkey % 4096) / 4096.0 * 4 - (y % 4)) * 512 + 0.5)::BIGINT AS py FROM {places_sql()}""")
def pixel_coordinates(spark, sf_dir):
    p = places(spark, sf_dir)
    px = tiles.to_pixels((c("x") % 16) + 0.5, 1, F.lit(1), F.lit(0), 256)
    py = tiles.to_pixels(c("o_custkey") % 4096, 4096, F.lit(4), c("y") % 4, 512)
    return p.select("o_orderkey", F.floor(px + 0.5).alias("px"), F.floor(py + 0.5).alias("py"))


# ---- pixels


@query("""SELECT l_orderkey, l_linenumber, least(255, greatest(0, floor(255 * (1.0 * r1 * 0.949999988079071044921875 + 0.0500000007450580596923828125) + 0.5)))::INTEGER AS r FROM (
  SELECT l_orderkey, l_linenumber, (l_partkey % 256) / 255.0 AS r1 FROM lineitem)""")
def raster_matrix(spark, sf_dir):
    m = pixels.paint_matrix(low=0.05)
    p = read(spark, sf_dir, "lineitem").withColumn("v", c("l_partkey") % 256)
    return p.select("l_orderkey", "l_linenumber", pixels.apply_matrix(m, c("v"), c("v"), c("v"))[0].alias("r"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'A' THEN r * 256.0 + g + b / 256.0 - 32768.0 ELSE -10000.0 + (r * 65536 + g * 256 + b) * 0.1 END::DOUBLE, 6) AS height
  FROM (SELECT *, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_linenumber * 36 AS b FROM lineitem)""")
def dem_height(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_partkey") % 256).alias("r"), (c("l_suppkey") % 256).alias("g"), (c("l_linenumber") * 36).alias("b"), F.when(c("l_returnflag") == "A", "terrarium").otherwise("mapbox").alias("encoding"))
    return p.select("l_orderkey", "l_linenumber", F.round(pixels.dem_height(c("r"), c("g"), c("b"), c("encoding")), 6).alias("height"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, (l_tax * 100 - l_quantity) / 20.0 AS gx, (l_linenumber * 5 - l_discount * 100) / 20.0 AS gy FROM lineitem),
s AS (SELECT *, atan(0.5 * sqrt(gx * gx + gy * gy)) AS slope, atan2(gy, -gx) AS aspect FROM g),
d AS (SELECT *, sin(pi() / 4) * cos(slope) + cos(pi() / 4) * sin(slope) * cos(335 * pi() / 180 - aspect) - sin(pi() / 4) AS delta FROM s)
SELECT l_orderkey, l_linenumber, round(slope, 6) AS slope, round(least(1, greatest(0, sin(slope) * 0.28)), 6) AS accent_alpha,
  round(least(1, greatest(0, CASE WHEN delta >= 0 THEN delta / (1 - sin(pi() / 4)) ELSE -delta / (1 + sin(pi() / 4)) END)), 6) AS shade_alpha FROM d""")
def hillshade_px(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem")
    h = pixels.hillshade(c("l_quantity"), c("l_tax") * 100, c("l_discount") * 100, c("l_linenumber") * 5, F.lit(10.0))
    return p.select("l_orderkey", "l_linenumber", *(F.round(h[k], 6).alias(k) for k in ("slope", "accent_alpha", "shade_alpha")))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN a > 0 THEN least(255, greatest(0, floor((top * ta + base * ba * (1 - ta)) / a + 0.5))) ELSE 0 END::INTEGER AS channel, round(a, 6) AS alpha FROM (
  SELECT *, ta + ba * (1 - ta) AS a FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 256)::DOUBLE AS base, (l_suppkey % 256)::DOUBLE AS top, l_discount * 5 AS ba, l_tax * 10 AS ta FROM lineitem))""")
def alpha_over(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem")
    channel, alpha = pixels.over((c("l_partkey") % 256).cast("double"), c("l_discount") * 5, (c("l_suppkey") % 256).cast("double"), c("l_tax") * 10)
    return p.select("l_orderkey", "l_linenumber", channel.alias("channel"), F.round(alpha, 6).alias("alpha"))


# ---- documents and extras


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') IS NOT NULL AS has_k FROM events""")
def json_props_get(spark, sf_dir):
    from quadloom.sources.geojson import properties_of

    e = read(spark, sf_dir, "events").withColumn("props", properties_of(c("props")))
    v = compile_expression(["get", "k"]).tagged(Context())
    text = F.coalesce(v["s"], F.when(v["n"] == F.floor(v["n"]), F.floor(v["n"]).cast("string")).otherwise(v["n"].cast("string")), v["b"].cast("string"))
    return e.select("event_id", text.alias("k"), compile_expression(["has", "k"]).make(Context()).alias("has_k"))


@query(f"""SELECT x, y, o_orderstatus, count(*)::BIGINT AS n FROM {places_sql(3)} GROUP BY ROLLUP (x, y, o_orderstatus)""")
def tile_rollup_counts(spark, sf_dir):
    return places(spark, sf_dir, 3).rollup("x", "y", "o_orderstatus").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: matched to tiles of zoom 8, filtered, styled and counted for each tile."""
    e = read(spark, sf_dir, "events")
    at = e.withColumns({"lon": F.pmod(c("event_id") * 7919, F.lit(360000)) / 1000.0 - 180, "lat": F.pmod(c("event_id") * 104729, F.lit(170000)) / 1000.0 - 85})
    x, y = tiles.tile_of(c("lon"), c("lat"), F.lit(3))
    f = at.withColumns({"z": F.lit(3), "x": x, "y": y, "geom_type": F.lit("Point"), "id": c("event_id"), "props": props_of(kind=(c("event_type"), STR), value=(c("value"), NUM))})
    ctx = Context()
    width = compile_expression(["interpolate", ["linear"], ["get", "value"], 0, 1, 100, 5]).make(ctx)
    shown = compile_expression(["match", ["get", "kind"], "purchase", "green", ["error", "signup"], "red", "grey"]).make(ctx)
    styled = f.filter(compile_filter(["!=", "kind", "click"])(ctx)).select("z", "x", "y", shown.alias("colour"), width.alias("width"))
    return styled.groupBy("z", "x", "y", "colour").agg(F.count("*").alias("n"), F.round(F.sum("width"), 6).alias("total_width"))


FLAGSHIP_SQL = """SELECT 3 AS z, x, y, colour, count(*)::BIGINT AS n, round(sum(width), 6) AS total_width FROM (
  SELECT greatest(0, least(7, floor((lon + 180) / 360 * 8)))::BIGINT AS x, greatest(0, least(7, floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 8)))::BIGINT AS y,
    CASE WHEN event_type = 'purchase' THEN 'green' WHEN event_type IN ('error', 'signup') THEN 'red' ELSE 'grey' END AS colour,
    CASE WHEN value <= 0 THEN 1 WHEN value >= 100 THEN 5 ELSE 1 + 4 * value / 100 END::DOUBLE AS width
  FROM (SELECT *, (event_id * 7919 % 360000) / 1000.0::DOUBLE - 180 AS lon, (event_id * 104729 % 170000) / 1000.0::DOUBLE - 85 AS lat FROM events) WHERE event_type <> 'click')
GROUP BY x, y, colour"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quadloom.plans import catalog_rows

    return {"styled_event_tiles": flagship} | QUERIES | catalog_rows.QUERIES


def oracle_sql() -> dict[str, str]:
    from quadloom.plans import catalog_rows

    return {"styled_event_tiles": FLAGSHIP_SQL} | SQL | catalog_rows.SQL
