import pytest
from pyspark.sql import functions as F

from quadloom.functions import identity, pixels, tiles
from quadloom.plans import planner
from quadloom.types import EngineError


def one(spark, **columns):
    return spark.range(1).select(*(v.alias(k) for k, v in columns.items())).first()


def test_covering(spark):
    r = one(spark, **tiles.covering(F.lit(22), F.lit(1234919), F.lit(1576977), F.lit(15)))
    assert tuple(r) == (15, 9647, 12320, 128, 103, 17)


def test_wrap_and_tms(spark):
    url = tiles.tile_url(F.array(F.lit("{z}/{x}/{y}/{-y}")), F.lit(2), F.lit(-1), F.lit(1), F.lit(True))
    assert one(spark, u=url).u == "2/3/2/2"


def test_bounds(spark):
    for x, kept in ((1, True), (0, False), (2, False)):
        t = tiles.bounds(F.lit(2), F.lit(x), F.lit(1))
        assert one(spark, k=tiles.intersects(t, F.lit(-74.3), F.lit(40.4), F.lit(-73.6), F.lit(41.0))).k is kept


def test_family(spark):
    rows = spark.createDataFrame([(4, 13, 10)], "z int, x long, y long")
    kids = [(r.child_z, r.child_tile_x, r.child_tile_y) for r in tiles.children(rows).orderBy("child").collect()]
    assert kids == [(5, 26, 20), (5, 27, 20), (5, 26, 21), (5, 27, 21)]
    assert tuple(one(spark, **tiles.ancestor(F.lit(4), F.lit(13), F.lit(10), 2))) == (2, 3, 2, 4, 1, 2)
    assert tiles.children(rows, 4).count() == 0
    assert {(r.nx, r.ny) for r in tiles.neighbours(spark.createDataFrame([(1, 0, 0)], "z int, x long, y long")).collect()} == {(0, 0), (1, 0), (0, 1), (1, 1)}


def test_area_and_clip(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1, 1), (11, 1), (11, 11), (1, 11))))
    assert one(spark, a=tiles.shoelace(ring)).a == 200
    r = one(spark, **tiles.clip_segment(F.lit(-1.0), F.lit(0.5), F.lit(2.0), F.lit(0.5)))
    assert r.inside and r.cx0 == pytest.approx(-0.125) and r.cx1 == pytest.approx(1.125)
    assert not one(spark, **tiles.clip_segment(F.lit(-1.0), F.lit(5.0), F.lit(2.0), F.lit(5.0))).inside


def test_redaction(spark):
    u = "https://a.example/t?Token=1&v=2&key=3#key=4"
    assert one(spark, u=identity.redacted(F.lit(u))).u == identity.redact_text(u) == "https://a.example/t?Token=<redacted>&v=2&key=<redacted>#key=4"
    assert identity.canonical_json({"b": [1, None], "a": "é"}) == '{"a":"é","b":[1,null]}'


def test_matrix_golden(spark):
    m = pixels.paint_matrix(contrast=0.1, saturation=0.15, low=0.05)
    r = one(spark, **dict(zip("rgb", pixels.apply_matrix(m, F.lit(22), F.lit(76), F.lit(60)), strict=True)))
    assert all(abs(a - b) <= 1 for a, b in zip(r, (17, 84, 64), strict=True))


def test_fallback(spark):
    wanted = spark.createDataFrame([("s", 4, x, 4) for x in (0, 4, 8, 12)], "source_id string, z int, x int, y int")
    have = [("s", 4, 0, 4, "exact"), *(("s", 5, 8 + dx, 8 + dy, f"c{dy}{dx}") for dx in (0, 1) for dy in (0, 1)), ("s", 5, 16, 8, "one"), ("s", 2, 2, 1, "up")]
    got = {r.x: (r.via, r.distance, r.digests) for r in planner.fallback(wanted, spark.createDataFrame(have, "source_id string, z int, x int, y int, digest string")).collect()}
    assert got == {0: ("exact", None, ["exact"]), 4: ("children", None, ["c00", "c01", "c10", "c11"]), 8: ("ancestor", 2, ["up"]), 12: ("missing", None, None)}


def test_budget(spark):
    rows = spark.createDataFrame([(1, 0, 0, True, "VECTOR_TILE", 503), (1, 0, 0, True, "VECTOR_TILE", None), (1, 1, 0, False, "STYLE", 403)], "z int, x int, y int, failed boolean, class string, status int")
    planner.check_budget(rows, 1)
    with pytest.raises(EngineError, match="LIMIT"):
        planner.check_budget(rows, 0)
    with pytest.raises(EngineError, match="BATCH"):
        planner.check_budget(rows.withColumn("status", F.lit(403)), 5)


def test_content_key_ignores_order(spark):
    rows = [(1, 0, 0, "vector", "b", "1"), (1, 0, 0, "raster", "a", "2")]
    keys = [planner.content_keys(spark.createDataFrame(r, "z int, x int, y int, kind string, identity string, digest string"), "s").first().content_key for r in (rows, rows[::-1])]
    assert keys[0] == keys[1]


def test_merged_children(spark):
    rows = [(0, "land", 512, 0, [[(512, 256)]]), (3, "land", 4096, 0, [[(0, 4096)]])]
    f = spark.createDataFrame(rows, "child int, layer string, extent int, ord int, parts array<array<struct<x:int,y:int>>>")
    got = [(r.ord, r.extent, [tuple(p) for p in r.parts[0]]) for r in planner.merged_children(f).orderBy("ord").collect()]
    assert got == [(0, 512, [(256, 128)]), (1, 512, [(256, 512)])]
