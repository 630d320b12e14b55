import datetime
import json

import numpy as np
import pytest

from quadloom.operators import placement, render
from quadloom.sources import geojson, metadata, mvt, raster, store
from quadloom.streaming import recovery
from quadloom.types import DecodeError, EngineError, Limits

LAYERS = [
    {"name": "boats", "extent": 1024, "features": []},
    {"name": "shore", "features": [
        {"geom_type": "LineString", "props": {"name": "mole", "lamps": 12}, "parts": [[(0, 900), (300, 870), (320, 40)], [(5, 5), (6, 9)]]},
        {"id": 31, "geom_type": "Polygon", "props": {"depth": -7, "dredged": False, "area": 0.125}, "parts": [[(100, 100), (160, 100), (160, 140), (100, 140)]]},
        {"id": 32, "geom_type": "Point", "props": {"name": "mole"}, "parts": [[(77, 8)]]},
    ]},
]


def test_mvt(spark):
    data = mvt.encode(LAYERS)
    layers = mvt.decode(data)
    assert [(x["name"], x["extent"], len(x["features"])) for x in layers] == [("boats", 1024, 0), ("shore", 4096, 3)]
    mole, basin, buoy = layers[1]["features"]
    assert mole["parts"] == [[(0, 900), (300, 870), (320, 40)], [(5, 5), (6, 9)]] and mole["props"]["lamps"] == (2, None, 12.0, None)
    assert basin["id"] == 31 and basin["ring_area2"] == [2 * 60 * 40.0] and {k: basin["props"][k] for k in ("depth", "dredged", "area")} == {"depth": (2, None, -7.0, None), "dredged": (1, False, None, None), "area": (2, None, 0.125, None)}
    assert buoy["parts"] == [[(77, 8)]] and buoy["props"]["name"][3] == "mole"
    mvt.register(spark)
    df = spark.createDataFrame([("s", 1, 0, 0, bytearray(data))], "source_id string, z int, x int, y int, data binary")
    df.createOrReplaceTempView("raw_tiles")
    rows = spark.sql("SELECT f.layer, f.ord, f.geom_type, f.props['name'].s AS name FROM raw_tiles, LATERAL mvt_decode(data) f ORDER BY f.ord").collect()
    assert [(r.ord, r.geom_type, r.name) for r in rows] == [(0, "LineString", "mole"), (1, "Polygon", None), (2, "Point", "mole")]
    assert mvt.decode_tiles(df, ["shore"]).count() == 3 and mvt.decode_tiles(df, ["boats"]).count() == 0


def test_store_opens_again(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(f"id{i}", "VECTOR_TILE", bytearray(b"x%d" % i), None) for i in range(n)], "stable_id string, class string, bytes binary, content_type string")
    first = store.RawStore(spark, str(tmp_path))
    first.write(rows(1))
    first.write(rows(3))
    (tmp_path / "v99999999999999999999-torn").mkdir()  # a version that was not written whole
    again = store.RawStore(spark, str(tmp_path))
    assert again.valid().count() == 3 and store.RawStore(spark, str(tmp_path / "none")).valid().count() == 0
    again.remove(rows(2))
    assert [r.stable_id for r in store.RawStore(spark, str(tmp_path)).read().collect()] == ["id2"]


@pytest.mark.parametrize("layer", [
    [{"name": "", "features": []}], [{"name": "a", "features": []}] * 2,
    [{"name": "a", "features": [{"geom_type": "LineString", "parts": [[(1, 1)]]}]}], [{"name": "a", "features": [{"geom_type": "Polygon", "parts": [[(1, 1), (2, 2)]]}]}],
    [{"name": "a", "features": [{"geom_type": "Polygon", "parts": [[(1, 1), (2, 2), (3, 3)]]}]}],
])
def test_mvt_malformed(layer):
    with pytest.raises(DecodeError):
        mvt.decode(mvt.encode(layer))


def test_mvt_limits():
    with pytest.raises(DecodeError):
        mvt.decode(b"\x1a\x7f")
    with pytest.raises(EngineError, match="SAFETY"):
        mvt.decode(mvt.encode([{"name": "a", "extent": 8192, "features": []}]), Limits(extent=4096))
    with pytest.raises(EngineError, match="SAFETY"):
        mvt.decode(mvt.encode(LAYERS), Limits(features=1))


def test_png(spark):
    image = np.random.default_rng(1).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    png = raster.encode_png(image)
    assert (raster.decode_png(png) == image).all()
    df = spark.createDataFrame([(1, bytearray(png)), (2, bytearray(b"no"))], "id int, data binary")
    got = {r.id: (r.width, r.height, r.problem is None) for r in raster.measured(df).collect()}
    assert got == {1: (7, 5, True), 2: (None, None, False)}
    above = np.array([[10], [20], [30]], np.uint8)
    assert raster.unfiltered(3, np.array([[1], [2], [3]], np.uint8), above).ravel().tolist() == [6, 15, 25]
    assert raster.unfiltered(4, np.array([[1], [2], [3]], np.uint8), above).ravel().tolist() == [11, 22, 33]


def test_metadata(spark):
    doc = {"tilejson": "3.0.0", "tiles": ["../t/{z}/{x}/{y}?key=1"], "minzoom": 2, "maxzoom": 9, "bounds": [170, -10, -170, 10]}
    t = metadata.tilejson(json.dumps(doc), "https://a.example/x/y.json")
    assert t["templates"] == ["https://a.example/t/{z}/{x}/{y}?key=1"] and (t["min_zoom"], t["max_zoom"], t["tile_size"]) == (2, 9, 512)
    other = metadata.tilejson(json.dumps(doc | {"tiles": ["../t/{z}/{x}/{y}?key=2"]}), "https://a.example/x/y.json")
    assert t["digest"] == other["digest"]  # credentials don't count
    for bad in ({"tilejson": "1.0"}, {"tiles": []}, {"bounds": [0, 10, 0, -10]}, {"tileSize": 100}, {"minzoom": 10}):
        with pytest.raises(DecodeError):
            metadata.tilejson(json.dumps(doc | bad), "https://a.example/")
    assert metadata.sprites(spark, '{"a": {"x": 0, "y": 0, "width": 4, "height": 4, "sdf": true}}', 4, 4).first().sdf
    with pytest.raises(DecodeError):
        metadata.sprites(spark, '{"a": {"x": 1, "y": 0, "width": 4, "height": 4}}', 4, 4)
    assert metadata.sprite_url("https://a/s?k=1", "@2x.png") == "https://a/s@2x.png?k=1"


@pytest.mark.parametrize("answers, expected, waits", [
    ([(503, b"", {"Retry-After": "9"}), (200, b"x", {})], (200, b"x"), [5.0]), ([(404, b"", {})], (404, None), []), ([OSError(), (200, b"y", {})], (200, b"y"), [0.0]),
    ([(429, b"", {}), (429, b"", {})], (429, None), [0.0]), ([OSError(), OSError()], (None, None), [0.0]),
])
def test_retry(answers, expected, waits):
    left, slept = list(answers), []

    def transport(url):
        a = left.pop(0)
        if isinstance(a, OSError):
            raise a
        return a

    assert store.exchange(transport, "u", slept.append) == expected and slept == waits and not left


def test_store(spark, tmp_path):
    s = store.RawStore(spark, str(tmp_path))
    wanted = spark.createDataFrame([("a", "VECTOR_TILE", "https://h/a"), ("b", "VECTOR_TILE", "https://h/b"), ("a", "VECTOR_TILE", "https://h/a")], "stable_id string, class string, url string")
    fetch = lambda url: (404, b"", {}) if url.endswith("b") else (200, url.encode(), {})
    got = [(r.stable_id, r.status, r.from_cache) for r in store.acquire(wanted, s, fetch).orderBy("stable_id").collect()]
    assert got == [("a", 200, False), ("a", 200, False), ("b", 404, False)] and s.valid().count() == 1
    assert {(r.stable_id, r.from_cache, r.status) for r in store.acquire(wanted, s, None, "CACHE_ONLY").collect()} == {("a", True, 200), ("b", False, None)}
    assert {r.from_cache for r in store.acquire(wanted.filter("stable_id = 'a'"), s, fetch, "RELOAD").collect()} == {False}
    s.remove(wanted)
    assert s.read().count() == 0


def test_geojson(spark):
    doc = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":1.5,"b":true,"s":"x","z":null,"o":{}},"geometry":{"type":"LineString","coordinates":[[170,10],[-170,10]]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}]}'
    rows = geojson.read_lines(spark.createDataFrame([(1, doc)], "id int, json string")).orderBy("ord").collect()
    p = rows[0].props
    assert (p["n"].n, p["b"].b, p["s"].s, p["z"].t, "o" in p) == (1.5, True, "x", 0, False) and rows[0].problem is None and rows[1].problem == "not a LineString"
    lines = geojson.read_lines(spark.createDataFrame([(1, doc)], "id int, json string")).filter("problem IS NULL")
    cut = {(r.x, r.cx0, r.cx1) for r in geojson.project(lines, 2, ["id"]).collect()}
    assert {x for x, _, _ in cut} == {0, 3}  # over the antimeridian, not around the world


def test_placement():
    line = np.array([[0.0, 0], [10, 0], [10, 10]])
    assert placement.midpoint(line).tolist() == [[10.0, 0.0, 0.0]]
    assert placement.repeated(line, 8)[:, :2].tolist() == [[4.0, 0.0], [10.0, 2.0], [10.0, 10.0]]
    assert placement.repeated(line, 50)[:, :2].tolist() == [[10.0, 0.0]]
    boxes = np.array([[0, 0, 4, 4], [3, 3, 6, 6], [4, 0, 8, 4], [0, 0, 1, 1]], float)
    assert placement.greedy(boxes, np.array([False, False, False, True])).tolist() == [True, False, True, True]
    assert placement.offset_line(np.array([[0.0, 0], [5, 0]]), 2).tolist() == [[0, 2], [5, 2]]
    assert placement.dash_phase((0, 0), (1, 0), 1, 0, 256, 10) == 6.0


def test_render():
    canvas = render.draw([{"op": "background", "rgba": (10, 20, 30, 255)}, {"op": "fill", "rings": [np.array([[2, 2], [6, 2], [6, 6], [2, 6]])], "rgba": (255, 0, 0, 255), "opacity": 0.5}], 8)
    assert canvas[0, 0].tolist() == [10, 20, 30, 255] and canvas[3, 3].tolist() == [133, 10, 15, 255]
    assert (canvas[..., 0] == 133).sum() == 16
    c = render.draw([{"op": "line", "points": np.array([[0, 4.0], [8, 4]]), "rgba": (1, 2, 3, 255), "width": 2.0, "dash": [1, 1]}], 8)
    assert c[3, :, 3].tolist() == [255, 255, 0, 0] * 2
    grey = np.full((4, 4, 4), 100, np.uint8)
    grey[..., 3] = 255
    assert (render.resample(grey, 8, 2, (1, 0)) == grey[0, 0]).all()
    assert render.passes_through(raster.encode_png(grey), 1, True, 1, 4) and not render.passes_through(raster.encode_png(grey), 2, True, 1, 4)
    dem = np.zeros((64, 64, 3), np.uint8)
    dem[:, :32], dem[:, 32:] = (1, 134, 160), (1, 173, 176)
    shade = render.hillshade({(0, 0): dem}, "mapbox", 12, 1000, 64)
    assert shade[5, 5, 3] == 0 and shade[5, 31, 3] > 0


def test_recovery(spark):
    import hashlib

    sub = spark.createDataFrame([("s", 1, 0, 0), ("s", 1, 1, 0)], "source_id string, z int, x int, y int")
    t = datetime.datetime(2024, 1, 1)
    rows = [("s", 1, 0, 0, bytearray(b"x"), hashlib.sha256(b"x").hexdigest(), t), ("s", 1, 1, 0, bytearray(b"y"), "wrong", t), ("s", 1, 5, 0, bytearray(b"x"), hashlib.sha256(b"x").hexdigest(), t)]
    arrived = spark.createDataFrame(rows, "source_id string, z int, x int, y int, bytes binary, digest string, at timestamp")
    got, left = recovery.recover(sub, arrived)
    assert [r.x for r in got.collect()] == [0] and [r.x for r in left.collect()] == [1]


def test_recovery_stream(spark, tmp_path):
    sub = spark.createDataFrame([("s", 1, 0, 0)], "source_id string, z int, x int, y int")
    schema = "source_id string, z int, x int, y int, bytes binary, digest string, at timestamp"
    spark.sql("SELECT 's' AS source_id, 1 AS z, 0 AS x, 0 AS y, cast('x' AS binary) AS bytes, sha2('x', 256) AS digest, timestamp'2024-01-01' AS at FROM range(3)").write.parquet(str(tmp_path / "in"))
    q = recovery.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), sub, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
