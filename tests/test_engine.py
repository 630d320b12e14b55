import threading

import pytest

from quadloom.engine import Engine, SingleFlight
from quadloom.sources import mvt
from quadloom.types import EngineError

STYLE = {"version": 8, "sources": {"v": {"type": "vector", "tiles": ["https://t.example/{z}/{x}/{y}?key=1"], "maxzoom": 2}}, "layers": [{"id": "l", "type": "line", "source": "v", "source-layer": "roads"}]}
DATA = mvt.encode([{"name": "roads", "features": [{"geom_type": "LineString", "parts": [[(0, 0), (9, 9)]]}]}])


def test_batch(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), lambda url: (503, b"", {}) if "/2/3/" in url else (200, DATA, {}))
    program = engine.prepare(STYLE)
    tiles = spark.createDataFrame([(4, 1, 1), (4, 2, 1), (4, 13, 1)], "z int, x int, y int")
    with pytest.raises(EngineError, match="LIMIT"):
        engine.prepare_batch(program, tiles)
    assert engine.store.valid().count() == 1  # what was fetched is kept; two tiles share it
    with engine.prepare_batch(program, tiles, budget=1) as batch:
        assert engine.metrics["RAW_CACHE_HIT"] == 1 and batch.features(["roads"]).count() == 1
        before = {r.x: r.content_key for r in batch.content_keys().collect()}
        engine.transport = lambda url: (200, DATA, {})
        assert batch.retry_exact().count() == 1 and batch.content_keys().count() == 3
        assert before.items() <= {r.x: r.content_key for r in batch.content_keys().collect()}.items()
        with pytest.raises(EngineError, match="NOT_IN"):
            batch.subset(spark.createDataFrame([(4, 9, 9)], "z int, x int, y int"))
    with pytest.raises(EngineError, match="BATCH_CLOSED"):
        batch.content_keys()
    with pytest.raises(EngineError, match="FOREIGN"):
        Engine(spark, str(tmp_path)).prepare_batch(program, tiles)
    with pytest.raises(EngineError, match="INVALID"):
        engine.prepare_batch(program, tiles.union(tiles))
    assert engine.label_tiles(program, tiles, "CACHE_ONLY").count() == 2
    engine.close()
    with pytest.raises(EngineError, match="CLOSED"):
        engine.prepare(STYLE)


def test_rasters_and_terrain(spark, tmp_path):
    """Raster and elevation tiles are fetched, count as failures with the others, and are part of the keys."""
    sources = STYLE["sources"] | {k: {"type": t, "tiles": ["https://" + k + ".example/{z}/{x}/{y}"], "maxzoom": 4} for k, t in (("r", "raster"), ("d", "raster-dem"))}
    layers = [*STYLE["layers"], {"id": "p", "type": "raster", "source": "r"}, {"id": "h", "type": "hillshade", "source": "d"}]
    engine = Engine(spark, str(tmp_path), lambda url: (503, b"", {}) if "r.example/4/2/" in url else (200, DATA if "t.example" in url else url.encode(), {}))
    program = engine.prepare(STYLE | {"sources": sources, "layers": layers, "terrain": {"source": "d"}})
    tiles = spark.createDataFrame([(4, 0, 0), (4, 2, 5)], "z int, x int, y int")
    with pytest.raises(EngineError, match="LIMIT"):
        engine.prepare_batch(program, tiles)
    with engine.prepare_batch(program, tiles, budget=1) as batch:
        got = {(r.out_x, r.kind, r["class"]): r["count"] for r in batch.resources.groupBy("out_x", "kind", "class").count().collect()}
        assert got == {(x, *k): n for x, around in ((0, 6), (2, 9)) for k, n in ((("vector", "VECTOR_TILE"), 1), (("raster", "RASTER_TILE"), 1), (("raster-dem", "DEM_TILE"), around))}
        assert {r.x for r in batch.resources.filter("kind = 'raster-dem' AND out_x = 0").collect()} == {15, 0, 1}
        assert batch.features(["roads"]).count() == 2 and batch.resources.filter("data IS NULL").count() == 1
        before = {r.x: r.content_key for r in batch.content_keys().collect()}
        engine.transport = lambda url: (200, b"late", {})
        assert batch.retry_exact().count() == 1
        after = {r.x: r.content_key for r in batch.content_keys().collect()}
        assert before[0] == after[0] and before[2] != after[2]
    dem = {(r.out_x, r.x, r.y, r.encoding, bytes(r.data)) for r in engine.terrain_tiles(program, tiles).collect()}
    assert dem == {(0, 0, 0, "mapbox", b"https://d.example/4/0/0"), (2, 2, 5, "mapbox", b"https://d.example/4/2/5")}
    assert engine.label_tiles(program, tiles).count() == 2 and engine.terrain_tiles(engine.prepare(STYLE), tiles).count() == 0


def test_single_flight():
    flights, calls, gate, out = SingleFlight(), [], threading.Event(), []

    def slow():
        calls.append(1)
        gate.wait(5)
        return 7

    threads = [threading.Thread(target=lambda: out.append(flights.run("k", slow))) for _ in range(4)]
    [t.start() for t in threads]
    while len(flights._running) < 1:
        pass
    threading.Timer(0.3, gate.set).start()
    [t.join() for t in threads]
    assert out == [7] * 4 and len(calls) == 1
