"""Vector tiles: decoding to feature rows, with validation and budgets, and encoding.

Layers that aren't wanted are skipped before their features are read. One tile is decoded at a time, in
Arrow batches of a few tiles, so memory follows the tile limit.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quadloom.types import DecodeError, EngineError, Limits

SCHEMA = "source_id string, z int, x int, y int, layer string, extent int, ord int, id decimal(20,0), geom_type string, props map<string,struct<t:tinyint,b:boolean,n:double,s:string>>, parts array<array<struct<x:int,y:int>>>, ring_area2 array<double>"
TYPES = {1: "Point", 2: "LineString", 3: "Polygon"}
MOVE, LINE, CLOSE = 1, 2, 7


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise DecodeError("truncated varint")
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value & 0xFFFFFFFFFFFFFFFF, at


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field number, wire type, value) of a message."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise DecodeError(f"wire type {kind}")
        if at > len(data) or kind in (1, 5) and len(value) not in (4, 8) or number == 0:
            raise DecodeError("truncated message")
        yield number, kind, value


def packed(values: Iterable[tuple[int, object]]) -> list[int]:
    out: list[int] = []
    for kind, v in values:
        if kind == 0:
            out.append(v)
            continue
        at = 0
        while at < len(v):
            n, at = varint(v, at)
            out.append(n)
    return out


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def scalar(data: bytes) -> tuple:
    """A tagged value (t, b, n, s): exactly one scalar."""
    found = list(fields(data))
    if len(found) != 1:
        raise DecodeError("a value must hold exactly one scalar")
    number, kind, v = found[0]
    if number == 1 and kind == 2:
        return 3, None, None, v.decode("utf-8")
    if number == 7 and kind == 0:
        return 1, bool(v), None, None
    try:
        n = {
            2: lambda: struct.unpack("<f", v)[0], 3: lambda: struct.unpack("<d", v)[0], 4: lambda: v - (1 << 64) if v >> 63 else v,
            5: lambda: v, 6: lambda: zigzag(v),
        }[number]()
    except (KeyError, struct.error, TypeError) as e:
        raise DecodeError("unknown scalar") from e
    if not math.isfinite(n):
        raise DecodeError("numbers must be finite")
    return 2, None, float(n), None


def area2(ring: list[tuple[int, int]]) -> int:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


class Budget:
    def __init__(self, limits: Limits):
        self.limits, self.used = limits, dict.fromkeys(("features", "tags", "commands", "coordinates"), 0)

    def spend(self, what: str, n: int) -> None:
        self.used[what] += n
        if self.used[what] > getattr(self.limits, what):
            raise EngineError("SAFETY_LIMIT_EXCEEDED", f"more than {getattr(self.limits, what)} {what}")


def geometry(words: list[int], kind: str, extent: int, budget: Budget) -> tuple[list[list[tuple[int, int]]], list[float]]:
    """Parts in tile coordinates, and for polygons twice the area of each ring."""
    most, at, x, y = max(1 << 28, 16 * extent), 0, 0, 0
    parts: list[list[tuple[int, int]]] = []
    areas: list[float] = []
    closed = True
    while at < len(words):
        command, count = words[at] & 7, words[at] >> 3
        at += 1
        budget.spend("commands", 1)
        if command == CLOSE:
            if kind != "Polygon" or closed or count != 1 or len(parts[-1]) < 3:
                raise DecodeError("misplaced ClosePath")
            a = area2(parts[-1])
            if a == 0:
                raise DecodeError("a ring without area")
            areas.append(float(a))
            closed = True
            continue
        if command not in (MOVE, LINE) or count == 0 or at + 2 * count > len(words):
            raise DecodeError("bad geometry command")
        budget.spend("coordinates", count)
        if command == MOVE:
            if kind == "Point" and parts or kind != "Point" and count != 1 or kind == "Polygon" and not closed or kind == "LineString" and parts and len(parts[-1]) < 2:
                raise DecodeError("misplaced MoveTo")
            parts.append([])
            closed = False
        elif kind == "Point" or not parts or closed or len(parts[-1]) != 1:
            raise DecodeError("misplaced LineTo")
        for _ in range(count):
            x, y = x + zigzag(words[at]), y + zigzag(words[at + 1])
            at += 2
            if max(abs(x), abs(y)) > most:
                raise DecodeError("a coordinate is out of range")
            parts[-1].append((x, y))
    if not parts or kind == "LineString" and len(parts[-1]) < 2 or kind == "Polygon" and not closed:
        raise DecodeError("an unfinished geometry")
    return parts, areas


def decode(data: bytes, limits: Limits = Limits(), wanted: set[str] | None = None) -> list[dict]:
    """Layers: name, extent and features (id, geom_type, props, parts, ring_area2)."""
    budget, names, out = Budget(limits), set(), []
    for number, kind, body in fields(data):
        if number != 3 or kind != 2:
            continue
        found: dict[int, list] = {}
        for n, k, v in fields(body):
            found.setdefault(n, []).append((k, v))
        name = found.get(1, [(2, b"")])[-1][1].decode("utf-8")
        extent = found.get(5, [(0, 4096)])[-1][1]
        if found.get(15, [(0, 1)])[-1][1] != 2 or not name or name in names:
            raise DecodeError("layers need version 2 and distinct names")
        names.add(name)
        if len(names) > limits.layers or not 0 < extent <= limits.extent:
            raise EngineError("SAFETY_LIMIT_EXCEEDED", "layers or extent")
        keys = [v.decode("utf-8") for _, v in found.get(3, [])]
        if len(set(keys)) < len(keys):
            raise DecodeError("repeated keys")
        budget.spend("features", len(found.get(2, [])))
        if wanted is not None and name not in wanted:
            continue
        values = [scalar(v) for _, v in found.get(4, [])]
        rows = []
        for _, v in found.get(2, []):
            parts: dict[int, list] = {}
            for n, k, w in fields(v):
                parts.setdefault(n, []).append((k, w))
            tags = packed(parts.get(2, []))
            budget.spend("tags", len(tags))
            if len(tags) % 2:
                raise DecodeError("an odd number of tags")
            props: dict[str, tuple] = {}
            for a, b in zip(tags[0::2], tags[1::2], strict=True):
                if a >= len(keys) or b >= len(values) or keys[a] in props:
                    raise DecodeError("bad tag")
                props[keys[a]] = values[b]
            geom = TYPES.get(parts.get(3, [(0, 0)])[-1][1])
            if geom is None:
                raise DecodeError("a feature without geometry type")
            shape, areas = geometry(packed(parts.get(4, [])), geom, extent, budget)
            rows.append({"id": parts[1][-1][1] if 1 in parts else None, "geom_type": geom, "props": props, "parts": shape, "ring_area2": areas})
        out.append({"name": name, "extent": extent, "features": rows})
    return out


def rows_of(data: bytes, limits: Limits = Limits(), wanted: set[str] | None = None) -> Iterator[tuple]:
    import decimal

    for layer in decode(data, limits, wanted):
        for i, f in enumerate(layer["features"]):
            props = {k: dict(zip("tbns", v, strict=True)) for k, v in f["props"].items()}
            parts = [[{"x": x, "y": y} for x, y in part] for part in f["parts"]]
            yield layer["name"], layer["extent"], i, None if f["id"] is None else decimal.Decimal(f["id"]), f["geom_type"], props, parts, f["ring_area2"]


def decode_tiles(tiles: DataFrame, wanted: list[str] | None = None, limits: Limits = Limits(), data: str = "data") -> DataFrame:
    """Feature rows of tiles (source_id, z, x, y, data); a malformed tile is an error."""
    names = set(wanted) if wanted is not None else None
    value = pa.struct([("t", pa.int8()), ("b", pa.bool_()), ("n", pa.float64()), ("s", pa.string())])
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.decimal128(20, 0), pa.string(), pa.map_(pa.string(), value), pa.list_(pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))), pa.list_(pa.float64())]
    columns = ["source_id", "z", "x", "y", "layer", "extent", "ord", "id", "geom_type", "props", "parts", "ring_area2"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.to_pylist():
                rows = [(t["source_id"], t["z"], t["x"], t["y"], *r) for r in rows_of(t["data"], limits, names)]
                made = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in kinds]
                made[9] = [list(p.items()) for p in made[9]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], columns)

    return tiles.selectExpr("source_id", "cast(z as int) z", "cast(x as int) x", "cast(y as int) y", f"{data} AS data").mapInArrow(read, SCHEMA)


def register(spark) -> None:
    """``mvt_decode(data)`` for SQL, as a table function with the columns from layer on."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=SCHEMA.split("y int, ", 1)[1])
    class MvtDecode:
        def eval(self, data: bytes):
            yield from rows_of(bytes(data))

    spark.udtf.register("mvt_decode", MvtDecode)


# ---- encoding


def _varint(n: int) -> bytes:
    n &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def encode(layers: list[dict]) -> bytes:
    """A tile of layers: name, extent and features (id, geom_type, props of plain values, parts)."""
    out = b""
    for layer in layers:
        keys: dict[str, int] = {}
        values: dict[bytes, int] = {}
        body = _field(15, 2) + _field(1, layer["name"].encode())
        for f in layer["features"]:
            tags: list[int] = []
            for k, v in f.get("props", {}).items():
                raw = _field(7, int(v)) if isinstance(v, bool) else _field(1, v.encode()) if isinstance(v, str) else _field(6, (v << 1) ^ (v >> 63)) if isinstance(v, int) else _varint(3 << 3 | 1) + struct.pack("<d", v)
                tags += [keys.setdefault(k, len(keys)), values.setdefault(raw, len(values))]
            words, x, y = [], 0, 0
            groups = [[p for part in f["parts"] for p in part]] if f["geom_type"] == "Point" else f["parts"]
            for part in groups:
                first = len(part) if f["geom_type"] == "Point" else 1
                for i, (px, py) in enumerate(part):
                    if i == 0:
                        words.append(first << 3 | MOVE)
                    elif i == 1 and f["geom_type"] != "Point":
                        words.append((len(part) - 1) << 3 | LINE)
                    words += [(px - x) << 1 ^ (px - x) >> 63, (py - y) << 1 ^ (py - y) >> 63]
                    x, y = px, py
                if f["geom_type"] == "Polygon":
                    words.append(1 << 3 | CLOSE)
            kind = {v: k for k, v in TYPES.items()}[f["geom_type"]]
            made = (_field(1, f["id"]) if f.get("id") is not None else b"") + _field(2, b"".join(map(_varint, tags))) + _field(3, kind) + _field(4, b"".join(map(_varint, words)))
            body += _field(2, made)
        body += b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, v) for v in values) + _field(5, layer.get("extent", 4096))
        out += _field(3, body)
    return out
