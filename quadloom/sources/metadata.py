"""TileJSON and sprite indexes: reading and validation on the driver (documents of limited size)."""

from __future__ import annotations

import json
import math
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import identity
from quadloom.types import DecodeError, Limits

SOURCES = "source_id string, kind string, templates array<string>, scheme string, min_zoom int, max_zoom int, west double, south double, east double, north double, tile_size int, encoding string"
SPRITES = "name string, x int, y int, width int, height int, pixel_ratio double, sdf boolean"


def resolve(base: str, reference: str) -> str:
    """An absolute http or https URL, dot segments removed."""
    out = urljoin(base, reference)
    if urlsplit(out).scheme not in ("http", "https") or not urlsplit(out).netloc:
        raise DecodeError(f"not an http reference: {identity.redact_text(reference)}")
    return out


def bounds_of(value) -> tuple[float, float, float, float]:
    if value is None:
        return -180.0, -90.0, 180.0, 90.0
    ok = isinstance(value, list) and len(value) == 4 and all(isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v) for v in value)
    if not ok or abs(value[0]) > 180 or abs(value[2]) > 180 or abs(value[1]) > 90 or abs(value[3]) > 90 or value[1] > value[3]:
        raise DecodeError(f"bad bounds {value!r}")
    return tuple(map(float, value))


def tilejson(text: str | bytes, url: str, limits: Limits = Limits()) -> dict:
    """templates, scheme, zooms, tile_size, bounds and digest of a TileJSON document."""
    raw = text.encode() if isinstance(text, str) else text
    if len(raw) > limits.metadata_bytes:
        raise DecodeError("the document is too long")
    try:
        d = json.loads(raw)
    except ValueError as e:
        raise DecodeError("not JSON") from e
    if not isinstance(d, dict) or not str(d.get("tilejson", "")).startswith(("2.", "3.")):
        raise DecodeError("TileJSON 2 or 3 is needed")
    found = d.get("tiles")
    if not isinstance(found, list) or not found or not all(isinstance(t, str) for t in found):
        raise DecodeError("no tile templates")
    low, high = d.get("minzoom", 0), d.get("maxzoom", 30)
    if not all(isinstance(z, int) and 0 <= z <= 30 for z in (low, high)) or low > high:
        raise DecodeError("bad zoom range")
    scheme, size = d.get("scheme", "xyz"), d.get("tileSize", 512)
    if scheme not in ("xyz", "tms") or size not in (64, 256, 512):
        raise DecodeError("bad scheme or tile size")
    out = {"templates": [resolve(url, t) for t in found], "scheme": scheme, "min_zoom": low, "max_zoom": high, "tile_size": size, "bounds": bounds_of(d.get("bounds"))}
    return out | {"digest": identity.digest(identity.canonical_json(identity.redact_json(out | {"bounds": list(out["bounds"])})))}


def png_side(data: Column, which: str) -> Column:
    """Width or height from a PNG's header."""
    return F.conv(F.hex(F.substring(data, 17 if which == "width" else 21, 4)), 16, 10).cast("long")


def sprite_url(base: str, extension: str) -> str:
    """The extension goes before a query or fragment."""
    cut = min((i for i in (base.find("?"), base.find("#")) if i >= 0), default=len(base))
    return base[:cut] + extension + base[cut:]


def sprites(spark: SparkSession, index: str, width: int, height: int) -> DataFrame:
    """The atlas as rows; entries must lie in the image and can't stretch."""
    try:
        d = json.loads(index)
    except ValueError as e:
        raise DecodeError("not JSON") from e
    if not isinstance(d, dict) or len(d) > 100_000:
        raise DecodeError("bad sprite index")
    rows = []
    for name, s in d.items():
        if not isinstance(s, dict) or {"stretchX", "stretchY", "content"} & s.keys():
            raise DecodeError(f"unsupported sprite {name!r}")
        x, y, w, h = (s.get(k) for k in ("x", "y", "width", "height"))
        ratio = s.get("pixelRatio", 1)
        if not all(isinstance(v, int) and not isinstance(v, bool) for v in (x, y, w, h)) or min(x, y) < 0 or min(w, h) <= 0 or x + w > width or y + h > height or not ratio > 0:
            raise DecodeError(f"sprite {name!r} is outside the image")
        rows.append((name, x, y, w, h, float(ratio), bool(s.get("sdf", False))))
    return spark.createDataFrame(rows, SPRITES)


def sprite_digest(index: bytes, image: bytes) -> str:
    return identity.digest(identity.digest(index), identity.digest(image))
