"""Closed code lists, limits and errors of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Kind(Enum):
    """Static types of style expressions; VALUE is known only at run time."""

    NULL = "null"
    BOOLEAN = "boolean"
    NUMBER = "number"
    STRING = "string"
    ARRAY = "array"
    OBJECT = "object"
    IMAGE = "image"
    COLOR = "color"
    VALUE = "value"


#: Fixed code lists.
ERROR_CODES = (
    "STYLE_PREPARATION_FAILED", "RESOURCE_ACQUISITION_FAILED", "RESOURCE_DECODE_FAILED", "RASTERIZATION_FAILED", "PNG_ENCODING_FAILED", "RESOURCE_STORE_FAILED",
    "SAFETY_LIMIT_EXCEEDED", "PREPARED_BATCH_CLOSED", "RASTERIZER_CLOSED", "FOREIGN_PREPARED_STYLE", "FOREIGN_PREPARED_BATCH", "INVALID_TILE_ID",
    "TILE_NOT_IN_PREPARED_BATCH", "TILE_SUBSTITUTION_LIMIT_EXCEEDED", "TILE_SUBSTITUTION_FAILED", "BATCH_RENDER_FAILED",
)
METRICS = (
    "RESOURCE_REQUEST", "RESOURCE_WIRE_BYTES", "RESOURCE_DECODED_BYTES", "RAW_CACHE_HIT", "RAW_CACHE_MISS", "SINGLE_FLIGHT_JOIN",
    "TILE_RESOURCE_SUBSTITUTED", "TILE_EXACT_RECOVERED", "TILE_RENDERED", "PNG_ENCODED_BYTES",
)
RESOURCE_CLASSES = ("STYLE", "TILE_JSON", "VECTOR_TILE", "RASTER_TILE", "DEM_TILE", "SPRITE_JSON", "SPRITE_IMAGE", "GEO_JSON")
ACCESS_MODES = ("NORMAL", "CACHE_ONLY", "RELOAD")


class EngineError(Exception):
    """An error with one of ERROR_CODES."""

    def __init__(self, code: str, message: str, tiles: list | None = None):
        assert code in ERROR_CODES
        super().__init__(f"{code}: {message}")
        self.code, self.tiles = code, tiles or []


class StyleError(EngineError):
    def __init__(self, message: str):
        super().__init__("STYLE_PREPARATION_FAILED", message)


class DecodeError(EngineError):
    def __init__(self, message: str):
        super().__init__("RESOURCE_DECODE_FAILED", message)


@dataclass(frozen=True)
class Limits:
    """Safety limits; the defaults are fixed values."""

    style_bytes: int = 8 << 20
    metadata_bytes: int = 4 << 20
    tile_bytes: int = 32 << 20
    sprite_bytes: int = 32 << 20
    geojson_bytes: int = 64 << 20
    raster_side: int = 8192
    raster_bytes: int = 256 << 20
    layers: int = 512
    features: int = 500_000
    tags: int = 4_000_000
    commands: int = 8_000_000
    coordinates: int = 8_000_000
    extent: int = 65_536


@dataclass(frozen=True)
class Diagnostic:
    code: str
    severity: str
    stage: str
    message: str
    details: dict = field(default_factory=dict)
