"""PNG coding with zlib and numpy, and raster scans with their limits."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadloom.types import DecodeError, Limits

MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def encode_png(rgba: np.ndarray) -> bytes:
    """An (h, w, 4) array of bytes, alpha not multiplied in."""
    h, w, _ = rgba.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgba.astype(np.uint8).reshape(h, w * 4)], axis=1).tobytes()
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes, limits: Limits = Limits()) -> np.ndarray:
    """(h, w, 4) bytes of an 8-bit, not interlaced PNG."""
    if data[:8] != MAGIC or len(data) < 33:
        raise DecodeError("not a PNG")
    w, h, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", data[16:29])
    if not 0 < w <= limits.raster_side or not 0 < h <= limits.raster_side or w * h * 4 > limits.raster_bytes:
        raise DecodeError("the image is too large")
    if depth != 8 or interlace or kind not in CHANNELS:
        raise DecodeError("only 8-bit PNGs without interlacing are read")
    at, body, palette, alpha = 8, b"", None, b""
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        body += part if name == b"IDAT" else b""
        palette = np.frombuffer(part, np.uint8).reshape(-1, 3) if name == b"PLTE" else palette
        alpha = part if name == b"tRNS" else alpha
        at += 12 + size
    n = CHANNELS[kind]
    try:
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    except (zlib.error, ValueError) as e:
        raise DecodeError("damaged image data") from e
    out = np.zeros((h, w, n), np.uint8)
    above = np.zeros((w, n), np.uint8)
    for y in range(h):
        out[y] = above = unfiltered(rows[y, 0], rows[y, 1:].reshape(w, n), above)
    full = np.full((h, w, 4), 255, np.uint8)
    if kind == 3:
        if palette is None:
            raise DecodeError("no palette")
        full[..., :3] = palette[out[..., 0]]
        if alpha:
            full[..., 3] = np.concatenate([np.frombuffer(alpha, np.uint8), np.full(256, 255, np.uint8)])[out[..., 0]]
    elif n <= 2:
        full[..., :3] = out[..., :1]
        if n == 2:
            full[..., 3] = out[..., 1]
    else:
        full[..., :n] = out
    return full


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0, dtype=np.uint8)
    if kind == 2:
        return line + above
    out = np.zeros(line.shape, np.int32)
    left = corner = np.zeros(line.shape[1], np.int32)
    for i in range(len(line)):
        up = above[i].astype(np.int32)
        if kind == 3:
            guess = (left + up) // 2
        elif kind == 4:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        else:
            raise DecodeError("unknown row filter")
        out[i] = left = (line[i] + guess) & 255
        corner = up
    return out.astype(np.uint8)


def measured(rasters: DataFrame, limits: Limits = Limits(), data: str = "data") -> DataFrame:
    """Adds width, height and problem (null where the image decodes within the limits)."""
    columns = rasters.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for d in b.column(data).to_pylist():
                try:
                    h, w, _ = decode_png(d or b"", limits).shape
                    found.append((w, h, None))
                except DecodeError as e:
                    found.append((None, None, str(e)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string())], [*columns, "width", "height", "problem"])

    return rasters.mapInArrow(read, ", ".join(f"{n} {t}" for n, t in rasters.dtypes) + ", width int, height int, problem string")
