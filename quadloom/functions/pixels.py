"""Per-pixel arithmetic as Columns, and colour matrices."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the light.
ALTITUDE, AZIMUTH, ACCENT = math.pi / 4, 335 * math.pi / 180, 0.28


def dem_height(r: Column, g: Column, b: Column, encoding: Column) -> Column:
    return F.when(encoding == "terrarium", r * 256.0 + g + b / 256.0 - 32768.0).otherwise(-10000.0 + (r * 65536 + g * 256 + b) * 0.1)


def identity_paint(opacity: Column, low: Column, high: Column, contrast: Column, hue: Column, saturation: Column) -> Column:
    return (opacity == 1) & (low == 0) & (high == 1) & (contrast == 0) & (hue % 360 == 0) & (saturation == 0)


def grey(scale: float, offset: float) -> np.ndarray:
    """A 4 x 5 matrix that scales and shifts the colour channels alike."""
    m = np.eye(4, 5, dtype=np.float32)
    m[:3, :3] *= np.float32(scale)
    m[:3, 4] = offset
    return m


def brightness_matrix(low: float, high: float) -> np.ndarray:
    return grey(high - low, low)


def contrast_matrix(contrast: float) -> np.ndarray:
    factor = 1 / (1 - min(contrast, 0.999)) if contrast > 0 else 1 + contrast
    return grey(factor, 0.5 * (1 - factor))


def saturation_matrix(saturation: float) -> np.ndarray:
    towards_grey = 1 - 1 / (1.001 - saturation) if saturation > 0 else -saturation
    m = np.eye(4, 5, dtype=np.float32)
    m[:3, :3] = towards_grey / 3 + np.eye(3) * (1 - towards_grey)
    return m


def hue_matrix(degrees: float) -> np.ndarray:
    """A turn about the grey axis."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    turn = [(2 * c + 1) / 3, (1 - c - math.sqrt(3) * s) / 3, (1 - c + math.sqrt(3) * s) / 3]
    m = np.eye(4, 5, dtype=np.float32)
    for i in range(3):
        for j in range(3):
            m[i, j] = turn[(j - i) % 3]
    return m


def compose(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    full = lambda m: np.vstack([m, [0, 0, 0, 0, 1]]).astype(np.float32)
    return (full(outer) @ full(inner))[:4]


def paint_matrix(hue: float = 0, saturation: float = 0, contrast: float = 0, low: float = 0, high: float = 1) -> np.ndarray:
    """Hue, then saturation, contrast and brightness; neutral ones are left out."""
    m = np.eye(4, 5, dtype=np.float32)
    if hue % 360:
        m = compose(hue_matrix(hue), m)
    if saturation:
        m = compose(saturation_matrix(saturation), m)
    if contrast:
        m = compose(contrast_matrix(contrast), m)
    if low or high != 1:
        m = compose(brightness_matrix(low, high), m)
    return m


def apply_matrix(m: np.ndarray, r: Column, g: Column, b: Column) -> list[Column]:
    """Channels from 0 to 255 through a matrix, rounded half up and clamped."""
    out = []
    for row in m.astype(float)[:3]:
        c = r / 255.0 * float(row[0]) + g / 255.0 * float(row[1]) + b / 255.0 * float(row[2]) + float(row[3] + row[4])
        out.append(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c * 255 + 0.5))).cast("int"))
    return out


def hillshade(left: Column, right: Column, up: Column, down: Column, metres: Column, exaggeration: float = 0.5) -> dict[str, Column]:
    """Slope, light against flat ground, and the strengths of accent and shade, from four neighbours."""
    gx, gy = (right - left) / (2 * metres), (down - up) / (2 * metres)
    slope = F.atan(exaggeration * F.sqrt(gx * gx + gy * gy))
    aspect = F.atan2(gy, -gx)
    flat = math.sin(ALTITUDE)
    delta = flat * F.cos(slope) + math.cos(ALTITUDE) * F.sin(slope) * F.cos(AZIMUTH - aspect) - flat
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return {"slope": slope, "delta": delta, "accent_alpha": unit(F.sin(slope) * ACCENT), "shade_alpha": F.when(delta >= 0, unit(delta / (1 - flat))).otherwise(unit(-delta / (1 + flat)))}


def over(base: Column, base_alpha: Column, top: Column, top_alpha: Column) -> tuple[Column, Column]:
    """One straight-alpha channel laid over another: (channel, alpha)."""
    alpha = top_alpha + base_alpha * (1 - top_alpha)
    channel = F.when(alpha > 0, F.greatest(F.lit(0), F.least(F.lit(255), F.floor((top * top_alpha + base * base_alpha * (1 - top_alpha)) / alpha + 0.5)))).otherwise(0)
    return channel.cast("int"), alpha
