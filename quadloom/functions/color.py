"""CSS colours: parsing on the driver, and channel arithmetic as Columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMED = {"transparent": (0, 0, 0, 0), "black": (0, 0, 0, 255), "white": (255, 255, 255, 255)}
CALL = re.compile(r"(rgba?|hsla?)\((.*)\)", re.S)


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def clamped(x: float) -> int:
    return min(255, max(0, half_up(x)))


def parse(text: str) -> tuple[int, int, int, int] | None:
    """(r, g, b, a) from 0 to 255, alpha not multiplied in; None for anything else."""
    text = text.strip().lower()
    if text in NAMED:
        return NAMED[text]
    if re.fullmatch("#[0-9a-f]+", text):
        d = text[1:]
        if len(d) in (3, 4):
            d = "".join(c * 2 for c in d)
        if len(d) not in (6, 8):
            return None
        r, g, b, a = (int((d + "ff")[i : i + 2], 16) for i in (0, 2, 4, 6))
        return r, g, b, a
    call = CALL.fullmatch(text)
    if not call:
        return None
    name, parts = call[1], [p.strip() for p in call[2].split(",")]
    if len(parts) != (4 if name.endswith("a") else 3):
        return None
    try:
        alpha = clamped(_part(parts[3], 255.0)) if name.endswith("a") else 255
        if name.startswith("rgb"):
            return (*(clamped(_part(p, 1.0)) for p in parts[:3]), alpha)
        if not (parts[1].endswith("%") and parts[2].endswith("%")):
            return None
        hue = float(parts[0].removesuffix("deg"))
        s, lightness = (min(1.0, max(0.0, float(p[:-1]) / 100)) for p in parts[1:3])
        return (*(clamped(255 * c) for c in hsl(hue, s, lightness)), alpha)
    except ValueError:
        return None


def _part(text: str, scale: float) -> float:
    return float(text[:-1]) * 2.55 if text.endswith("%") else float(text) * scale


def hsl(hue: float, s: float, lightness: float) -> tuple[float, float, float]:
    """Channels from 0 to 1; each is the lightness less a trapezoid of the hue."""
    reach = s * min(lightness, 1 - lightness)
    k = [(n + (hue % 360) / 30) % 12 for n in (0, 8, 4)]
    r, g, b = (lightness - reach * max(-1.0, min(x - 3, 9 - x, 1.0)) for x in k)
    return r, g, b


def hsl_columns(hue: Column, s: Column, lightness: Column) -> list[Column]:
    """hsl() as Columns: 0 to 255, rounded half up."""
    reach = s * F.least(lightness, 1 - lightness)
    out = []
    for n in (0, 8, 4):
        k = F.pmod(F.lit(float(n)) + F.pmod(hue, F.lit(360.0)) / 30, F.lit(12.0))
        c = lightness - reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        out.append(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(c * 255, 9) + 0.5))).cast("int"))
    return out


def literal(color: tuple[int, int, int, int]) -> Column:
    return F.struct(*(F.lit(v).cast("int").alias(n) for n, v in zip("rgba", color, strict=True)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Channels interpolated, rounded half up and clamped."""
    mix = lambda n: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(a[n] + (b[n] - a[n]) * t + 0.5))).cast("int").alias(n)
    return F.struct(*(mix(n) for n in "rgba"))


def with_opacity(c: Column, opacity: Column) -> Column:
    """Alpha times opacity, rounded half up and clamped."""
    return F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c["a"] * opacity + 0.5))).cast("int").alias("a"))
