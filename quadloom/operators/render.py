"""Pixel kernels and the tile compositor: draw lists become RGBA arrays and PNGs, one tile at a time.

Coverage is sampled at pixel centres (without anti-aliasing), so pixels on edges differ from a drawing
library's; solid areas, colours, order and opacity are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quadloom.functions import pixels
from quadloom.operators.placement import dash_phase, offset_line
from quadloom.sources.raster import MAGIC, decode_png, encode_png


def blend(canvas: np.ndarray, rgb: tuple | np.ndarray, alpha: np.ndarray | float) -> None:
    """Lays a colour (or image) with alpha from 0 to 1 over the straight-alpha canvas."""
    a = np.broadcast_to(np.asarray(alpha, float), canvas.shape[:2])
    below = canvas[..., 3] / 255.0
    out = a + below * (1 - a)
    safe = np.where(out > 0, out, 1)[..., None]
    top = np.asarray(rgb, float)
    mixed = (top * a[..., None] + canvas[..., :3] * (below * (1 - a))[..., None]) / safe
    canvas[..., :3] = np.where(a[..., None] > 0, np.floor(mixed + 0.5), canvas[..., :3])
    canvas[..., 3] = np.where(a > 0, np.floor(out * 255 + 0.5), canvas[..., 3])


def grid(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.meshgrid(np.arange(shape[1]) + 0.5, np.arange(shape[0]) + 0.5)


def part_of(canvas: np.ndarray, points: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """The part of the canvas that the points and a margin reach (a view), and its corner."""
    low = np.maximum(0, np.floor(points.min(axis=0) - margin)).astype(int)
    high = np.maximum(low, np.ceil(points.max(axis=0) + margin).astype(int) + 1)
    return canvas[low[1] : high[1], low[0] : high[0]], low


def even_odd(rings: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Pixels whose centre is inside the rings, by the even-odd rule."""
    inside = np.zeros(shape, bool)
    across, centres = np.arange(shape[1]) + 0.5, np.arange(shape[0]) + 0.5
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            if y0 == y1:
                continue
            rows = np.flatnonzero((centres >= min(y0, y1)) & (centres < max(y0, y1)))
            cross = x0 + (centres[rows] - y0) * (x1 - x0) / (y1 - y0)
            inside[rows] ^= across[None, :] > cross[:, None]
    return inside


def distance_to(line: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel centre's distance to a polyline, and how far along it the nearest point is."""
    px, py = grid(shape)
    best, along, before = np.full(shape, np.inf), np.zeros(shape), 0.0
    for (x0, y0), (x1, y1) in zip(line, line[1:], strict=False):
        dx, dy = x1 - x0, y1 - y0
        length = math.hypot(dx, dy)
        t = np.clip(((px - x0) * dx + (py - y0) * dy) / max(length * length, 1e-12), 0, 1)
        d = np.hypot(px - x0 - t * dx, py - y0 - t * dy)
        near = d < best
        best, along = np.where(near, d, best), np.where(near, before + t * length, along)
        before += length
    return best, along


def fill(canvas, rings, rgba, opacity=1.0, outline=None, pattern=None, translate=(0, 0), phase=(0, 0)) -> None:
    moved = [np.asarray(r, float) + translate for r in rings]
    part, corner = part_of(canvas, np.concatenate(moved), 1)
    if not part.size:
        return
    moved = [r - corner for r in moved]
    inside = even_odd(moved, part.shape[:2])
    if pattern is not None:
        tiled = repeat_pattern(pattern, part.shape[:2], (phase[0] + corner[0], phase[1] + corner[1]))
        blend(part, tiled[..., :3], np.where(inside, tiled[..., 3] / 255.0 * opacity, 0))
        return
    blend(part, rgba[:3], np.where(inside, np.floor(rgba[3] * opacity + 0.5) / 255.0, 0))
    if outline is not None:
        for r in moved:
            d, _ = distance_to(np.vstack([r, r[:1]]), part.shape[:2])
            blend(part, outline[:3], np.where(d <= 0.5, outline[3] / 255.0 * opacity, 0))


def strokes(width: float, gap: float = 0, offset: float = 0) -> list[tuple[float, float]]:
    """(offset, width) of the strokes of a line: two beside a gap."""
    if width <= 0:
        return []
    return [(offset, width)] if gap <= 0 else [(offset - (gap + width) / 2, width), (offset + (gap + width) / 2, width)]


def dashes(dash: list[float], width: float) -> list[float]:
    """On and off lengths in pixels; an odd list counts twice."""
    return [v * width for v in (dash if len(dash) % 2 == 0 else [*dash, *dash])]


def line(canvas, points, rgba, width=1.0, opacity=1.0, gap=0.0, offset=0.0, blur=0.0, dash=None, translate=(0, 0), tile=(0, 0)) -> None:
    points = np.asarray(points, float) + translate
    for shift, w in strokes(width, gap, offset):
        path = offset_line(points, shift) if shift else points
        part, corner = part_of(canvas, path, w / 2 + blur)
        if not part.size:
            continue
        d, along = distance_to(path - corner, part.shape[:2])
        cover = np.clip((w / 2 + blur / 2 - d) / blur, 0, 1) if blur > 0 else (d <= w / 2).astype(float)
        if dash is not None:
            lengths = dashes(dash, width)
            at = (along + dash_phase(tuple(path[0]), tuple(path[1]), *tile, len(canvas), sum(lengths))) % sum(lengths)
            cover = cover * (np.searchsorted(np.cumsum(lengths), at, side="right") % 2 == 0)
        blend(part, rgba[:3], cover * np.floor(rgba[3] * opacity + 0.5) / 255.0)


def repeat_pattern(image: np.ndarray, shape: tuple[int, int], phase: tuple[float, float]) -> np.ndarray:
    """An image repeated over the tile, lined up with the world."""
    h, w, _ = image.shape
    return image[(np.arange(shape[0]) + int(phase[1])) % h][:, (np.arange(shape[1]) + int(phase[0])) % w]


def resample(image: np.ndarray, size: int, scale: int = 1, child: tuple[int, int] = (0, 0), nearest: bool = False) -> np.ndarray:
    """The window of a source image that an output tile shows, at ``size`` pixels."""
    h, w, _ = image.shape
    at = (np.arange(size) + 0.5) / size
    x, y = (child[0] + at) * w / scale - 0.5, (child[1] + at) * h / scale - 0.5
    if nearest:
        return image[np.clip(np.floor(y + 0.5).astype(int), 0, h - 1)][:, np.clip(np.floor(x + 0.5).astype(int), 0, w - 1)]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[None, :, None], (y - y0)[:, None, None]
    pick = lambda yy, xx: image[np.clip(yy, 0, h - 1)][:, np.clip(xx, 0, w - 1)].astype(float)
    out = (pick(y0, x0) * (1 - fx) + pick(y0, x0 + 1) * fx) * (1 - fy) + (pick(y0 + 1, x0) * (1 - fx) + pick(y0 + 1, x0 + 1) * fx) * fy
    return np.floor(out + 0.5).astype(np.uint8)


def raster(canvas, image, opacity=1.0, matrix=None, scale=1, child=(0, 0), nearest=False) -> None:
    shown = resample(image, len(canvas), scale, child, nearest)
    rgb = shown[..., :3].astype(float)
    if matrix is not None:
        full = np.concatenate([shown / 255.0, np.ones((*shown.shape[:2], 1))], axis=2)
        rgb = np.clip(np.floor(full @ matrix.T.astype(float) * 255 + 0.5), 0, 255)[..., :3]
    blend(canvas, rgb, shown[..., 3] / 255.0 * opacity)


def passes_through(data: bytes, layers: int, identity: bool, scale: int, size: int) -> bool:
    """Whether a stored PNG is the output as it is: one neutral raster layer of the right size."""
    return layers == 1 and identity and scale == 1 and data[:8] == MAGIC and int.from_bytes(data[16:20], "big") == int.from_bytes(data[20:24], "big") == size


def compose_children(images: list[np.ndarray], nearest: bool = False) -> np.ndarray:
    """Four child tiles in row order as one of the same size; heights aren't mixed."""
    whole = np.vstack([np.hstack(images[:2]), np.hstack(images[2:])])
    return resample(whole, len(images[0]), nearest=nearest)


def heights(rgb: np.ndarray, encoding: str) -> np.ndarray:
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    return r * 256 + g + b / 256 - 32768 if encoding == "terrarium" else -10000 + (r * 65536 + g * 256 + b) * 0.1


def hillshade(around: dict[tuple[int, int], np.ndarray], encoding: str, z: int, y: int, size: int, exaggeration=0.5, accent=(0, 0, 0, 255), highlight=(255, 255, 255, 255), shadow=(0, 0, 0, 255)) -> np.ndarray:
    """Shades from the elevation of a tile and its eight neighbours ((dx, dy) -> image); a missing one repeats
    the nearest row or column of the tile."""
    centre = heights(around[0, 0], encoding)
    h, w = centre.shape
    wide = np.pad(centre, 1, mode="edge")
    for (dx, dy), image in around.items():
        if (dx, dy) != (0, 0):
            e = heights(image, encoding)
            rows = {-1: (0, slice(-1, None)), 0: (slice(1, h + 1), slice(None)), 1: (h + 1, slice(0, 1))}[dy]
            cols = {-1: (0, slice(-1, None)), 0: (slice(1, w + 1), slice(None)), 1: (w + 1, slice(0, 1))}[dx]
            wide[rows[0], cols[0]] = np.squeeze(e[rows[1], cols[1]])
    world_y = (y * h + np.arange(h) + 0.5) / (2**z * h)
    metres = np.maximum(0.01, 40_075_016.68557849 * np.cos(np.arctan(np.sinh(np.pi * (1 - 2 * world_y)))) / (2**z * w))[:, None]
    gx, gy = (wide[1:-1, 2:] - wide[1:-1, :-2]) / (2 * metres), (wide[2:, 1:-1] - wide[:-2, 1:-1]) / (2 * metres)
    slope, flat = np.arctan(exaggeration * np.hypot(gx, gy)), math.sin(pixels.ALTITUDE)
    delta = flat * np.cos(slope) + math.cos(pixels.ALTITUDE) * np.sin(slope) * np.cos(pixels.AZIMUTH - np.arctan2(gy, -gx)) - flat
    out = np.zeros((h, w, 4), np.uint8)
    blend(out, accent[:3], np.clip(np.sin(slope) * pixels.ACCENT, 0, 1) * accent[3] / 255)
    light = delta >= 0
    shade = np.where(light, np.clip(delta / (1 - flat), 0, 1) * highlight[3] / 255, np.clip(-delta / (1 + flat), 0, 1) * shadow[3] / 255)
    blend(out, np.where(light[..., None], highlight[:3], shadow[:3]), shade)
    return resample(out, size, nearest=True)


def icon(canvas, sprite, cx, cy, width, height, turn=0.0, opacity=1.0, sdf=False, rgba=(0, 0, 0, 255), halo=(0, 0, 0, 0), halo_width=0.0, halo_blur=0.0) -> None:
    """A sprite centred, turned and scaled; a distance-field sprite takes a colour and a halo."""
    px, py = grid(canvas.shape[:2])
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    u = ((px - cx) * c + (py - cy) * s) / width + 0.5
    v = (-(px - cx) * s + (py - cy) * c) / height + 0.5
    inside = (u >= 0) & (u < 1) & (v >= 0) & (v < 1)
    h, w, _ = sprite.shape
    shown = sprite[np.clip((v * h).astype(int), 0, h - 1), np.clip((u * w).astype(int), 0, w - 1)]
    if not sdf:
        blend(canvas, shown[..., :3], np.where(inside, shown[..., 3] / 255.0 * opacity, 0))
        return
    field = shown[..., 3] / 255.0
    if halo_width > 0 and halo[3]:
        edge = 0.75 - halo_width / 8
        cover = np.clip((field - edge + halo_blur / 16) / max(halo_blur / 8, 1e-6), 0, 1)
        blend(canvas, halo[:3], np.where(inside, cover * halo[3] / 255.0 * opacity, 0))
    blend(canvas, rgba[:3], np.where(inside & (field >= 0.75), rgba[3] / 255.0 * opacity, 0))


def draw(commands: list[dict], size: int) -> np.ndarray:
    """The canvas after the commands (op and its arguments), in painter's order."""
    canvas = np.zeros((size, size, 4), np.uint8)
    for c in commands:
        if c["op"] == "background":
            blend(canvas, c["rgba"][:3], np.floor(c["rgba"][3] * c.get("opacity", 1.0) + 0.5) / 255.0)
        else:
            {"fill": fill, "line": line, "raster": raster, "icon": icon}[c["op"]](canvas, **{k: v for k, v in c.items() if k != "op"})
    return canvas


def render(drawn: DataFrame, size: int = 256) -> DataFrame:
    """PNGs of tiles from rows (z, x, y, layer_order, draw_order, op, rgba, opacity, width, parts): solid
    backgrounds, fills and lines; an error for any other op. A tile's rows meet in one group; the feature limit of a tile bounds it."""

    def one(key, g: pd.DataFrame) -> pd.DataFrame:
        commands = []
        for r in g.sort_values(["layer_order", "draw_order"], kind="stable").itertuples(index=False):
            shapes = [np.array([(p["x"], p["y"]) for p in part], float) for part in (r.parts if r.parts is not None else [])]
            if r.op == "background":
                commands.append({"op": "background", "rgba": tuple(r.rgba), "opacity": r.opacity})
            elif r.op == "fill":
                commands.append({"op": "fill", "rings": shapes, "rgba": tuple(r.rgba), "opacity": r.opacity})
            elif r.op == "line":
                commands += [{"op": "line", "points": s, "rgba": tuple(r.rgba), "opacity": r.opacity, "width": r.width} for s in shapes if len(s) > 1]
            else:
                raise ValueError(f"the compositor draws no {r.op!r} rows")
        return pd.DataFrame({"z": [key[0]], "x": [key[1]], "y": [key[2]], "png": [encode_png(draw(commands, size))]})

    return drawn.groupBy("z", "x", "y").applyInPandas(one, "z int, x long, y long, png binary")


def luma(png: bytes) -> float:
    """Mean brightness of an image."""
    p = decode_png(png)[..., :3].astype(int)
    return float(((p[..., 0] * 77 + p[..., 1] * 150 + p[..., 2] * 29) >> 8).mean())
