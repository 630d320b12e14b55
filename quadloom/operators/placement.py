"""Icon anchors and greedy placement.

Anchors come from the geometry of one feature; placement is serial within a tile (each accepted box blocks
later ones) and parallel over tiles. A tile's candidates meet in one Arrow group: the feature limit of a
tile bounds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFTS = {"left": (0.5, 0), "right": (-0.5, 0), "top": (0, 0.5), "bottom": (0, -0.5), "top-left": (0.5, 0.5), "top-right": (-0.5, 0.5), "bottom-left": (0.5, -0.5), "bottom-right": (-0.5, -0.5)}


def anchor_shift(anchor: str, width: Column, height: Column) -> tuple[Column, Column]:
    """How far the anchor moves an icon's centre."""
    x, y = SHIFTS.get(anchor, (0, 0))
    return width * x, height * y


def along(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of x, y and degrees at the distances ``at`` along a polyline."""
    steps = np.diff(points, axis=0)
    lengths = np.hypot(steps[:, 0], steps[:, 1])
    ends = np.cumsum(lengths)
    k = np.minimum(np.searchsorted(ends, at, side="left"), len(lengths) - 1)
    while (lengths[k] == 0).any() and (k[lengths[k] == 0] > 0).all():
        k = np.where(lengths[k] == 0, k - 1, k)
    share = np.clip((at - (ends[k] - lengths[k])) / np.where(lengths[k] > 0, lengths[k], 1), 0, 1)
    place = points[k] + steps[k] * share[:, None]
    return np.column_stack([place, np.degrees(np.arctan2(steps[k, 1], steps[k, 0]))])


def midpoint(points: np.ndarray) -> np.ndarray:
    total = np.hypot(*np.diff(points, axis=0).T).sum() if len(points) > 1 else 0.0
    return np.array([[*points[-1], 0.0]]) if total == 0 else along(points, np.array([total / 2]))


def repeated(points: np.ndarray, spacing: float) -> np.ndarray:
    """Anchors at half the spacing and each spacing on; at the middle where the line is shorter."""
    total = np.hypot(*np.diff(points, axis=0).T).sum() if len(points) > 1 else 0.0
    if total <= 0:
        return np.zeros((0, 3))
    first = total / 2 if total < spacing else spacing / 2
    return along(points, first + spacing * np.arange(int((total - first) // spacing) + 1))


def anchors(geom_type: str, parts: list, placement: str, spacing: float) -> np.ndarray:
    """Anchors of a feature in pixels: points, line middles, or the vertex mean of the first ring; along
    lines repeated at the spacing."""
    shapes = [np.array([(p["x"], p["y"]) for p in part], float) for part in parts if len(part)]
    if placement == "line":
        found = [repeated(s, spacing) for s in shapes] if geom_type == "LineString" else []
    elif geom_type == "Point":
        found = [np.column_stack([s, np.zeros(len(s))]) for s in shapes]
    elif geom_type == "LineString":
        found = [midpoint(s) for s in shapes]
    else:
        found = [np.array([[*shapes[0].mean(axis=0), 0.0]])] if shapes else []
    return np.concatenate(found) if found else np.zeros((0, 3))


def offset_line(points: np.ndarray, distance: float) -> np.ndarray:
    """A polyline moved sideways along the averaged unit normals of its segments."""
    steps = np.diff(points, axis=0)
    lengths = np.maximum(np.hypot(steps[:, 0], steps[:, 1]), 1e-12)
    normals = np.column_stack([-steps[:, 1], steps[:, 0]]) / lengths[:, None]
    mean = np.vstack([normals[:1], (normals[:-1] + normals[1:]) / 2, normals[-1:]])
    size = np.hypot(mean[:, 0], mean[:, 1])
    return points + mean / np.where(size > 1e-12, size, 1)[:, None] * distance


def dash_phase(first: tuple, second: tuple, tile_x: int, tile_y: int, size: int, period: float) -> float:
    """Where in its period a dash starts, so that neighbouring tiles agree."""
    dx, dy = second[0] - first[0], second[1] - first[1]
    length = math.hypot(dx, dy)
    if length <= 0 or period <= 0:
        return 0.0
    return ((tile_x * size + first[0]) * dx + (tile_y * size + first[1]) * dy) / length % period


def overlaps(a: list[Column], b: list[Column]) -> Column:
    """Whether two boxes (left, top, right, bottom) overlap; touching doesn't count."""
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def owned(x: Column, y: Column, size: int) -> Column:
    """Half-open ownership of a centre, so that seams hold each icon once."""
    return (x >= 0) & (x < size) & (y >= 0) & (y < size)


def candidates(icons: DataFrame, size: int = 512, placement: str = "point", padding: float = 2.0, avoid_edges: bool = False) -> DataFrame:
    """Boxes of icons (tile, layer_order, ord, geom_type, parts in pixels, width, height, spacing, sort_key,
    dx, dy): one row for each anchor whose centre the tile owns."""

    def spread(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups:
            rows = []
            for r in g.itertuples(index=False):
                for i, (x, y, turn) in enumerate(anchors(r.geom_type, r.parts, placement, r.spacing)):
                    rows.append((r.z, r.x, r.y, r.layer_order, r.ord * 1_000_000 + i, r.sort_key, x + r.dx, y + r.dy, turn, r.width, r.height))
            yield pd.DataFrame(rows, columns=["z", "x", "y", "layer_order", "stable_order", "sort_key", "cx", "cy", "turn", "width", "height"])

    schema = "z int, x long, y long, layer_order int, stable_order long, sort_key double, cx double, cy double, turn double, width double, height double"
    made = icons.select(F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "layer_order", "ord", "geom_type", "parts", "spacing", "sort_key", "dx", "dy", "width", "height").mapInPandas(spread, schema)
    half_w, half_h = F.col("width") / 2 + padding, F.col("height") / 2 + padding
    boxed = made.filter(owned(F.col("cx"), F.col("cy"), size)).withColumns({"left": F.col("cx") - half_w, "top": F.col("cy") - half_h, "right": F.col("cx") + half_w, "bottom": F.col("cy") + half_h})
    return boxed.filter((F.col("left") >= 0) & (F.col("top") >= 0) & (F.col("right") <= size) & (F.col("bottom") <= size)) if avoid_edges else boxed


def greedy(boxes: np.ndarray, allow: np.ndarray) -> np.ndarray:
    """Which boxes are accepted, in order: those that overlap no accepted one, or may overlap."""
    kept = np.zeros(len(boxes), bool)
    for i, (left, top, right, bottom) in enumerate(boxes):
        b = boxes[:i][kept[:i]]
        kept[i] = allow[i] or not ((left < b[:, 2]) & (right > b[:, 0]) & (top < b[:, 3]) & (bottom > b[:, 1])).any()
    return kept


def place(boxed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The accepted rows of boxed (left, top, right, bottom, allow_overlap), layers from the top down, then
    by ``order``."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["layer_order", *order], ascending=[False, *[True] * len(order)], kind="stable")
        return g[greedy(g[["left", "top", "right", "bottom"]].to_numpy(float), g["allow_overlap"].to_numpy(bool))]

    return boxed.groupBy(*keys).applyInPandas(one, boxed.schema)
