"""Style documents to programs: validation, layer selection, typed properties, sources, diagnostics and digest."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import color, identity
from quadloom.functions.expr import Context, Node, compile_filter, compile_property, with_default
from quadloom.sources import metadata
from quadloom.types import Diagnostic, DecodeError, EngineError, Kind, Limits, StyleError

SEMANTICS = "quadloom-style-1"
#: Root members that are left out of the program, with an INFO each.
EXCLUDED_ROOTS = ("bearing", "center", "fog", "light", "pitch", "projection", "sky", "snow", "terrain", "zoom")
LABEL_KEYS = ("filter", "id", "layout", "maxzoom", "minzoom", "paint", "source", "source-layer", "type")
N, C, A, S = Kind.NUMBER, Kind.COLOR, Kind.ARRAY, Kind.STRING
OPACITY, POSITIVE, PAIR = "opacity", "non-negative", "pair"
#: Layer type -> paint or layout key -> (type, default, rule); a tuple of strings is a constant of that list.
PROPERTIES: dict[str, dict[str, tuple]] = {
    "background": {"background-color": (C, "#000000", None), "background-opacity": (N, 1, OPACITY), "background-pattern": (S, "", None)},
    "fill": {
        "fill-antialias": (bool, True, None), "fill-color": (C, "#000000", None), "fill-opacity": (N, 1, OPACITY), "fill-outline-color": (C, None, None),
        "fill-pattern": (S, "", None), "fill-translate": (A, [0, 0], PAIR), "fill-translate-anchor": (("map", "viewport"), "map", None),
    },
    "fill-extrusion": {
        "fill-extrusion-color": (C, "#000000", None), "fill-extrusion-opacity": (N, 1, OPACITY), "fill-extrusion-base": (N, 0, None),
        "fill-extrusion-height": (N, 0, None), "fill-extrusion-vertical-gradient": (bool, True, None), "fill-extrusion-translate": (A, [0, 0], PAIR),
        "fill-extrusion-translate-anchor": (("map", "viewport"), "map", None), "fill-extrusion-pattern": (S, "", None),
    },
    "line": {
        "line-cap": (("butt", "round", "square"), "butt", None), "line-join": (("miter", "bevel", "round"), "miter", None), "line-round-limit": (float, 1.05, None),
        "line-miter-limit": (N, 2, POSITIVE), "line-sort-key": (N, None, None), "line-color": (C, "#000000", None), "line-opacity": (N, 1, OPACITY),
        "line-width": (N, 1, POSITIVE), "line-blur": (N, 0, POSITIVE), "line-gap-width": (N, 0, POSITIVE), "line-offset": (N, 0, None), "line-dasharray": (A, None, "dash"),
        "line-pattern": (S, "", None), "line-translate": (A, [0, 0], PAIR), "line-translate-anchor": (("map", "viewport"), "map", None),
    },
    "symbol": {
        "symbol-placement": (("point", "line"), "point", None), "icon-rotation-alignment": (("auto", "map", "viewport"), "auto", None),
        "icon-anchor": (("center", "left", "right", "top", "bottom", "top-left", "top-right", "bottom-left", "bottom-right"), "center", None),
        "icon-allow-overlap": (bool, False, None), "icon-overlap": (("never", "always", "cooperative"), "never", None), "icon-padding": (float, 2, None),
        "symbol-avoid-edges": (bool, False, None), "symbol-z-order": (("auto", "viewport-y", "source"), "auto", None), "icon-image": (S, None, None),
        "icon-size": (N, 1, None), "icon-opacity": (N, 1, OPACITY), "icon-color": (C, "#000000", None), "icon-halo-color": (C, "transparent", None),
        "icon-halo-width": (N, 0, POSITIVE), "icon-halo-blur": (N, 0, POSITIVE), "icon-rotate": (N, 0, None), "icon-offset": (A, [0, 0], PAIR),
        "icon-translate": (A, [0, 0], PAIR), "icon-translate-anchor": (("map", "viewport"), "map", None), "symbol-spacing": (N, 250, "positive"),
        "symbol-sort-key": (N, None, None), "icon-optional": (bool, False, None), "icon-text-fit": (("none", "width", "height", "both"), "none", None),
    },
    "raster": {
        "raster-opacity": (N, 1, OPACITY), "raster-brightness-min": (N, 0, OPACITY), "raster-brightness-max": (N, 1, OPACITY), "raster-contrast": (N, 0, "signed"),
        "raster-hue-rotate": (N, 0, None), "raster-saturation": (N, 0, "signed"), "raster-resampling": (("linear", "nearest"), "linear", None), "raster-fade-duration": (float, 300, None),
    },
    "hillshade": {"hillshade-accent-color": (C, "#000000", None), "hillshade-highlight-color": (C, "#ffffff", None), "hillshade-shadow-color": (C, "#000000", None), "hillshade-exaggeration": (N, 0.5, POSITIVE)},
}
SOURCE_OF = {"fill": ("vector",), "fill-extrusion": ("vector",), "line": ("vector", "geojson"), "symbol": ("vector",), "raster": ("raster",), "hillshade": ("raster-dem",), "background": ()}


#: Properties of extrusions that flat drawing has no use for.
FLAT = ("fill-extrusion-base", "fill-extrusion-height")


@dataclass
class Layer:
    id: str
    kind: str
    order: int
    source: str | None
    source_layer: str | None
    min_zoom: float
    max_zoom: float
    filter: Any
    values: dict[str, Any]
    nodes: dict[str, Node]

    def project(self, features: DataFrame, images: list[str] | None = None) -> DataFrame:
        """The rows of this layer's source (``source_id``) and source layer with a column for each property; an invalid
        value is an error there. Heights of extrusions are not evaluated: they are drawn flat."""
        ctx = Context(images=(lambda name: name.isin(images or [])) if self.kind == "symbol" else (lambda name: F.lit(False)))
        kept = features.filter((F.col("z") >= self.min_zoom) & (F.col("z") < self.max_zoom))
        if self.kind != "background":
            kept = kept.filter(F.col("source_id") == self.source)
            kept = kept.filter(F.col("layer") == self.source_layer) if self.source_layer else kept
            kind = {"fill": "Polygon", "fill-extrusion": "Polygon", "line": "LineString"}.get(self.kind)
            kept = kept.filter(F.col("geom_type") == kind) if kind else kept
            kept = kept.filter(compile_filter(self.filter)(ctx))
        names = PROPERTIES[self.kind]
        out = kept.withColumns({k.replace("-", "_"): guarded(self.nodes[k], ctx, k, names[k][0], names[k][2]) for k in self.nodes if k not in FLAT}).withColumn("layer_order", F.lit(self.order))
        if self.kind == "raster":
            low, high = F.col("raster_brightness_min"), F.col("raster_brightness_max")
            out = out.withColumn("raster_brightness_max", F.when(low <= high, high).otherwise(F.raise_error(F.lit("raster-brightness-min is above raster-brightness-max")).cast("double")))
        return out


@dataclass
class Prepared:
    layers: list[Layer]
    sources: dict[str, dict]
    diagnostics: list[Diagnostic]
    digest: str
    labels: list[dict] = field(default_factory=list)
    terrain: dict | None = None
    ground: tuple[float, float, float] | None = None
    owner: object = field(default=None, compare=False, repr=False)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The layers, sources and diagnostics as rows."""
        layers = [(x.id, x.kind, x.order, x.source, x.source_layer, float(x.min_zoom), float(x.max_zoom)) for x in self.layers]
        sources = [(k, s["kind"], s["templates"], s["scheme"], s["min_zoom"], s["max_zoom"], *s["bounds"], s["tile_size"], s.get("encoding")) for k, s in self.sources.items() if s["kind"] != "geojson"]
        return (
            spark.createDataFrame(layers, "layer_id string, kind string, layer_order int, source_id string, source_layer string, min_zoom double, max_zoom double"),
            spark.createDataFrame(sources, metadata.SOURCES),
            spark.createDataFrame([(d.code, d.severity, d.stage, d.message, {k: str(v) for k, v in d.details.items()}) for d in self.diagnostics], "code string, severity string, stage string, message string, details map<string,string>"),
        )


COLOR = "struct<r:int,g:int,b:int,a:int>"


def css_colors():
    """Colours of texts (all channels null where a text is none); each distinct text of a batch is parsed once."""

    @F.pandas_udf(COLOR)
    def parsed(texts: pd.Series) -> pd.DataFrame:
        known = {t: color.parse(t) for t in texts.dropna().unique()}
        return pd.DataFrame([known.get(t) or (None,) * 4 for t in texts], columns=list("rgba"), dtype="Int32")

    return parsed


def guarded(node: Node, ctx: Context, name: str, kind: Any, rule: str | None):
    """The value, or an error where it is none or outside its rule."""
    if kind is C:
        none = F.raise_error(F.lit(f"{name} is no colour")).cast(COLOR)
        if node.kind is Kind.VALUE:  # text from a feature
            found = css_colors()(node.read(ctx, S))
            return F.when(found["r"].isNotNull(), found).otherwise(none)
        return F.coalesce(node.make(ctx), none) if node.kind is C else none
    if kind is A:
        c = node.make(ctx)
        ok = {PAIR: F.size(c) == 2, "dash": (F.size(c) >= 2) & F.forall(c, lambda v: v >= 0) & (F.aggregate(c, F.lit(0.0), lambda a, v: a + v) > 0)}.get(rule, F.lit(True))
    else:
        c = node.read(ctx, kind)
        finite = ~F.isnan(c) & (F.abs(c) != math.inf) if kind is N else F.lit(True)
        ok = finite & {OPACITY: (c >= 0) & (c <= 1), POSITIVE: c >= 0, "signed": (c >= -1) & (c <= 1), "positive": c > 0}.get(rule, F.lit(True))
    if name in ("line-sort-key", "symbol-sort-key"):
        return F.coalesce(c, F.lit(0.0))
    if name in ("icon-image", "line-dasharray"):
        return c
    return F.when(F.coalesce(ok, F.lit(False)), c).otherwise(F.raise_error(F.lit(f"{name} is outside its range")).cast(c_type(kind)))


def c_type(kind: Any) -> str:
    return {N: "double", A: "array<double>"}.get(kind, "string")


def classify_symbol(layout: dict, hidden: bool) -> tuple[bool, str | None]:
    """Whether a symbol layer is retained, and the diagnostic; the first row that fits decides."""
    image, text = layout.get("icon-image"), layout.get("text-field")
    optional = layout.get("text-optional") is True and layout.get("icon-text-fit", "none") == "none"
    if image is None:
        return False, "TEXT_ONLY_LAYER_EXCLUDED"
    if image == "":
        return False, "EMPTY_ICON_IMAGE_NO_DRAW"
    if hidden:
        return False, "HIDDEN_LAYER_NO_DRAW"
    if text in (None, ""):
        return True, None
    return (True, "TEXT_COMPONENT_REMOVED_ICON_RETAINED") if optional else (False, "TEXT_COUPLED_ICON_LAYER_EXCLUDED")


def needs_sprite(layer: dict) -> bool:
    """Whether a layer names an image or a pattern."""
    found = {**layer.get("layout", {}), **layer.get("paint", {})}
    return any(found.get(k) not in (None, "") for k in ("icon-image", "background-pattern", "fill-pattern", "line-pattern"))


def prepare(document: bytes | str | dict, base_url: str = "https://localhost/", tilejson: dict[str, str] | None = None, policy: str = "default", limits: Limits = Limits()) -> Prepared:
    """The program of a style document; EngineError with all problems of its layers where it has any."""
    if not isinstance(document, dict):
        raw = document.encode() if isinstance(document, str) else document
        if len(raw) > limits.style_bytes:
            raise EngineError("SAFETY_LIMIT_EXCEEDED", "the style is too long")
        try:
            document = json.loads(raw)
        except ValueError as e:
            raise StyleError("not JSON") from e
    if not isinstance(document, dict) or document.get("version") != 8:
        raise StyleError("a style of version 8 is needed")
    if "imports" in document:
        raise StyleError("imports are not supported")
    entries = document.get("layers")
    ids = [x.get("id") for x in entries] if isinstance(entries, list) and all(isinstance(x, dict) for x in entries) else None
    if ids is None or not all(isinstance(i, str) for i in ids) or len(set(ids)) < len(ids):
        raise StyleError("layers need distinct string ids")
    notes = [Diagnostic("ROOT_PROPERTY_EXCLUDED", "INFO", "COMPILE", f"{k} is left out", {"key": k}) for k in EXCLUDED_ROOTS if k in document]
    layers, sources, labels, problems = [], {}, [], []
    for order, entry in enumerate(entries):
        try:
            made = _layer(entry, order, document.get("sources", {}), sources, base_url, tilejson or {}, notes, labels)
            layers += [made] if made else []
        except (StyleError, DecodeError) as e:
            problems.append(f"{entry['id']}: {e}")
    if problems:
        raise StyleError("; ".join(problems))
    terrain = _terrain(document, base_url, tilejson or {})
    canonical = identity.canonical_json(identity.redact_json(document))
    digest = identity.digest(SEMANTICS, policy, canonical, *sorted({s["digest"] for s in sources.values()}))
    return Prepared(layers, sources, notes, digest, labels, terrain, ground_radiance(document))


def _layer(e: dict, order: int, declared: dict, sources: dict, base: str, tilejson: dict, notes: list, labels: list) -> Layer | None:
    kind, layout, paint = e.get("type"), e.get("layout") or {}, e.get("paint") or {}
    note = lambda code, severity="INFO": notes.append(Diagnostic(code, severity, "COMPILE", f"{e['id']}: {code}", {"layer": e["id"]}))
    if kind not in PROPERTIES:
        raise StyleError(f"unsupported layer type {kind!r}")
    low, high = e.get("minzoom", 0), e.get("maxzoom", 31)
    if not all(isinstance(z, int | float) and not isinstance(z, bool) and math.isfinite(z) for z in (low, high)) or low > high:
        raise StyleError("bad zoom range")
    hidden = layout.get("visibility", "visible") == "none"
    if kind == "symbol" and layout.get("text-field") not in (None, "") and not hidden and e.get("source-layer") == "place":
        labels.append({k: e[k] for k in LABEL_KEYS if k in e})
    if kind == "symbol":
        retained, code = classify_symbol(layout, hidden)
        if code:
            note(code, "WARNING" if code.startswith("TEXT_COMPONENT") else "INFO")
        if not retained:
            return None
    elif hidden:
        note("HIDDEN_LAYER_NO_DRAW")
        return None
    names = PROPERTIES[kind]
    given = {k: v for k, v in {**layout, **paint}.items() if k != "visibility" and not (kind == "symbol" and k.startswith("text-"))}
    if unknown := sorted(given.keys() - names.keys()):
        raise StyleError(f"unsupported properties {unknown}")
    values, nodes = {}, {}
    for name, (typ, default, _) in names.items():
        value = given.get(name, default)
        if isinstance(typ, tuple):
            if value not in typ:
                raise StyleError(f"{name} must be one of {typ}")
            values[name] = value
        elif typ in (bool, float):
            if not isinstance(value, bool if typ is bool else int | float):
                raise StyleError(f"{name} must be a constant {typ.__name__}")
            values[name] = value
        elif value is not None:
            node = with_default(value, default, typ) if kind == "symbol" and default is not None else compile_property(value, typ)
            if node.kind not in (typ, Kind.VALUE, Kind.NULL, *((Kind.IMAGE,) if typ is S else ())):
                raise StyleError(f"{name} must be {typ.value}, found {node.kind.value}")
            nodes[name] = node
    if kind == "symbol" and values["symbol-placement"] == "line" and values["icon-rotation-alignment"] == "viewport":
        raise StyleError("icons along lines turn with the map")
    source, source_layer = e.get("source"), e.get("source-layer")
    if kind == "fill-extrusion":
        note("FILL_EXTRUSION_FLATTENED")
    if SOURCE_OF[kind]:
        if source not in sources:
            if not isinstance(source, str) or not isinstance(declared.get(source), dict):
                raise StyleError(f"no source {source!r}")
            sources[source] = compile_source(declared[source], base, tilejson)
        got = sources[source]["kind"]
        if got not in SOURCE_OF[kind]:
            raise StyleError(f"{kind} layers can't draw {got} sources")
        if got == "vector" and not isinstance(source_layer, str) or got == "geojson" and source_layer is not None:
            raise StyleError("source-layer is needed for vector sources and forbidden for geojson")
        if kind in ("raster", "hillshade"):
            low = max(low, sources[source]["min_zoom"])
    compile_filter(e.get("filter"))
    return Layer(e["id"], kind, order, source, source_layer, low, high, e.get("filter"), values, nodes)


def compile_source(d: dict, base: str, tilejson: dict[str, str]) -> dict:
    """A source's templates, zooms, bounds and digest; the zooms are those that the style and its TileJSON share."""
    kind = d.get("type")
    if kind == "geojson":
        if not isinstance(d.get("data"), str | dict):
            raise StyleError("a geojson source needs data")
        data = d["data"] if isinstance(d["data"], dict) else metadata.resolve(base, d["data"])
        return {"kind": kind, "data": data, "min_zoom": 0, "max_zoom": 22, "digest": identity.digest("geojson", identity.canonical_json(identity.redact_json(data)))}
    if kind not in ("vector", "raster", "raster-dem"):
        raise StyleError(f"unsupported source type {kind!r}")
    if isinstance(d.get("url"), str):
        url = metadata.resolve(base, d["url"])
        if url not in tilejson:
            raise StyleError(f"no TileJSON for {identity.redact_text(url)}")
        out = metadata.tilejson(tilejson[url], url)
        out["min_zoom"], out["max_zoom"] = max(out["min_zoom"], d.get("minzoom", 0)), min(out["max_zoom"], d.get("maxzoom", 30))
        if out["min_zoom"] > out["max_zoom"]:
            raise StyleError("the zoom ranges don't meet")
    else:
        out = metadata.tilejson(json.dumps({"tilejson": "3.0.0", "tiles": d.get("tiles"), "minzoom": d.get("minzoom", 0), "maxzoom": d.get("maxzoom", 22), "scheme": d.get("scheme", "xyz"), "tileSize": d.get("tileSize", 512), "bounds": d.get("bounds")}), base)
    if kind == "raster-dem":
        out["encoding"] = d.get("encoding", "mapbox")
        if out["encoding"] not in ("mapbox", "terrarium"):
            raise StyleError("unsupported DEM encoding")
    return out | {"kind": kind}


def _terrain(document: dict, base: str, tilejson: dict) -> dict | None:
    t = document.get("terrain")
    if not isinstance(t, dict):
        return None
    source = document.get("sources", {}).get(t.get("source"))
    if not isinstance(source, dict) or source.get("type") != "raster-dem":
        raise StyleError("terrain needs a raster-dem source")
    return compile_source(source, base, tilejson) | {"source_id": t["source"]}


#: Fixed values of the ground light: gamma, luminance of the channels, share of the ambient light that a light from below takes.
GAMMA, LUMINANCE, REDUCTION = 2.2, (0.2126, 0.7152, 0.0722), 0.3


def lit_ground(ambient: list, direct: list, down, power, least) -> list:
    """Channels of flat ground's light from linear ambient and directional channels; ``down`` is the cosine of the
    directional light's angle to the vertical. Numbers or Columns, with their ``power`` and ``least``."""
    brightness = least(sum(w * v for w, v in zip(LUMINANCE, direct, strict=True)), 1.0)
    kept = 1 - REDUCTION * brightness * (1 - least(down + 1, 1.0))  # ambient light gives way to light from below
    return [power(a * kept + d * down, 1 / GAMMA) for a, d in zip(ambient, direct, strict=True)]


def ground_radiance(document: dict) -> tuple[float, float, float] | None:
    """Light on flat ground from one ambient and one directional light; None without both."""
    lights = document.get("lights")
    if lights is None:
        return None
    if not isinstance(lights, list) or not all(isinstance(x, dict) for x in lights):
        raise StyleError("lights must be a list")
    found = {k: [x.get("properties", {}) for x in lights if x.get("type") == k] for k in ("ambient", "directional")}
    if not all(found.values()):
        return None
    if any(len(v) > 1 for v in found.values()):
        raise StyleError("one light of each type is needed")

    def linear(p: dict) -> list[float]:
        rgb, intensity = color.parse(p.get("color", "#ffffff")) if isinstance(p.get("color", "#ffffff"), str) else None, p.get("intensity", 0.5)
        if rgb is None or isinstance(intensity, bool) or not isinstance(intensity, int | float) or not 0 <= intensity <= 1:
            raise StyleError("lights need a literal colour and intensity")
        return [(v / 255) ** GAMMA * intensity for v in rgb[:3]]

    ambient, direct = linear(found["ambient"][0]), linear(found["directional"][0])
    direction = found["directional"][0].get("direction", [210, 30])
    if not isinstance(direction, list) or len(direction) != 2 or not all(isinstance(v, int | float) for v in direction):
        raise StyleError("direction must be two numbers")
    r, g, b = lit_ground(ambient, direct, math.cos(math.radians(direction[1])), pow, min)
    return r, g, b
