"""Style expressions, legacy functions and filters, compiled to Columns.

Documents are parsed and type-checked on the driver; the result is a Column, so Catalyst folds,
pushes down and generates code for it. A value whose type is known only at run time is a tagged
struct ``<t, b, n, s>`` (t: 0 null, 1 boolean, 2 number, 3 string); equality is type-exact, and null
equals null. Properties are ``map<string, tagged>``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.functions import color
from quadloom.types import Kind, StyleError

TAGGED = "struct<t:tinyint,b:boolean,n:double,s:string>"
NULL, BOOL, NUM, STR = 0, 1, 2, 3


def tag(value: Any = None, c: Column | None = None, t: int | None = None) -> Column:
    """A tagged literal, or a tagged Column of type t (null where the Column is)."""
    if c is None:
        t = NULL if value is None else BOOL if isinstance(value, bool) else STR if isinstance(value, str) else NUM
        c = F.lit(float(value) if t == NUM else value)
    else:
        present = F.when(c.isNotNull(), F.lit(t)).otherwise(F.lit(NULL))
    kind = F.lit(t) if value is not None or t == NULL else present
    slot = lambda k, typ: (c if t == k else F.lit(None)).cast(typ)
    return F.struct(kind.cast("tinyint").alias("t"), slot(BOOL, "boolean").alias("b"), slot(NUM, "double").alias("n"), slot(STR, "string").alias("s"))


@dataclass
class Context:
    """Columns that stand for the feature at hand."""

    zoom: Column = field(default_factory=lambda: F.col("z").cast("double"))
    geom_type: Column = field(default_factory=lambda: F.col("geom_type"))
    id: Column = field(default_factory=lambda: F.col("id").cast("double"))
    props: Column = field(default_factory=lambda: F.col("props"))
    images: Callable[[Column], Column] = field(default=lambda name: F.lit(False))


@dataclass
class Node:
    kind: Kind
    make: Callable[[Context], Column]
    constant: Any = None

    def tagged(self, x: Context) -> Column:
        c = self.make(x)
        if self.kind is Kind.VALUE:
            return F.coalesce(c, tag())
        t = {Kind.BOOLEAN: BOOL, Kind.NUMBER: NUM, Kind.STRING: STR, Kind.IMAGE: STR}.get(self.kind)
        return tag() if t is None else tag(c=c, t=t)

    def read(self, x: Context, kind: Kind) -> Column:
        """The value as ``kind``; null where it is of another type."""
        c = self.make(x)
        if self.kind is Kind.VALUE:
            t, name, typ = {Kind.BOOLEAN: (BOOL, "b", "boolean"), Kind.NUMBER: (NUM, "n", "double"), Kind.STRING: (STR, "s", "string"), Kind.IMAGE: (STR, "s", "string")}[kind]
            return F.when(c["t"] == t, c[name]).cast(typ)
        if self.kind is Kind.NULL:
            return F.lit(None).cast({Kind.BOOLEAN: "boolean", Kind.NUMBER: "double"}.get(kind, "string"))
        return c


def fits(node: Node, *kinds: Kind) -> None:
    if node.kind not in (*kinds, Kind.VALUE, Kind.NULL):
        raise StyleError(f"expected {' or '.join(k.value for k in kinds)}, found {node.kind.value}")


def same(a: Column, b: Column) -> Column:
    """Type-exact equality of tagged values."""
    return (a["t"] == b["t"]) & a["b"].eqNullSafe(b["b"]) & a["n"].eqNullSafe(b["n"]) & a["s"].eqNullSafe(b["s"])


def common(nodes: list[Node]) -> Kind:
    kinds = {n.kind for n in nodes} - {Kind.NULL}
    if not kinds:
        return Kind.NULL
    if len(kinds) == 1:
        return kinds.pop()
    if Kind.VALUE in kinds and kinds <= {Kind.VALUE, Kind.BOOLEAN, Kind.NUMBER, Kind.STRING, Kind.IMAGE}:
        return Kind.VALUE
    raise StyleError(f"branches of different types: {sorted(k.value for k in kinds)}")


def as_kind(node: Node, kind: Kind, x: Context) -> Column:
    if kind is Kind.VALUE:
        return node.tagged(x)
    if node.kind is Kind.NULL and kind in (Kind.ARRAY, Kind.COLOR):
        return F.lit(None).cast("array<double>" if kind is Kind.ARRAY else "struct<r:int,g:int,b:int,a:int>")
    return node.make(x) if node.kind is kind else node.read(x, kind)


def literal(value: Any, expected: Kind | None = None) -> Node:
    if value is None:
        return Node(Kind.NULL, lambda x: F.lit(None).cast("string"))
    if isinstance(value, bool):
        return Node(Kind.BOOLEAN, lambda x: F.lit(value), value)
    if isinstance(value, int | float):
        return Node(Kind.NUMBER, lambda x: F.lit(float(value)), float(value))
    if isinstance(value, str):
        if expected is Kind.COLOR:
            parsed = color.parse(value)
            if parsed is None:
                raise StyleError(f"not a colour: {value!r}")
            return Node(Kind.COLOR, lambda x: color.literal(parsed), parsed)
        return Node(Kind.STRING, lambda x: F.lit(value), value)
    if isinstance(value, list):
        if all(isinstance(v, int | float) and not isinstance(v, bool) for v in value):
            return Node(Kind.ARRAY, lambda x: F.array(*(F.lit(float(v)) for v in value)).cast("array<double>"), tuple(value))
        return Node(Kind.ARRAY, lambda x: F.array(*(tag(v) for v in value)), tuple(value))
    return Node(Kind.OBJECT, lambda x: F.lit(None).cast("string"), value)


def compile_expression(e: Any, expected: Kind | None = None) -> Node:
    """The typed node of an expression document; StyleError where it isn't one."""
    if not isinstance(e, list):
        return literal(e, expected)
    if not e or not isinstance(e[0], str):
        raise StyleError(f"not an expression: {e!r}")
    make = OPERATORS.get(e[0])
    if make is None:
        raise StyleError(f"unsupported operator {e[0]!r}")
    return make(e, expected)


def _need(e: list, ok: bool) -> None:
    if not ok:
        raise StyleError(f"wrong number of operands: {e!r}")


def _literal(e, expected):
    _need(e, len(e) == 2)
    return literal(e[1], expected)


def _get(e, expected):
    _need(e, len(e) == 2 and isinstance(e[1], str))
    if e[1] == "$id":
        return Node(Kind.VALUE, lambda x: tag(c=x.id, t=NUM))
    return Node(Kind.VALUE, lambda x: x.props[e[1]])


def _has(e, expected):
    _need(e, len(e) == 2 and isinstance(e[1], str))
    if e[1] == "$id":
        return Node(Kind.BOOLEAN, lambda x: x.id.isNotNull())
    return Node(Kind.BOOLEAN, lambda x: F.coalesce(F.map_contains_key(x.props, e[1]), F.lit(False)))


def _image(e, expected):
    _need(e, len(e) == 2)
    name = compile_expression(e[1])
    fits(name, Kind.STRING, Kind.IMAGE)
    return Node(Kind.IMAGE, lambda x: F.when(x.images(name.read(x, Kind.STRING)), name.read(x, Kind.STRING)))


def _not(e, expected):
    _need(e, len(e) == 2)
    n = compile_expression(e[1])
    fits(n, Kind.BOOLEAN)
    return Node(Kind.BOOLEAN, lambda x: ~n.read(x, Kind.BOOLEAN))


def _logic(e, expected):
    nodes = [compile_expression(v) for v in e[1:]]
    for n in nodes:
        fits(n, Kind.BOOLEAN)

    def make(x):
        parts = [n.read(x, Kind.BOOLEAN) for n in nodes]
        if not parts:
            return F.lit(e[0] == "all")
        unknown = reduce(lambda a, b: a | b, (p.isNull() for p in parts))
        return F.when(~unknown, reduce((lambda a, b: a & b) if e[0] == "all" else (lambda a, b: a | b), parts))

    return Node(Kind.BOOLEAN, make)


def _arithmetic(e, expected):
    _need(e, len(e) >= 3)
    nodes = [compile_expression(v) for v in e[1:]]
    for n in nodes:
        fits(n, Kind.NUMBER)
    step = (lambda a, b: a + b) if e[0] == "+" else (lambda a, b: a * b)
    return Node(Kind.NUMBER, lambda x: reduce(step, (n.read(x, Kind.NUMBER) for n in nodes)))


def _equal(e, expected):
    _need(e, len(e) == 3)
    a, b = compile_expression(e[1]), compile_expression(e[2])
    if Kind.ARRAY in (a.kind, b.kind):
        return Node(Kind.BOOLEAN, lambda x: a.make(x).eqNullSafe(b.make(x)) if a.kind is b.kind else F.lit(False))
    return Node(Kind.BOOLEAN, lambda x: same(a.tagged(x), b.tagged(x)))


def _order(e, expected):
    _need(e, len(e) == 3)
    a, b = compile_expression(e[1]), compile_expression(e[2])
    for n in (a, b):
        fits(n, Kind.NUMBER, Kind.STRING)
    test = (lambda p, q: p <= q) if e[0] == "<=" else (lambda p, q: p >= q)

    def make(x):
        p, q = a.tagged(x), b.tagged(x)
        return F.when((p["t"] == NUM) & (q["t"] == NUM), test(p["n"], q["n"])).when((p["t"] == STR) & (q["t"] == STR), test(p["s"], q["s"]))

    return Node(Kind.BOOLEAN, make)


def _in(e, expected):
    _need(e, len(e) == 3)
    needle, hay = compile_expression(e[1]), compile_expression(e[2])
    if hay.kind is Kind.ARRAY:
        values = hay.constant or ()
        return Node(Kind.BOOLEAN, lambda x: reduce(lambda a, b: a | b, (same(needle.tagged(x), tag(v)) for v in values), F.lit(False)))
    fits(hay, Kind.STRING)
    return Node(Kind.BOOLEAN, lambda x: F.contains(hay.read(x, Kind.STRING), needle.read(x, Kind.STRING) if needle.kind in (Kind.VALUE, Kind.STRING, Kind.NULL) else F.lit(None).cast("string")))


def _boolean(e, expected):
    _need(e, len(e) >= 2)
    nodes = [compile_expression(v) for v in e[1:]]
    return Node(Kind.BOOLEAN, lambda x: F.coalesce(*(n.tagged(x)["b"] for n in nodes)))


def _to_number(e, expected):
    _need(e, len(e) >= 2)
    nodes = [compile_expression(v) for v in e[1:]]

    def one(t: Column) -> Column:
        parsed = t["s"].try_cast("double")
        finite = ~F.isnan(parsed) & (F.abs(parsed) != math.inf)
        return F.when(t["t"] == NUM, t["n"]).when(t["t"] == BOOL, F.when(t["b"], 1.0).otherwise(0.0)).when((t["t"] == STR) & finite, parsed)

    return Node(Kind.NUMBER, lambda x: F.coalesce(*(one(n.tagged(x)) for n in nodes)))


def _coalesce(e, expected):
    _need(e, len(e) >= 2)
    nodes = [compile_expression(v, expected) for v in e[1:]]
    kind = common(nodes)
    if kind is Kind.VALUE:
        known = lambda c: F.when(c["t"] != NULL, c)
        return Node(kind, lambda x: F.coalesce(*(known(n.tagged(x)) for n in nodes), tag()))
    return Node(kind, lambda x: F.coalesce(*(as_kind(n, kind, x) for n in nodes)))


def _case(e, expected):
    _need(e, len(e) >= 4 and len(e) % 2 == 0)
    tests = [compile_expression(v) for v in e[1:-1:2]]
    outs = [compile_expression(v, expected) for v in [*e[2:-1:2], e[-1]]]
    for t in tests:
        fits(t, Kind.BOOLEAN)
    kind = common(outs)

    def make(x):
        out = as_kind(outs[-1], kind, x)
        for t, o in reversed(list(zip(tests, outs[:-1], strict=True))):
            out = F.when(t.read(x, Kind.BOOLEAN), as_kind(o, kind, x)).otherwise(out)
        return out

    return Node(kind, make)


def _match(e, expected):
    _need(e, len(e) >= 5 and len(e) % 2 == 1)
    value = compile_expression(e[1])
    labels = [v if isinstance(v, list) else [v] for v in e[2:-1:2]]
    flat = [(type(v) is bool, float(v) if isinstance(v, int | float) else v) for group in labels for v in group]
    if any(isinstance(v, list | dict) or v is None for group in labels for v in group) or len(set(flat)) < len(flat):
        raise StyleError("match labels must be distinct scalars")
    outs = [compile_expression(v, expected) for v in [*e[3:-1:2], e[-1]]]
    kind = common(outs)

    def make(x):
        t, out = value.tagged(x), as_kind(outs[-1], kind, x)
        for group, o in reversed(list(zip(labels, outs[:-1], strict=True))):
            out = F.when(reduce(lambda a, b: a | b, (same(t, tag(v)) for v in group)), as_kind(o, kind, x)).otherwise(out)
        return out

    return Node(kind, make)


def stops_of(pairs: list, expected: Kind | None) -> tuple[list[float], list[Node], Kind]:
    stops = pairs[0::2]
    if not stops or any(isinstance(s, bool) or not isinstance(s, int | float) or not math.isfinite(s) for s in stops) or any(a >= b for a, b in zip(stops, stops[1:], strict=False)):
        raise StyleError("stops must be finite and ascending")
    outs = [compile_expression(v, expected) for v in pairs[1::2]]
    return [float(s) for s in stops], outs, common(outs)


def _step(e, expected):
    _need(e, len(e) >= 3 and len(e) % 2 == 1)
    value, first = compile_expression(e[1]), compile_expression(e[2], expected)
    fits(value, Kind.NUMBER)
    stops, outs, kind = stops_of(e[3:], expected) if len(e) > 3 else ([], [], first.kind)
    kind = common([first, *outs])

    def make(x):
        v, out = value.read(x, Kind.NUMBER), as_kind(first, kind, x)
        for s, o in zip(stops, outs, strict=True):
            out = F.when(v >= s, as_kind(o, kind, x)).otherwise(out)
        return F.when(v.isNotNull(), out)

    return Node(kind, make)


def mixed(a: Column, b: Column, t: Column, kind: Kind) -> Column:
    if kind is Kind.NUMBER:
        return a + (b - a) * t
    if kind is Kind.COLOR:
        return color.lerp(a, b, t)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda p, q: p + (q - p) * t))


def progress(v: Column, lower: float, upper: float, base: float) -> Column:
    if base == 1.0:
        return (v - lower) / (upper - lower)
    return (F.pow(F.lit(base), v - lower) - 1) / (base ** (upper - lower) - 1)


def curve(v: Column, stops: list[float], outs: list[Column], kind: Kind, base: float) -> Column:
    """The first output below the first stop, the last one from the last stop on, mixed between."""
    out = outs[-1]
    for i in range(len(stops) - 2, -1, -1):
        out = F.when(v < stops[i + 1], mixed(outs[i], outs[i + 1], progress(v, stops[i], stops[i + 1], base), kind)).otherwise(out)
    return F.when(v <= stops[0], outs[0]).when(v >= stops[-1], outs[-1]).when(v.isNotNull(), out)


def _interpolate(e, expected):
    _need(e, len(e) >= 5 and len(e) % 2 == 1 and isinstance(e[1], list) and bool(e[1]))
    name, base = e[1][0], 1.0
    if name == "exponential":
        _need(e, len(e[1]) == 2)
        base = float(e[1][1])
        if not math.isfinite(base) or base <= 0:
            raise StyleError("the base must be positive")
    elif name != "linear":
        raise StyleError(f"unsupported interpolation {name!r}")
    value = compile_expression(e[2])
    fits(value, Kind.NUMBER)
    stops, outs, kind = stops_of(e[3:], expected)
    if kind not in (Kind.NUMBER, Kind.ARRAY, Kind.COLOR, Kind.VALUE):
        raise StyleError("only numbers, arrays and colours are interpolated")
    kind = Kind.NUMBER if kind is Kind.VALUE else kind
    return Node(kind, lambda x: curve(value.read(x, Kind.NUMBER), stops, [as_kind(o, kind, x) for o in outs], kind, base))


OPERATORS = {
    "literal": _literal, "zoom": lambda e, _: Node(Kind.NUMBER, lambda x: x.zoom), "geometry-type": lambda e, _: Node(Kind.STRING, lambda x: x.geom_type),
    "get": _get, "has": _has, "image": _image, "!": _not, "all": _logic, "any": _logic, "+": _arithmetic, "*": _arithmetic, "==": _equal, "<=": _order, ">=": _order,
    "in": _in, "boolean": _boolean, "to-number": _to_number, "coalesce": _coalesce, "case": _case, "match": _match, "step": _step, "interpolate": _interpolate,
}


# ---- properties


def compile_property(value: Any, expected: Kind | None = None) -> Node:
    """An object is a legacy function, an array headed by a string an expression, the rest a constant."""
    if isinstance(value, dict):
        return legacy_function(value, expected)
    if isinstance(value, list) and value and isinstance(value[0], str):
        return compile_expression(value, expected)
    return literal(value, expected)


def with_default(value: Any, default: Any, expected: Kind | None = None) -> Node:
    """Null falls back to the default (icon properties)."""
    node, other = compile_property(value, expected), literal(default, expected)
    if node.kind is Kind.VALUE:
        return Node(other.kind, lambda x: F.coalesce(node.read(x, other.kind), other.make(x)))
    return Node(node.kind, lambda x: F.coalesce(as_kind(node, node.kind, x), other.make(x))) if node.kind is not Kind.NULL else other


def legacy_function(f: dict, expected: Kind | None = None) -> Node:
    kind = f.get("type")
    if kind == "identity":
        if not isinstance(f.get("property"), str):
            raise StyleError("an identity function needs a property")
        default = literal(f.get("default"), expected)
        return Node(Kind.VALUE, lambda x: F.when(F.map_contains_key(x.props, f["property"]), x.props[f["property"]]).otherwise(default.tagged(x)))
    if kind not in (None, "exponential", "interval") or "property" in f or not isinstance(f.get("stops"), list) or not f["stops"]:
        raise StyleError(f"unsupported function {f!r}")
    stops = [float(s[0]) for s in f["stops"]]
    if any(a > b for a, b in zip(stops, stops[1:], strict=False)) or not all(map(math.isfinite, stops)):
        raise StyleError("stops must be finite and ascending")
    base = float(f.get("base", 1))
    outs = [literal(s[1], expected) for s in f["stops"]]
    out_kind = common(outs)
    smooth = kind != "interval" and out_kind in (Kind.NUMBER, Kind.ARRAY, Kind.COLOR)

    def make(x):
        values = [as_kind(o, out_kind, x) for o in outs]
        out = values[-1]  # from the last stop on
        for i in range(len(stops) - 2, -1, -1):
            # equal stops are a jump: the later one holds from there on
            inner = values[i] if not smooth or stops[i] == stops[i + 1] else mixed(values[i], values[i + 1], progress(x.zoom, stops[i], stops[i + 1], base), out_kind)
            out = F.when(x.zoom < stops[i + 1], inner).otherwise(out)
        return F.when(x.zoom < stops[0], values[0]).otherwise(out)

    return Node(out_kind, make)


# ---- filters

LEGACY = {"has", "!has", "==", "!=", "<", "<=", ">", ">=", "in", "!in"}


def is_legacy(f: Any) -> bool:
    if not isinstance(f, list) or not f:
        return False
    if f[0] in ("all", "any", "none"):
        return f[0] != "none" and all(is_legacy(c) for c in f[1:])
    return f[0] in LEGACY and len(f) > 1 and isinstance(f[1], str)


def _field(key: str, x: Context) -> Column:
    if key == "$type":
        return tag(c=x.geom_type, t=STR)
    if key == "$id":
        return tag(c=x.id, t=NUM)
    return F.coalesce(x.props[key], tag())


def _legacy(f: list) -> Callable[[Context], Column]:
    op = f[0]
    if op in ("all", "any"):
        parts = [_legacy(c) for c in f[1:]]
        return lambda x: reduce((lambda a, b: a & b) if op == "all" else (lambda a, b: a | b), (p(x) for p in parts), F.lit(op == "all"))
    key = f[1]
    if op in ("has", "!has"):

        def present(x: Context) -> Column:
            if key == "$type":
                c = x.geom_type.isNotNull()
            elif key == "$id":
                c = x.id.isNotNull()
            else:
                c = F.coalesce(F.map_contains_key(x.props, key), F.lit(False))
            return c if op == "has" else ~c

        return present
    if op in ("==", "!="):
        _need(f, len(f) == 3)
        return lambda x: same(_field(key, x), tag(f[2])) if op == "==" else ~same(_field(key, x), tag(f[2]))
    if op in ("in", "!in"):
        found = lambda x: reduce(lambda a, b: a | b, (same(_field(key, x), tag(v)) for v in f[2:]), F.lit(False))
        return found if op == "in" else lambda x: ~found(x)
    _need(f, len(f) == 3)
    test = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    value = f[2]
    t, name = (BOOL, "b") if isinstance(value, bool) else (STR, "s") if isinstance(value, str) else (NUM, "n")
    if value is None or isinstance(value, list | dict):
        return lambda x: F.lit(False)
    return lambda x: F.coalesce((_field(key, x)["t"] == t) & test(_field(key, x)[name], F.lit(float(value) if t == NUM else value)), F.lit(False))


def compile_filter(f: Any) -> Callable[[Context], Column]:
    """A predicate Column: rows stay where it is true. No filter is always true."""
    if f is None:
        return lambda x: F.lit(True)
    if is_legacy(f):
        return _legacy(f)
    node = compile_expression(f)
    fits(node, Kind.BOOLEAN)
    return lambda x: F.coalesce(node.read(x, Kind.BOOLEAN), F.lit(False))


# ---- helpers for tables


def props_of(**columns: tuple[Column, int]) -> Column:
    """A property map of Columns with their tags."""
    return F.create_map(*[v for k, (c, t) in columns.items() for v in (F.lit(k), tag(c=c, t=t))])
