import pytest
from pyspark.sql import functions as F

from quadloom.functions import color
from quadloom.functions.expr import NUM, STR, Context, compile_expression, compile_filter, compile_property, props_of, tag
from quadloom.types import Kind, StyleError


@pytest.fixture(scope="module")
def row(spark):
    p = F.map_concat(props_of(**{"class": (F.lit("harbour"), STR), "rank": (F.lit(3.0), NUM)}), F.create_map(F.lit("enabled"), tag(True), F.lit("bridge"), tag(True), F.lit("void"), tag(None)))
    return spark.range(1).select(F.lit(15).alias("z"), F.lit("LineString").alias("geom_type"), F.lit(42).alias("id"), p.alias("props")).cache()


def value(row, node):
    v = node.make(Context())
    got = row.select(v.alias("v")).first()[0]
    if node.kind is Kind.VALUE:
        return None if got is None else (got.b if got.t == 1 else got.n if got.t == 2 else got.s)
    return tuple(got) if node.kind is Kind.COLOR and got is not None else got


#: On zoom 15, a LineString of id 42: class "harbour", rank 3, enabled and bridge true, void null.
CASES = [
    (["any", ["==", ["geometry-type"], "Point"], ["all", [">=", ["zoom"], 14], ["!", ["==", ["get", "class"], "quay"]]]], True),
    (["all", ["has", "bridge"], ["has", "tunnel"]], False),
    (["match", ["get", "rank"], [1, 2], "near", [3, 4], "far", "none"], "far"),
    (["match", ["get", "class"], "quay", 1, -1], -1.0),
    (["step", ["get", "rank"], "a", 3, "b", 3.5, "c"], "b"),
    (["step", ["get", "rank"], -1, 3.25, -2], -1.0),
    (["*", ["to-number", ["get", "void"], "0.25"], ["get", "rank"]], 0.75),
    (["interpolate", ["linear"], ["get", "rank"], 1, 8, 5, 16], 12.0),
    (["interpolate", ["exponential", 3], ["get", "rank"], 2, 0, 4, 8], 2.0),  # 8 * (3 - 1) / (9 - 1)
    (["interpolate", ["linear"], ["get", "void"], 1, 2, 3, 4], None),
    (["==", ["get", "nothing"], ["get", "void"]], True),
    (["==", ["get", "rank"], "3"], False),
    (["in", "bour", ["get", "class"]], True),
    (["in", ["get", "rank"], ["literal", [1, 3]]], True),
    (["any", ["boolean", ["get", "nothing"]], True], None),  # strict: a null operand
    (["!", ["get", "class"]], None),
    (["boolean", ["get", "rank"], ["get", "enabled"]], True),
    (["coalesce", ["get", "void"], ["get", "rank"]], 3.0),
    (["case", ["get", "nothing"], 1, ["get", "bridge"], 2, 3], 2.0),
    (["to-number", "Infinity", "NaN", ["get", "enabled"]], 1.0),
    (["get", "$id"], 42.0),
    (["+", ["get", "class"], 1], None),
    (["image", "marker"], None),
]


@pytest.mark.parametrize("document, expected", CASES)
def test_expression(row, document, expected):
    assert value(row, compile_expression(document)) == expected


@pytest.mark.parametrize("document", [["+", True, 1], ["concat", "a", "b"], ["match", ["get", "a"], 1, "x", 1, "y", "z"], ["step", ["zoom"], 1, 5, 2, 5, 3], ["case", True, 1, "a"], ["!", 3], []])
def test_rejected(document):
    with pytest.raises(StyleError):
        compile_expression(document)


FILTERS = [
    (["==", "class", "harbour"], True), (["!=", "rank", "3"], True), (["!=", "rank", 3], False), (["in", "class", "a", "harbour"], True), (["!in", "class", "a"], True),
    (["has", "nothing"], False), (["!has", "nothing"], True), (["all"], True), (["any"], False), (["<", "rank", 4], True), ([">", "class", 4], False), (["<=", "enabled", True], True),
    (["==", "$type", "LineString"], True), (["==", "$id", 42], True), (["==", "nothing", None], True), (None, True), (["all", ["==", "class", "harbour"], [">=", ["zoom"], 12]], False),
]


@pytest.mark.parametrize("document, expected", FILTERS)
def test_filter(row, document, expected):
    assert row.filter(compile_filter(document)(Context())).count() == int(expected)


def at(row, z, document, kind=None):
    return value(row.withColumn("z", F.lit(z)), compile_property(document, kind))


@pytest.mark.parametrize(("z", "document", "expected"), [
    (4, {"stops": [[2, 30], [6, 10]]}, 20.0), (1, {"stops": [[2, 30], [6, 10]]}, 30.0), (7, {"stops": [[2, 30], [6, 10]]}, 10.0),
    (4, {"base": 3, "stops": [[3, 5], [5, 21]]}, 9.0),  # 5 + 16 * (3 - 1) / (9 - 1)
    (6.5, {"type": "interval", "stops": [[2, "x"], [7, "y"]]}, "x"), (7, {"type": "interval", "stops": [[2, "x"], [7, "y"]]}, "y"),
    (8, {"stops": [[4, 1], [8, 9], [8, 2], [10, 6]]}, 2.0), (9, {"stops": [[4, 1], [8, 9], [8, 2], [10, 6]]}, 4.0), (6, {"stops": [[4, 1], [8, 9], [8, 2], [10, 6]]}, 5.0),
    (3, {"type": "identity", "property": "rank", "default": -1}, 3.0), (3, {"type": "identity", "property": "depth", "default": -1}, -1.0),
    (3, {"type": "identity", "property": "void", "default": 7}, None),  # present but null
])
def test_legacy_functions(row, z, document, expected):
    assert at(row, z, document) == (pytest.approx(expected) if isinstance(expected, float) else expected)


def test_colours(row):
    assert at(row, 5, ["interpolate", ["linear"], ["zoom"], 0, "black", 10, "white"], Kind.COLOR) == (128, 128, 128, 255)
    assert color.parse("#0f8") == (0, 255, 136, 255) and color.parse("#11223344") == (17, 34, 51, 68)
    assert color.parse("rgba(10%, 20, 300, 0.5)") == (26, 20, 255, 128) and color.parse("hsl(120, 100%, 25%)") == (0, 128, 0, 255)
    assert color.parse("hsla(-120deg,100%,50%,50%)") == (0, 0, 255, 127) and color.parse("red") is None and color.parse("#12") is None
