import pytest

from quadloom.operators import render


@pytest.mark.parametrize("op", ["raster", "icon", "hillshade"])
def test_ops_that_are_not_drawn_are_errors(spark, op):
    schema = "z int, x long, y long, layer_order int, draw_order int, op string, rgba array<int>, opacity double, width double, parts array<array<struct<x: double, y: double>>>"
    rows = [(1, 0, 0, 0, 0, "background", [9, 9, 9, 255], 1.0, None, None), (1, 0, 0, 1, 0, op, None, 1.0, None, None)]
    with pytest.raises(Exception, match=f"draws no '{op}'"):
        render.render(spark.createDataFrame(rows, schema), 16).collect()
    assert render.render(spark.createDataFrame(rows[:1], schema), 16).count() == 1
