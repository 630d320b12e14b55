"""Tiled geospatial analytics on DataFrames: style programs compiled into Column plans."""
