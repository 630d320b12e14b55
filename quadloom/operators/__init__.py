"""Operators over rows of tiles and features."""
