"""Operators of the raster change engine."""
