"""Streaming of the raster change engine."""
