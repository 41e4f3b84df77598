"""Sources of the raster change engine."""
