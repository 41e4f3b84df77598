"""Plans of the raster change engine."""
