"""Functions of the raster change engine."""
