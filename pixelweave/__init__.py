"""Raster analytics on Spark: images are rows, pixels are a relation."""
