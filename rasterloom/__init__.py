"""Encoded raster images as data, on Spark."""
