"""Raster analytics on PySpark: images as DataFrames."""
