"""Spatial-mesh analytics on PySpark: meshes, cells and fields as DataFrames."""
