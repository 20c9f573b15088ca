"""Geometric morphometry on Spark: specimen tables, clouds, meshes and the analyses over them."""
