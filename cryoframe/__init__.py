"""Raster, catalogue and corpus analytics as Spark DataFrame operators."""
