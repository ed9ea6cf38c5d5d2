"""All reference-operator queries with their SQL."""

from __future__ import annotations

from . import bookkeeping_queries, catalogue_queries, composite_queries, path_queries, projection_queries, raster_queries, shape_queries, source_queries, spatial_queries, temporal_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
