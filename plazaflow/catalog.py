"""All queries of the library, and the same as SQL."""

from __future__ import annotations

from .plans import graph, grids, objects, relational, spatial, stochastic, temporal, text  # noqa: F401
from .plans.registry import COVERS, ORACLE_SQL, QUERIES

FLAGSHIP = "occupancy_curve"

__all__ = ["COVERS", "FLAGSHIP", "ORACLE_SQL", "QUERIES"]
