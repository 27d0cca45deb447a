"""Queries of the engine over the star-schema tables."""

from plumbline.plans import areas, choice, detection, dimensions, edits, lifecycle, rasters, reports, scales, sessions, spatial, walls, working  # noqa: F401
from plumbline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
