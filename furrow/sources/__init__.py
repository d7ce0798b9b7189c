"""Readers of point clouds, grids, aisles, footprints and maps."""
