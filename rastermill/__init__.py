"""Rasters as data: a Spark engine for partitioning, coding and rendering images."""
