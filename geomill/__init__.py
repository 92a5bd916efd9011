"""Tiled-geodata analytics as Spark DataFrame jobs."""
