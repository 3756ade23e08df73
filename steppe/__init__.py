"""Gridded monthly climate panels on Spark: panels, drought indices, forecasts, skill."""
