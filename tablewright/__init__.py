"""Tabular profiling and model search as Spark jobs."""
