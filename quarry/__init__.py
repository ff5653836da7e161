"""Batch and streaming search analytics over a procurement catalogue, as Spark jobs."""
