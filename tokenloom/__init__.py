"""Corpus building, token packing and training-run analytics as Spark jobs."""
