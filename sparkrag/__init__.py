"""Corpus preparation, retrieval and evaluation as Spark jobs."""
