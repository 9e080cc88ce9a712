"""Corpus indexing, hybrid retrieval and retrieval evaluation as Spark jobs."""
