"""Structured Streaming forms of the keep-fresh jobs."""
