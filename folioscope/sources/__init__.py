"""Readers of corpora, pages and evaluation sets, and the snapshot and report sinks."""
