"""Operators for building training corpora. Nothing else in the library imports it; the entry point and the pipeline do."""
