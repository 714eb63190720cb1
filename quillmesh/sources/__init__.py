"""Readers and writers for corpora, evaluation examples and run metrics."""
