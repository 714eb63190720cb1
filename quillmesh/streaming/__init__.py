"""Incremental runs of the stateless jobs."""
