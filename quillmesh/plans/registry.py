"""Imports every query module, so that all queries are registered."""

from quillmesh.plans import answers, corpora, logic, mixing, prompts, scores, tokens  # noqa: F401
from quillmesh.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
