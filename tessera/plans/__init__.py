"""Queries of the library over the tables at hand."""

from . import analytics, citations, documents, evidence, graph, library, streams, texts, workflow
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytics", "citations", "documents", "evidence", "graph", "library", "streams", "texts", "workflow"]
