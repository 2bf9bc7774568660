"""Every named query, registered on import."""

from . import crawl, files, leads, metrics, retrieval, scoring
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
