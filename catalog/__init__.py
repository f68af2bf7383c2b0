"""Registered queries over the given tables, each with the SQL another engine checks it by."""

from .base import ORACLE, QUERIES, SURVEY
from . import business, pages, scores, structured, templates  # noqa: F401  (modules register themselves)

__all__ = ["ORACLE", "QUERIES", "SURVEY"]
