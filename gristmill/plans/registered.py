"""All queries of the library, by name."""

from . import analysis, learning, modelling, relational, sources  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
