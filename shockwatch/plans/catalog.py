"""All registered queries."""

from . import after, compare, core, graphs, io, live, quality, study  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
