"""The engine's queries: named plans over the search domain, with the SQL that they are held against."""

from . import geometry, regions, results, search, sets, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
