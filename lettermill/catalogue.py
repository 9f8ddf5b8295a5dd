"""Every registered query of the engine with the SQL that states its result."""

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
