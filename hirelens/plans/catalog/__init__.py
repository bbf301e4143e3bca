"""Every operator as a query over the shared tables, beside the SQL that states its result."""

from .registry import ORACLES, QUERIES
from . import classify, demand, incremental, joins, quality, salary, search, sources, text  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
