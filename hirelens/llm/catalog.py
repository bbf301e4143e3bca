"""All queries of this subpackage, with SQL where it can express them."""

from . import bitslice, conversations, decontamination, interactions, jaccard, language, linededup, mixing, neighbours, quality, substrings, toxicity, urls  # noqa: F401
from .work import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
