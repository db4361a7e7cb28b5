"""Operators of a training-data pipeline and their registered queries."""
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
