"""Registered queries."""
from . import basic, documents, outputs, scans  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
