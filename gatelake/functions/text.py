"""SQL text helpers.

Rule expressions nest many higher-order functions.  They are written as SQL text because
one ``expr`` call replaces hundreds of Column calls, which would otherwise take longer to
build than a small scan takes to run.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(value: str, pattern: str) -> str:
    return f"({value} rlike {quoted(pattern)})"


def replaced(value: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({value}, {quoted(pattern)}, {quoted(by)})"


def any_of(conditions) -> str:
    parts = list(conditions)
    return "(" + " or ".join(parts) + ")" if parts else "false"


def all_of(conditions) -> str:
    parts = list(conditions)
    return "(" + " and ".join(parts) + ")" if parts else "true"


def once(value: Column, name: str, test: str) -> Column:
    """Evaluate ``value`` once as ``name`` and test it with a SQL condition."""
    return F.call_function("exists", F.array(value), F.expr(f"{name} -> {test}"))


def applied(value: Column, name: str, result: str) -> Column:
    """A SQL expression over ``value`` bound to ``name``."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {result}")), F.lit(0))
