"""Known-safe values: built-in synthetic forms and a ruleset's listed values."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import SYNTHETIC_VALUES
from .patterns import SPACE, js_trim, trimmed_sql
from .text import any_of, found, once, quoted, replaced


_SYNTHETIC = "|".join(f"(?:{p})" for p in SYNTHETIC_VALUES)
_SEPARATORS = f"[{SPACE}-]"


def normalized(value: Column) -> Column:
    return F.lower(js_trim(value))


def ungrouped(value: Column) -> Column:
    return F.regexp_replace(normalized(value), _SEPARATORS, "")


def is_synthetic(value: Column) -> Column:
    return normalized(value).rlike(_SYNTHETIC)


def domain_of(value: Column) -> Column:
    """Text after the last ``@``, or the whole value."""
    return F.element_at(F.split(normalized(value), "@"), -1)


def _strip(entry: str) -> str:
    return "".join(ch for ch in entry.replace(chr(0xFEFF), "") if ch != "-" and not ch.isspace()).lower()


def is_allowlisted_sql(value: str, allowlist: dict | None) -> str:
    """Synthetic, or in the rule author's lists (small literals of the compiled ruleset)."""
    lists = allowlist or {}
    trimmed = trimmed_sql(value)
    exact = {e.lower() for k in ("emails", "names") for e in lists.get(k) or ()}
    grouped = {_strip(e) for k in ("ibans", "cards") for e in lists.get(k) or ()}
    domains = {e.lower() for e in lists.get("domains") or ()}
    tests = [found("norm", _SYNTHETIC)]
    for key, entries in (("norm", exact), (replaced("norm", _SEPARATORS), grouped),
                         ("element_at(split(norm, '@'), -1)", domains)):
        if entries:
            tests.append(f"{key} in ({', '.join(quoted(e) for e in sorted(entries))})")
    return f"exists(array(lower({trimmed})), norm -> {any_of(tests)})"


def is_allowlisted(value: Column, allowlist: dict | None) -> Column:
    return once(value, "v", is_allowlisted_sql("v", allowlist))


def allow_entries(rulesets):
    """Explode a rulesets table's allowlists to ``(framework, kind, entry)`` rows keyed as they are compared."""
    kinds = ("emails", "names", "domains", "ibans", "cards")

    def of_kind(kind: str):
        entries = F.coalesce(F.col(f"allowlist.{kind}"), F.array().cast("array<string>"))
        return F.transform(entries, lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("entry")))

    rows = F.flatten(F.array(*map(of_kind, kinds)))
    flat = rulesets.select("framework", F.inline(rows))
    grouped = F.col("kind").isin("ibans", "cards")
    # Entries are compared as written apart from case; only grouped kinds lose their separators.
    key = F.when(grouped, F.regexp_replace(F.lower("entry"), f"[{SPACE}-]", "")).otherwise(F.lower("entry"))
    return flat.select("framework", "kind", key.alias("entry")).distinct()


def without_listed(hits, entries, value="value"):
    """Anti-join hits against an allowlist table of any size.

    Each hit is compared in its exact, ungrouped and domain form; the entries side is
    broadcast by the optimizer only when it is small.
    """
    from functools import reduce
    value = F.col(value)
    forms = (("exact", normalized(value), ("emails", "names")),
             ("ungrouped", ungrouped(value), ("ibans", "cards")),
             ("domain", domain_of(value), ("domains",)))

    def drop(df, form):
        name, key, kinds = form
        side = entries.where(F.col("kind").isin(*kinds)).select(F.col("entry").alias(f"_{name}")).distinct()
        return df.withColumn(f"_k_{name}", key).join(side, F.col(f"_k_{name}") == F.col(f"_{name}"), "left_anti") \
            .drop(f"_k_{name}")

    return reduce(drop, forms, hits.where(~is_synthetic(value)))
