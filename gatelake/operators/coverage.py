"""What a scan did not look at: one statistics row per change, and the warnings it implies."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import LONG_LINE_CHARS, WARNING_TEXT
from ..functions import masking
from ..functions.text import all_of, found
from .detect import applies_sql, runnable, with_scope
from .pairs import paired_rules
from .rules import Rule, Ruleset

WARNING = "array<struct<code:string,detail:string,floors:boolean>>"


def _name(fw: Ruleset, rule: Rule) -> str:
    return f"{fw.fw_ord}_{rule.ord}"


def _gated_lines(rulesets):
    return [(fw, r) for fw in rulesets for r in fw.rules if runnable(r) and r.gated]


def _gated_pairs(rulesets):
    return [(fw, r) for fw, r in paired_rules(rulesets) if r.gated]


def _pair_gate_counts(fw: Ruleset, rule: Rule) -> list[Column]:
    """Per bucket: matched halves, halves the gate admits, and admitted halves that do not meet the precondition."""
    excluded = found("text", rule.exclude) if rule.exclude else "false"
    met = found("text", rule.require) if rule.require else "true"
    out = []
    for half, side, pattern in (("m", "removed", rule.minus), ("p", "added", rule.plus)):
        hit = all_of([f"side = '{side}'", rule.scope_sql(), found("text", pattern)])
        for what, cond in (("all", hit), ("ok", f"{hit} and not {excluded}"), ("unmet", f"{hit} and not {excluded} and not {met}")):
            out.append(F.expr(f"count_if({cond})").alias(f"{half}_{what}_{_name(fw, rule)}"))
    return out


def text_stats(lines: DataFrame, rulesets: list[Ruleset], key="change_id") -> DataFrame:
    """``line_stats`` of plain text lines, which have no hunks and no removed side: file, then key."""
    files = with_scope(lines).groupBy(key, "file").agg(
        F.min(F.when(F.length("text") > LONG_LINE_CHARS, F.col("pos"))).alias("long_plus"),
        *[_suppressed_lines(fw, r) for fw, r in _gated_lines(rulesets)])
    files = files.withColumns({c: F.lit(None).cast("int") for c in ("long_minus", "hunk_long", "file_long")})
    named = _long_files(rulesets)
    return files.groupBy(key).agg(*[F.sum(c).alias(c) for c in files.columns if c.startswith("sup_")], *named)


def _suppressed_lines(fw: Ruleset, rule: Rule) -> Column:
    return F.expr(f"count_if(side in ('added', 'removed') and {applies_sql(rule)} and not {rule.gate_sql('text')})").alias(
        f"sup_{_name(fw, rule)}")


def line_stats(lines: DataFrame, rulesets: list[Ruleset], key="change_id") -> DataFrame:
    """One row per change: pair counts, suppressed lines per rule and files with long lines.

    ``lines`` may hold context lines and lines outside hunks (side null), so every change
    that has a diff gets a row.  Three aggregations, hunk then file then change, all on the
    partitioning by change that the diff already has.
    """
    long = F.length("text") > LONG_LINE_CHARS
    added, removed = F.col("side") == "added", F.col("side") == "removed"
    rows = with_scope(lines)

    def over(cond):
        return F.min(F.when(cond & long, F.col("pos")))

    counters = [_suppressed_lines(fw, r) for fw, r in _gated_lines(rulesets)]
    for fw, r in _gated_pairs(rulesets):
        counters += _pair_gate_counts(fw, r)
    hunks = rows.groupBy(key, "file", "hunk_index").agg(
        F.count_if(added).alias("n_plus"), F.count_if(removed).alias("n_minus"),
        F.min(F.when(removed, F.col("pos"))).alias("first_minus"),
        over(added).alias("long_plus"), over(removed).alias("long_minus"), *counters)

    per_hunk = [(F.col("n_minus") * F.col("n_plus")).alias("hunk_pairs"),
                _first_long_pair().alias("hunk_long")]
    sums = [c for c in hunks.columns if re.match(r"(sup|m|p)_", c)]
    for fw, r in _gated_pairs(rulesets):
        if r.same_hunk_only:
            per_hunk.append(_suppressed_pairs(fw, r).alias(f"pairsup_{_name(fw, r)}"))
    hunks = hunks.select("*", *per_hunk)
    files = hunks.groupBy(key, "file").agg(
        *[F.sum(c).alias(c) for c in ["n_plus", "n_minus", "hunk_pairs", *sums]],
        *[F.min(c).alias(c) for c in ("first_minus", "long_plus", "long_minus", "hunk_long")],
        *[F.sum(c).alias(c) for c in hunks.columns if c.startswith("pairsup_")])
    files = files.withColumn("file_long", _first_long_pair())
    wide = [(fw, r) for fw, r in _gated_pairs(rulesets) if not r.same_hunk_only]
    files = files.select("*", *[_suppressed_pairs(fw, r).alias(f"pairsup_{_name(fw, r)}") for fw, r in wide])
    named = _long_files(rulesets)
    totals = [F.sum(c).alias(c) for c in files.columns if re.match(r"(sup|pairsup)_", c)]
    return files.groupBy(key).agg(
        F.sum("hunk_pairs").alias("same_hunk_pairs"), F.sum(F.col("n_minus") * F.col("n_plus")).alias("same_file_pairs"),
        *totals, *named)


def _suppressed_pairs(fw: Ruleset, rule: Rule) -> Column:
    """Matched pairs the gate drops, counted without pairing."""
    c = {f"{h}_{w}": F.col(f"{h}_{w}_{_name(fw, rule)}") for h in "mp" for w in ("all", "ok", "unmet")}
    return c["m_all"] * c["p_all"] - (c["m_ok"] * c["p_ok"] - c["m_unmet"] * c["p_unmet"])


def _first_long_pair() -> Column:
    """Position of the first removed line whose pairing touches a long line, or null."""
    paired = (F.col("n_minus") > 0) & (F.col("n_plus") > 0)
    return F.when(paired, F.when(F.col("long_plus").isNotNull(), F.col("first_minus")).otherwise(F.col("long_minus")))


def _long_files(rulesets: list[Ruleset]) -> list[Column]:
    """Per framework how many files hold long lines that its rules met, and the first of them."""
    return [x for fw in rulesets for x in (F.count(_long_file(fw)).alias(f"longs_{fw.fw_ord}"), F.min(_long_file(fw)).alias(f"long_{fw.fw_ord}"))]


def _long_file(fw: Ruleset) -> Column:
    """(order of discovery, file) if any rule of the framework meets a long line of the file."""
    marks = []
    for r in fw.rules:
        if runnable(r):
            plus = F.col("long_plus") if "added" in r.sides else F.lit(None).cast("int")
            minus = F.col("long_minus") + F.lit(1 << 40) if "removed" in r.sides else F.lit(None).cast("bigint")
            pos = F.coalesce(plus.cast("bigint"), minus)
        elif r.kind == "paired" and r.minus and r.plus:
            pos = F.col("hunk_long" if r.same_hunk_only else "file_long").cast("bigint")
        else:
            continue
        marks.append(F.when(F.expr(r.scope_sql("file", None)), pos + F.lit(r.ord << 41)))
    if not marks:
        return F.lit(None).cast("struct<first:bigint,file:string>")
    first = F.least(*marks, marks[0])
    return F.when(first.isNotNull(), F.struct(first.alias("first"), F.col("file").alias("file")))


def _text(code: str, **parts) -> Column:
    """Fill a warning template; plain strings are folded, columns are concatenated."""
    pieces = []
    for literal, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", WARNING_TEXT[code]):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            part = parts[name]
            pieces.append(part.cast("string") if isinstance(part, Column) else F.lit(str(part)))
    return F.concat(*pieces)


def _warning(code: str, floors: bool, when: Column | None = None, **parts) -> Column:
    row = F.struct(F.lit(code).alias("code"), _text(code, **parts).alias("detail"), F.lit(floors).alias("floors"))
    return row if when is None else F.when(when, row)


def _names(rules) -> str:
    return ", ".join(dict.fromkeys(masking.literal_rule_id(r.id) for r in rules))


def _glob_list(names) -> str:
    return ", ".join(masking.literal_path(g) for g in names)


def warnings_of(fw: Ruleset, has_description: bool, has_pairs: bool) -> Column:
    """The warnings of one framework over a ``line_stats`` row, in the order they are raised.

    Refused globs and gates are a property of the rules table, so they are reported for
    every change of the framework, never only where some line happened to meet them.
    """
    safe = {r.ord: masking.literal_rule_id(r.id) for r in fw.rules}
    out = [_warning("context_rejected", False, framework=fw.framework)] if fw.context_rejected else []
    for r in fw.rules:
        if r.failed:
            out.append(_warning("rule_failed", True, rule=safe[r.ord]))
        if r.unusable:
            out.append(_warning("unusable_pattern", True, rule=safe[r.ord], fields=", ".join(r.unusable)))
        if r.lowering_unreadable:
            out.append(_warning("unreadable_applies_when", False, F.array_contains("hit_rules", r.ord), rule=safe[r.ord]))
    refused = [r for r in fw.rules if r.gate_refused]
    if refused:
        out.append(_warning("tier1_gate", True, rules=_names(refused)))
    for code, why in (("blanket_glob", "blanket"), ("complex_glob", "complex")):
        names = fw.refused_globs(why)
        if names:
            out.append(_warning(code, True, n=len(names), globs=_glob_list(names)))
    pair_rules = [r for r in fw.of_kind("paired") if r.minus and r.plus] if has_pairs else []
    files = F.coalesce(F.col(f"longs_{fw.fw_ord}"), F.lit(0))
    out.append(_warning("long_lines", False, files > 0, n=files, file=masking.safe_path(F.col(f"long_{fw.fw_ord}.file"))))
    out.append(_warning("truncated_diff", True, F.col("truncated")))
    by_rule = [(r, F.col(f"sup_{_name(fw, r)}")) for r in fw.rules if runnable(r) and r.gated]
    by_rule += [(r, F.col(f"pairsup_{_name(fw, r)}")) for r in pair_rules if r.gated]
    by_rule += [(r, F.col(f"dsup_{_name(fw, r)}")) for r in fw.of_kind("description")
                if has_description and r.pattern and r.gated]
    for r, n in sorted(by_rule, key=lambda p: p[0].ord):
        out.append(_warning("suppressed", False, n > 0, rule=safe[r.ord], n=n))
    return F.array_compact(F.array(*out)).cast(WARNING)


def description_columns(rulesets: list[Ruleset]) -> list[Column]:
    """Per gated description rule, whether its gate dropped the description."""
    return [F.expr(f"bigint(coalesce(description <> '' and not {r.gate_sql('description')}, false))").alias(f"dsup_{_name(fw, r)}")
            for fw in rulesets for r in fw.of_kind("description") if r.pattern and r.gated]
