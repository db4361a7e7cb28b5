"""All rules over all lines in one pass: one literal expression per rule, no join, no shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import DESCRIPTION_LOCATION, SEVERITY
from ..functions import checksums, globs, masking
from ..functions.allowlist import is_allowlisted_sql
from ..functions.patterns import gram_pattern
from ..functions.text import all_of, any_of, applied, found, quoted
from .candidates import first_passing_sql, matches_sql, matches_with_cut_sql
from .rules import Rule, Ruleset, scopes

HIT = "struct<fw_ord:int,rule_ord:int,match_ord:bigint,severity:int,mask:string,value:string,is_token:boolean>"
_NONE = f"array<{HIT}>"
# Rulesets with more rules that require a text are indexed, by at most this much of the text.
BLOCK_RULES, HEAD = 16, 32


def lower_sql(severity: str) -> str:
    """One step down: block, review, advise, advise."""
    return f"least({severity} + 1, {SEVERITY['advise']})"


def graded_sql(rule: Rule, text: str) -> str:
    """Severity of a line hit given whether the rule's context occurs on its line."""
    if not rule.context:
        return str(rule.severity)
    missing = min(rule.severity + 1, SEVERITY["advise"]) if (rule.checksum or rule.validators) else rule.severity
    missing = max(missing, SEVERITY["review"])
    return f"if({found(text, rule.context)}, {rule.severity}, {missing})"


def _lowered_sql(rule: Rule, context: str) -> str:
    """Context grading: the first entry whose booleans all hold, and only downwards."""
    arms = " ".join(
        "when " + all_of(f"coalesce(try_element_at({context}, {quoted(k)}) = {str(v).lower()}, false)" for k, v in conditions)
        + f" then {SEVERITY[action]}" for conditions, action in rule.lowering)
    return f"int(greatest(severity, case {arms} else 0 end))"


def _settled_sql(rule: Rule, context: dict) -> str:
    """The same where the context is the ruleset's own and so known beforehand."""
    held = [SEVERITY[action] for conditions, action in rule.lowering if all(context.get(k) is v for k, v in conditions)]
    return f"int(greatest(severity, {held[0] if held else 0}))"


def graded_by_context(hits: DataFrame, contexts: DataFrame | None, rulesets: list[Ruleset], key="change_id") -> DataFrame:
    """Lower hits by the context of their framework.

    A ruleset that came with a context grades by that. For the others ``contexts`` may have a context per change, a
    MAP<STRING, BOOLEAN> for all frameworks or a MAP<STRING, MAP<STRING, BOOLEAN>> by framework; it is joined to the few
    hits and not carried on the lines, so that every branch of a scan reads the same shuffled diffs.
    """
    rules = [(fw, r) for fw in rulesets for r in fw.rules if r.lowering]
    looked_up = contexts is not None and any(fw.context is None for fw, _ in rules)
    nested = looked_up and contexts.schema["context"].dataType.simpleString().startswith("map<string,map")
    arms = []
    for fw, r in rules:
        if fw.context is None and not looked_up:
            continue
        column = f"try_element_at(context, {quoted(fw.framework)})" if nested else "context"
        lowered = _lowered_sql(r, column) if fw.context is None else _settled_sql(r, fw.context)
        arms.append(f"when fw_ord = {fw.fw_ord} and rule_ord = {r.ord} then {lowered}")
    if not arms:
        return hits
    columns = [f"case {' '.join(arms)} else severity end as severity" if c == "severity" else c for c in hits.columns]
    graded = hits.join(contexts.select(key, "context"), key, "left") if looked_up else hits
    return graded.selectExpr(*columns)


def with_scope(lines: DataFrame) -> DataFrame:
    """Add what every rule asks of a line: its number of digits and the built-in path exclusion."""
    if "excluded" not in lines.columns:
        lines = lines.withColumn("excluded", globs.is_built_in_exclusion(F.col("file")))
    return lines.withColumn("digit_count", F.expr(digit_count_sql("text")))


def digit_count_sql(text: str) -> str:
    """ASCII digits in a text; most texts have none, which is quicker to see than to count."""
    return f"if({found(text, '[0-9]')}, length({checksums.digits_sql(text)}), 0)"


def side_sql(rule: Rule) -> list[str]:
    return [] if len(rule.sides) == 2 else [f"side = '{rule.sides[0]}'"]


def applies_sql(rule: Rule) -> str:
    """Side and path of a line."""
    return all_of([*side_sql(rule), rule.scope_sql()])


def found_values_sql(rule: Rule, text: str, allowlist) -> str:
    """ARRAY<STRUCT<value, ord, ..>> of the matches that survive allowlist and checksum."""
    if not rule.validators:
        values = (f"transform({matches_sql(text, rule.pattern)}, (v, i) -> named_struct('value', v, 'ord', bigint(i)))")
        return f"filter({values}, m -> not {is_allowlisted_sql('m.value', allowlist)})" if rule.synthetic else values
    tests = [checksums.could_be_valid_sql(rule.validators, "m.value", f"length({checksums.digits_sql('m.value')})")]
    if rule.synthetic:
        tests.append(f"not {is_allowlisted_sql('m.value', allowlist)}")
    values = f"filter({matches_with_cut_sql(text, rule.pattern)}, m -> {all_of(tests)})"
    passed = (f"transform({values}, m -> named_struct('value', m.value, 'ord', m.ord, 'matched', "
              f"{first_passing_sql(rule.validators, 'm.value', 'm.cut')}))")
    tests = ["m.matched is not null"] + ([f"not {is_allowlisted_sql('m.matched', allowlist)}"] if rule.synthetic else [])
    return f"filter({passed}, m -> {all_of(tests)})"


def worth_matching_sql(rule: Rule, text: str, digit_count: str = "digit_count", folded: str | None = None) -> str:
    """Cheap tests that hold on every text with a hit, so most lines never see the pattern or the gate."""
    tests = [f"{digit_count} >= {rule.min_digits}"] if rule.min_digits else []
    if rule.hint:
        tests.append(f"contains({text}, {quoted(rule.hint)})")
    elif rule.texts and folded:
        tests.append(any_of(f"contains({folded}, {quoted(t)})" for t in rule.texts))
    if rule.validators:
        tests.append(checksums.could_be_valid_sql(rule.validators, text, digit_count))
    return all_of(tests)


def _gate_sql(rule: Rule, text: str) -> list[str]:
    """The gate, asked only of a text that matches."""
    return [found(text, rule.pattern), rule.gate_sql(text)] if rule.gated and rule.kind != "signature" else [rule.gate_sql(text)]


def first_token_sql(text: str, tokens) -> str:
    """The first listed token the text contains."""
    arms = " ".join(f"when contains({text}, {quoted(t)}) then {quoted(t)}" for t in tokens)
    return f"case {arms} end" if tokens else "cast(null as string)"


def first_token(text: Column, tokens) -> Column:
    return applied(text, "t", first_token_sql("t", tokens))


def runnable(rule: Rule) -> bool:
    return (rule.kind == "line" and rule.pattern is not None) or (rule.kind == "signature" and bool(rule.tokens))


def _hits_sql(fw: Ruleset, rule: Rule, conditions, values: str, severity: str) -> str:
    """The hits of one rule on one row, or an empty array."""
    hit = (f"named_struct('fw_ord', {fw.fw_ord}, 'rule_ord', {rule.ord}, 'match_ord', m.ord, 'severity', {severity}, "
           f"'mask', {quoted(rule.mask)}, 'value', m.value, 'is_token', {str(rule.kind == 'signature').lower()})")
    return f"if({all_of(conditions)}, transform({values}, m -> {hit}), cast(array() as {_NONE}))"


def _line_sql(fw: Ruleset, rule: Rule, scope: str, indexed: bool) -> str:
    """Texts are looked for first, as most lines lack them; then the path, then the gate.

    Lines come to an ``indexed`` rule by its texts, which are then asked for only where longer than the index.
    """
    text = "text"
    if rule.kind == "signature":
        token = first_token_sql(text, rule.tokens)
        values = f"filter(array(named_struct('value', {token}, 'ord', bigint(0))), m -> m.value is not null)"
        return _hits_sql(fw, rule, [*side_sql(rule), scope, *_gate_sql(rule, text)], values, str(rule.severity))
    known = indexed and all(len(t) <= HEAD for t in rule.texts)
    tests = [*side_sql(rule), worth_matching_sql(rule, text, folded=None if known else "folded"), scope, *_gate_sql(rule, text)]
    return _hits_sql(fw, rule, tests, found_values_sql(rule, text, fw.allowlist), graded_sql(rule, text))


def _scopes_sql(work, lines: DataFrame, rulesets: list[Ruleset]) -> list[str]:
    """The path condition of each rule: looked up where the table brings settled scopes, else tested on the path."""
    place = {scope: i for i, scope in enumerate(scopes(rulesets))} if "scopes" in lines.columns else {}
    return [f"(not excluded and get(scopes, {place[r.scope]}))" if r.scope in place else r.scope_sql() for _, r in work]


def _blocks(work) -> tuple[list, list]:
    """Rules asked of every line, and for each required text the rules that ask for it, sorted by text.

    Where one text begins with another its rules hold those of the shorter one. A ruleset of few such rules needs no index.
    """
    indexed = [i for i, (_, r) in enumerate(work) if r.texts]
    if len(indexed) <= BLOCK_RULES:
        return list(range(len(work))), []
    users: dict = {}
    for i in indexed:
        for text in work[i][1].texts:
            users.setdefault(text[:HEAD], set()).add(i)
    blocks = [(text, sorted(set().union(*(users.get(text[:n], ()) for n in range(1, len(text) + 1))))) for text in sorted(users)]
    return sorted(set(range(len(work))) - set(indexed)), blocks


def _chosen_sql(name: str, cases: list[tuple[str, str]]) -> str:
    """The result of the last case whose bound ``name`` reaches, found by halving; ``cases`` are (bound, result) in order."""
    if len(cases) == 1:
        return cases[0][1]
    half = len(cases) // 2
    return f"if({name} < {cases[half][0]}, {_chosen_sql(name, cases[:half])}, {_chosen_sql(name, cases[half:])})"


def _indexed_sql(blocks, every: list[str]) -> str:
    """Hits of the rules of which a line holds a required text: one pass names the texts, the texts name the rules."""
    named = f"array_distinct(regexp_extract_all(folded, {quoted(gram_pattern(text for text, _ in blocks))}, 1))"
    asked = _chosen_sql("text_", [(quoted(text), f"array({', '.join(map(str, members))})") for text, members in blocks])
    members = sorted({i for _, users in blocks for i in users})
    hits = _chosen_sql("rule_", [(str(i), every[i]) for i in members])
    return (f"coalesce(flatten(transform(array_distinct(flatten(transform({named}, text_ -> {asked}))), rule_ -> {hits})), "
            f"cast(array() as {_NONE}))")


def line_hits(lines: DataFrame, rulesets: list[Ruleset], key="change_id") -> DataFrame:
    """Every hit of every line and signature rule, masked at the spot.

    ``lines`` carries side, side_ord, pos, file, line_no and text. Large rulesets are indexed: each line is read once for
    all required texts, and only the rules of the texts it holds are looked at.
    """
    work = [(fw, r) for fw in rulesets for r in fw.rules if runnable(r)]
    lines = with_scope(lines).withColumn("folded", F.lower("text"))
    # A text holds at most 2**31 bytes, so neither its lines nor the matches of a line pass 2**30.
    order = F.shiftleft(F.col("side_ord").cast("bigint"), 60) + F.shiftleft(F.col("pos").cast("bigint"), 30)
    shown_line = F.when(F.col("side") != "removed", F.col("line_no"))

    if not work:
        return _no_hits(lines, key)
    always, blocks = _blocks(work)
    every = [_line_sql(fw, r, scope, bool(blocks)) for (fw, r), scope in zip(work, _scopes_sql(work, lines, rulesets))]
    arrays = [every[i] for i in always] + ([_indexed_sql(blocks, every)] if blocks else [])
    hits = lines.select(key, "file", "line_no", shown_line.alias("line"), order.alias("base"),
                        F.inline_outer(F.expr(f"flatten(array({', '.join(arrays)}))")))
    # The outer form keeps Spark from testing the whole array once more in a filter.
    hits = hits.where(F.col("rule_ord").isNotNull())
    return masking.with_evidence(hits).select(key, "fw_ord", "rule_ord", (F.col("base") + F.col("match_ord")).alias("ord"),
                                              "severity", "evidence", "file", "line")


def _no_hits(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.lit(False)).select(
        key, F.lit(0).alias("fw_ord"), F.lit(0).alias("rule_ord"), F.lit(0).cast("bigint").alias("ord"),
        F.lit(0).alias("severity"), F.lit("").alias("evidence"), F.lit("").alias("file"),
        F.lit(0).cast("bigint").alias("line"))


def description_hits(changes: DataFrame, rulesets: list[Ruleset], key="change_id") -> DataFrame:
    """Rules on the description, taken as one unit: gated once, no file and no line."""
    work = [(fw, r) for fw in rulesets for r in fw.of_kind("description") if r.pattern]
    if not work:
        return _no_hits(changes, key)
    body = changes.select(key, F.col("description").alias("body"))
    arrays = ", ".join(
        _hits_sql(fw, r, ["body <> ''", worth_matching_sql(r, "body", digit_count_sql("body")), *_gate_sql(r, "body")],
                  found_values_sql(r, "body", fw.allowlist), str(r.severity)) for fw, r in work)
    out = body.select(key, F.lit(None).cast("bigint").alias("line_no"), F.inline_outer(F.expr(f"flatten(array({arrays}))")))
    out = out.where(F.col("rule_ord").isNotNull())
    return masking.with_evidence(out, DESCRIPTION_LOCATION).select(
        key, "fw_ord", "rule_ord", F.col("match_ord").alias("ord"), "severity", "evidence",
        F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("line"))
