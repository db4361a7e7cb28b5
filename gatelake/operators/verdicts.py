"""Verdicts per (change, framework), gate decisions and what was not recorded."""
from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import CONTEXT_CAP, DEFAULT_FRAMEWORK, SUPPORTED_CAPS, WARNING_TEXT
from ..sources.rulesets import document_errors, load_rulesets, unavailable
from .rules import Ruleset


def verdict_of(n_block: Column, n_review: Column, floored: Column) -> Column:
    return (F.when(n_block > 0, "fail").when((n_review > 0) | floored, "needs_review").otherwise("pass"))


def action_verdict(action: Column) -> Column:
    return F.when(action == "block", "fail").when(action == "review", "needs_review").otherwise("pass")


def conclusion(verdict: Column, advisory: Column) -> Column:
    return (F.when(verdict == "pass", "success")
            .when((verdict == "fail") & ~advisory, "failure").otherwise("neutral"))


def gate_decision(verdicts: DataFrame, fail_on=(DEFAULT_FRAMEWORK,)) -> DataFrame:
    """Whether each verdict fails its step; frameworks outside ``fail_on`` are advisory."""
    advisory = ~F.col("framework").isin(*fail_on) if fail_on else F.lit(True)
    fails = (F.col("verdict") == "fail") & ~advisory
    message = F.concat(F.col("framework"), F.lit(" failed: "), F.col("n_block").cast("string"), F.lit(" blocking finding(s)."))
    return verdicts.withColumns({
        "advisory": advisory, "conclusion": conclusion(F.col("verdict"), advisory), "step_failed": fails,
        "message": F.when(fails, message)})


def primary_outcome(verdicts: DataFrame, key="change_id", default=DEFAULT_FRAMEWORK) -> DataFrame:
    """The default framework's outcome where scanned, else the first framework's."""
    w = Window.partitionBy(key).orderBy((F.col("framework") == default).desc(), "fw_ord")
    return verdicts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def not_recorded(submitted: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Submitted outcomes with no stored counterpart."""
    return submitted.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def degraded(changes: DataFrame, rulesets: list[Ruleset], reason: str, key="change_id", keep=()) -> DataFrame:
    """Verdict rows for changes that could not be scanned: never a silent pass."""
    names = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in (
        ("fw_ord", f.fw_ord), ("framework", f.framework), ("ruleset_version", f.version), ("ruleset_hash", f.hash))]) for f in rulesets]))
    code = "no_diff" if rulesets else "no_ruleset"
    base = changes.select(key, *keep, names.alias("f")).select(key, *keep, "f.*") if rulesets else changes.select(
        key, *keep, F.lit(0).alias("fw_ord"), F.lit(DEFAULT_FRAMEWORK).alias("framework"),
        F.lit(None).cast("bigint").alias("ruleset_version"), F.lit(None).cast("string").alias("ruleset_hash"))
    detail = WARNING_TEXT[code].format(reason=reason)
    zero = F.lit(0).cast("bigint")
    return base.select(
        key, "fw_ord", "framework", "ruleset_version", "ruleset_hash", *keep, F.lit("needs_review").alias("verdict"), zero.alias("n_block"),
        zero.alias("n_review"), zero.alias("n_advise"), F.lit(True).alias("incomplete"),
        F.array(F.struct(F.lit(code).alias("code"), F.lit(detail).alias("detail"), F.lit(True).alias("floors"))).alias("warnings"))


def withheld_rules(rulesets: DataFrame) -> DataFrame:
    """Dropped rules per ruleset: withheld by the server, or needing a capability we lack.

    ``dropped_rules`` is ARRAY<VARIANT>, because old servers send bare rule ids.
    """
    caps = "try_variant_get(d, '$.missing_caps', 'array<variant>')"
    names = (f"transform({caps}, c -> if(schema_of_variant(c) = 'STRING', try_variant_get(c, '$', 'string'), null))")
    known = ", ".join(f"'{c}'" for c in SUPPORTED_CAPS)
    server_side = F.expr(
        f"filter(dropped_rules, d -> coalesce(size({caps}) > 0 and array_contains({names}, '{CONTEXT_CAP}') "
        f"and forall({names}, c -> coalesce(c in ({known}), false)), false))")
    total = F.coalesce(F.array_size("dropped_rules"), F.lit(0))
    server = F.coalesce(F.array_size(server_side), F.lit(0))
    return rulesets.withColumns({"withheld": total, "server_side": server, "unsupported": total - server})


def _detail(code: str, **parts: Column) -> Column:
    """A warning text with columns in the places of its fields."""
    pieces = [(text, name) for text, name, _, _ in Formatter().parse(WARNING_TEXT[code])]
    return F.concat(*[c for text, name in pieces for c in (F.lit(text), parts[name].cast("string") if name else F.lit(""))])


def service_warnings(docs: DataFrame, key="doc_id", body="json") -> DataFrame:
    """What ruleset documents did not serve: one row per (document, framework, code, detail, floors).

    A document that cannot be used floors (its framework is null); withheld rules, a rejected context and frameworks the
    document names as unavailable do not. Documents that served all they hold have no row.
    """
    name = F.col("framework")
    served = withheld_rules(load_rulesets(docs, key, body))
    kinds = ((F.col("unsupported") > 0, "unsupported_rules", {"n": F.col("unsupported")}),
             (F.col("server_side") > 0, "withheld_rules", {"n": F.col("server_side")}),
             (F.col("context_rejected"), "context_rejected", {"framework": name}))
    raised = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(code).alias("code"), _detail(code, **parts).alias("detail"))) for on, code, parts in kinds]))
    noted = served.select(key, "framework", F.explode(raised).alias("w")).select(key, "framework", "w.*")

    def rows(df: DataFrame, of: Column, code: str, **parts: Column) -> DataFrame:
        return df.select(key, of.cast("string").alias("framework"), F.lit(code).alias("code"), _detail(code, **parts).alias("detail"))

    gone = rows(unavailable(docs, key, body), name, "unserved", framework=name, reason=F.col("reason"))
    failed = rows(document_errors(docs, key, body), F.lit(None), "no_ruleset", reason=F.col("error"))
    return noted.unionByName(gone).unionByName(failed).withColumn("floors", F.col("code") == "no_ruleset")
