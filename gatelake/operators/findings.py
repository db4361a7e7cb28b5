"""De-duplicated findings and their per-change counts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import SEVERITY
from .rules import Ruleset


def action_name(severity: Column) -> Column:
    return F.get(F.array(*[F.lit(a) for a in SEVERITY]), severity)


def severity_rank(action: Column) -> Column:
    """block, review, advise, then anything else."""
    return F.coalesce(*[F.when(action == a, s) for a, s in SEVERITY.items()], F.lit(3))


def _per_rule(rulesets: list[Ruleset], make, cast: str) -> Column:
    """A literal lookup by (framework, rule) position."""
    if not rulesets:
        return F.lit(None).cast(cast)
    rows = [F.array(*[make(r).cast(cast) for r in fw.rules]) if fw.rules else F.array().cast(f"array<{cast}>")
            for fw in rulesets]
    return F.get(F.get(F.array(*rows), F.col("fw_ord")), F.col("rule_ord"))


def _strings(values) -> Column:
    return F.lit(None) if values is None else F.array(*[F.lit(v) for v in values])


def deduplicated(hits: DataFrame, rulesets: list[Ruleset], key="change_id") -> DataFrame:
    """First hit per (change, framework, rule id, evidence) in rule, side, line, match order.

    ``row_number() = 1`` lets Spark drop later duplicates in each map task before the shuffle.
    """
    named = hits.withColumn("rule_id", _per_rule(rulesets, lambda r: F.lit(r.id), "string"))
    first = Window.partitionBy(key, "fw_ord", "rule_id", "evidence").orderBy("rule_ord", "ord")
    return named.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")


def findings(hits: DataFrame, rulesets: list[Ruleset], key="change_id") -> DataFrame:
    """The findings table; ``finding_ord`` is the order of discovery within its change and framework."""
    unique = deduplicated(hits, rulesets, key)
    order = Window.partitionBy(key, "fw_ord").orderBy("rule_ord", "ord")
    framework = F.get(F.array(*[F.lit(fw.framework) for fw in rulesets]).cast("array<string>"), F.col("fw_ord"))
    empty = F.array().cast("array<string>")
    articles = _per_rule(rulesets, lambda r: _strings(r.articles), "array<string>")
    gdpr = _per_rule(rulesets, lambda r: _strings(r.gdpr_article), "array<string>")
    return unique.select(
        key, framework.alias("framework"), "fw_ord", F.row_number().over(order).cast("bigint").alias("finding_ord"), "rule_id",
        articles.alias("articles"), F.when(articles.isNull(), F.coalesce(gdpr, empty)).alias("gdpr_article"),
        action_name(F.col("severity")).alias("action"), F.col("evidence").alias("masked_evidence"), "file", "line")


def action_counts(found: DataFrame, *keys: str) -> DataFrame:
    counts = [F.count_if(F.col("action") == a).alias(f"n_{a}") for a in SEVERITY]
    return found.groupBy(*keys).agg(*counts)


def top_by_severity(found: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The ``limit`` most severe findings per key, stable by discovery; ``severity_pos`` is their place."""
    w = Window.partitionBy(*keys).orderBy(severity_rank(F.col("action")), "finding_ord")
    return found.withColumn("severity_pos", F.row_number().over(w)).where(F.col("severity_pos") <= limit)
