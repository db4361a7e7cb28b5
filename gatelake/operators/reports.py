"""Report tables over findings and verdicts; everything shown is already masked."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import (DEFAULT_FRAMEWORK, DEFAULT_PROVIDER, DESCRIPTION_PATH, FRAMEWORK_ARTICLE_LABELS, FRAMEWORK_SLUGS,
                         FRAMEWORK_TITLES)
from ..functions import masking
from .findings import severity_rank, top_by_severity

KEYS = ("change_id", "framework")


def _lookup(column: str, values: dict) -> Column:
    return F.coalesce(*[F.when(F.col(column) == k, F.lit(v)) for k, v in values.items()], F.col(column))


def _most_severe(found: DataFrame, limit: int | None) -> DataFrame:
    """Findings with their place by severity; all of them unless the caller names how many."""
    if limit is not None:
        return top_by_severity(found, limit, *KEYS)
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy(severity_rank(F.col("action")), "finding_ord"))
    return found.withColumn("severity_pos", place)


def export_findings(found: DataFrame, limit: int | None = None, chars: int | None = None, items: int | None = None) -> DataFrame:
    """What leaves the gate: findings in order of discovery, digits grouped.

    With a limit, a change and framework with more findings keeps its most severe ones, sorted by severity; ``chars``
    and ``items`` bound the fields where named.
    """
    if limit is None:
        kept = found.withColumn("export_ord", F.col("finding_ord"))
    else:
        top = top_by_severity(found, limit + 1, *KEYS)
        sizes = F.max("severity_pos").over(Window.partitionBy(*KEYS))
        place = F.when(sizes > limit, F.col("severity_pos")).otherwise(F.col("finding_ord"))
        kept = top.withColumn("export_ord", place.cast("bigint")).where(F.col("severity_pos") <= limit)
    return kept.select(
        *KEYS, "fw_ord", "export_ord", masking.clamp_text(F.col("rule_id"), chars).alias("rule_id"),
        masking.clamp_list(F.col("articles"), items, chars).alias("articles"),
        masking.clamp_list(F.col("gdpr_article"), items, chars).alias("gdpr_article"),
        "action", masking.clamp_text(masking.group_digits(F.col("masked_evidence")), chars).alias("masked_evidence"))


def _finding_lists(found: DataFrame, limit: int | None) -> DataFrame:
    """The exported findings of a (change, framework) as one ordered array, which the payload needs in one piece."""
    row = F.struct("export_ord", F.struct("rule_id", "gdpr_article", "articles", "action", "masked_evidence").alias("f"))
    lists = export_findings(found, limit).groupBy(*KEYS).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return lists.select(*KEYS, F.transform("rows", lambda r: r["f"]).alias("findings"))


def ruleset_contexts(verdicts: DataFrame, rulesets: list) -> DataFrame:
    """(change_id, framework, context, context_hash) of the rulesets that came with a context, for ``payloads``."""
    def of(make) -> Column:
        return F.coalesce(*[F.when(F.col("framework") == fw.framework, F.lit(make(fw))) for fw in rulesets if fw.context is not None],
                          F.lit(None).cast("string"))

    return verdicts.select(*KEYS, F.parse_json(of(lambda fw: json.dumps(fw.context, sort_keys=True))).alias("context"),
                           of(lambda fw: fw.context_hash).alias("context_hash"))


def payloads(changes: DataFrame, verdicts: DataFrame, found: DataFrame, contexts: DataFrame | None = None,
             limit: int | None = None) -> DataFrame:
    """One multi-framework body per change; ``contexts`` is (change_id, framework, context, context_hash)."""
    rows = verdicts.select(*KEYS, "fw_ord", "ruleset_version", "ruleset_hash", "verdict") \
        .join(_finding_lists(found, limit), list(KEYS), "left")
    if contexts is not None:
        both = F.col("context").isNotNull() & F.col("context_hash").isNotNull()
        rows = rows.join(contexts.where(both), list(KEYS), "left")
    else:
        rows = rows.withColumns({"context": F.lit(None).cast("variant"), "context_hash": F.lit(None).cast("string")})
    empty = F.array().cast("array<struct<rule_id:string,gdpr_article:array<string>,articles:array<string>,"
                           "action:string,masked_evidence:string>>")
    result = F.struct("framework", "ruleset_version", "ruleset_hash", "verdict",
                      F.coalesce("findings", empty).alias("findings"), "context", "context_hash")
    per_change = rows.groupBy("change_id").agg(F.collect_list(F.struct("fw_ord", result.alias("r"))).alias("rs"))
    ordered = F.transform(F.array_sort("rs", lambda a, b: a["fw_ord"] - b["fw_ord"]), lambda x: x["r"])
    return changes.join(per_change, "change_id").select(
        "change_id", F.to_json(F.struct(
            "repo", "pr_number", "commit_sha", F.coalesce("provider", F.lit(DEFAULT_PROVIDER)).alias("provider"),
            ordered.alias("results"))).alias("payload"))


def single_payloads(changes: DataFrame, verdicts: DataFrame, found: DataFrame, framework=DEFAULT_FRAMEWORK,
                    limit: int | None = None) -> DataFrame:
    """The one-verdict body of the default framework."""
    mine = F.col("framework") == framework
    rows = verdicts.where(mine).select(*KEYS, "ruleset_version", "ruleset_hash", "verdict") \
        .join(_finding_lists(found.where(mine), limit), list(KEYS), "left")
    empty = F.array().cast("array<struct<rule_id:string,gdpr_article:array<string>,articles:array<string>,"
                           "action:string,masked_evidence:string>>")
    return changes.join(rows, "change_id").select("change_id", F.to_json(F.struct(
        "repo", "pr_number", "commit_sha", "ruleset_version", "ruleset_hash", "verdict",
        F.coalesce("findings", empty).alias("findings"))).alias("payload"))


def code_quality(found: DataFrame, tool: str = "gate", limit: int | None = None) -> DataFrame:
    """Code Quality issues of every (change, framework) by severity, or the ``limit`` most severe of each."""
    relative = masking.relative_path(F.col("file"))
    path = F.when(F.coalesce(relative, F.lit("")) == "", DESCRIPTION_PATH).otherwise(relative)
    begin = F.when(F.coalesce(F.col("file"), F.lit("")) == "", 1).when(F.col("line") >= 1, F.col("line")).otherwise(1)
    severity = (F.when(F.col("action") == "block", "critical").when(F.col("action") == "review", "major")
                .when(F.col("action") == "advise", "minor").otherwise("info"))
    top = _most_severe(found, limit).withColumns({"path": path, "begin": begin.cast("bigint")})
    identity = F.concat_ws(chr(0), "framework", "rule_id", "path", F.col("begin").cast("string"), "masked_evidence")
    return top.select(
        *KEYS, "fw_ord", "severity_pos",
        F.concat(_lookup("framework", FRAMEWORK_TITLES), F.lit(": "), "masked_evidence").alias("description"),
        F.concat_ws("/", F.lit(tool), _lookup("framework", FRAMEWORK_SLUGS), "rule_id").alias("check_name"),
        F.sha2(identity, 256).alias("fingerprint"), severity.alias("severity"),
        F.struct("path", F.struct("begin").alias("lines")).alias("location"))


def code_quality_json(changes: DataFrame, issues: DataFrame) -> DataFrame:
    """One JSON array per change with a trailing newline; ``[]`` where nothing was found."""
    issue = F.struct("description", "check_name", "fingerprint", "severity", "location")
    rows = issues.groupBy("change_id").agg(F.array_sort(F.collect_list(
        F.struct("fw_ord", "severity_pos", issue.alias("issue")))).alias("rows"))
    body = F.to_json(F.transform("rows", lambda r: r["issue"]), {"pretty": "true"})
    return changes.select("change_id").join(rows, "change_id", "left").select(
        "change_id", F.concat(F.coalesce(body, F.lit("[]")), F.lit("\n")).alias("report"))


def _shown_rows(found: DataFrame, limit: int | None, position: str, line: Column) -> DataFrame:
    """The rendered rows per (change, framework), or the first ``limit``, joined by newlines."""
    rows = (found if limit is None else found.where(F.col(position) <= limit)).select(*KEYS, F.col(position).alias("p"), line.alias("line"))
    lists = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("p", "line"))).alias("rows"))
    return lists.select(*KEYS, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("table"))


def _cells(*cells: Column) -> Column:
    parts = [F.lit("| ")]
    for i, c in enumerate(cells):
        parts += ([F.lit(" | ")] if i else []) + [c]
    return F.concat(*parts, F.lit(" |"))


def _beyond(total: Column, limit: int | None, before: str, after: str) -> Column:
    """What a limit left out, or null."""
    if limit is None:
        return F.lit(None).cast("string")
    return F.when(total > limit, F.concat(F.lit("\n" + before), (total - limit).cast("string"), F.lit(after)))


def summaries(verdicts: DataFrame, found: DataFrame, footer: str = "_Scanned in your CI. Raw text never leaves it._",
              limit: int | None = None) -> DataFrame:
    """Markdown summary per (change, framework): counts, all rows or ``limit`` and what is beyond, warnings."""
    articles = F.array_join(F.coalesce("articles", "gdpr_article", F.array().cast("array<string>")), ", ")
    found = found.withColumn("article_list", articles)
    line = _cells(*[masking.markdown_cell(F.col(c)) for c in ("action", "rule_id", "article_list", "masked_evidence")])
    rows = verdicts.join(_shown_rows(found, limit, "finding_ord", line), list(KEYS), "left")
    total = F.col("n_block") + F.col("n_review") + F.col("n_advise")
    head = F.concat(F.lit("**Verdict: "), "verdict", F.lit("** — "), F.col("n_block").cast("string"), F.lit(" blocking, "),
                    F.col("n_review").cast("string"), F.lit(" need review, "), F.col("n_advise").cast("string"), F.lit(" advisory."))
    header = F.concat(F.lit("| Action | Rule | "), _lookup("framework", FRAMEWORK_ARTICLE_LABELS),
                      F.lit(" | Evidence (masked) |\n| --- | --- | --- | --- |"))
    over = _beyond(total, limit, "_…and ", " more findings (truncated for display)._")
    warned = F.when(F.size("warnings") > 0, F.concat(
        F.lit("\n**Warnings:**\n"), F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("- "), w["detail"])), "\n")))
    body = F.concat_ws("\n", head, F.lit(""), F.when(total > 0, F.concat(header, F.lit("\n"), "table")).otherwise("No findings."),
                       over, warned, F.lit(""), F.lit(footer))
    return rows.select(*KEYS, "fw_ord", body.alias("summary"))


def notes(verdicts: DataFrame, found: DataFrame, heading: str = "### Compliance gate",
          marker: str = "<!-- compliance-gate -->", footer: str = "_Updated on every pipeline._", limit: int | None = None) -> DataFrame:
    """One markdown note per change: a verdict per framework and its findings by severity, or the ``limit`` most severe."""
    line = _cells(F.col("action"), masking.code_span(F.col("rule_id")), masking.code_span(F.col("masked_evidence")))
    rows = verdicts.join(_shown_rows(_most_severe(found, limit), limit, "severity_pos", line), list(KEYS), "left")
    kept = F.col("n_block") + F.col("n_review") + F.col("n_advise")
    mark = F.when(F.col("verdict") == "pass", "✅ passed").when(F.col("verdict") == "fail", "❌ failed") \
        .otherwise("⚠️ needs review")
    head = F.concat(F.lit("**"), _lookup("framework", FRAMEWORK_TITLES), F.lit(":** "), mark, F.lit("\n"))
    over = _beyond(kept, limit, "…and ", " more finding(s).")
    table = F.when(kept > 0, F.concat_ws(
        "\n", F.lit("| Action | Rule | Evidence (masked) |\n| --- | --- | --- |"), F.col("table"), over, F.lit("")))
    part = F.concat_ws("\n", head, table)
    parts = rows.select("change_id", "fw_ord", part.alias("part")).groupBy("change_id").agg(
        F.array_sort(F.collect_list(F.struct("fw_ord", "part"))).alias("parts"))
    return parts.select("change_id", F.concat_ws(
        "\n", F.lit(marker), F.lit(heading), F.lit(""), F.array_join(F.transform("parts", lambda p: p["part"]), "\n"),
        F.lit(footer)).alias("note"))
