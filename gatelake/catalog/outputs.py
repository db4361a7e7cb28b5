"""Queries that shape findings and verdicts into report tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import allowlist, checksums, masking
from ..operators import reports, verdicts as ver
from ..plans.workspace import shared_folder
from ..sources import sinks
from ..sources.rulesets import load_rulesets
from . import sql, views
from .registry import query
from .scans import _CARD, CHANGES, change_scan, document_scan

_RANK = "CASE action WHEN 'block' THEN 0 WHEN 'review' THEN 1 ELSE 2 END"
_ARTICLES = """CASE rule_id WHEN 'card' THEN 'Art. 5, Art. 32' WHEN 'email' THEN 'Art. 4' WHEN 'ipv4' THEN 'Art. 4'
  WHEN 'eaa-ci-ai-endpoint' THEN 'Art. 50' WHEN 'eaa-ci-ai-import' THEN 'Art. 6, Art. 9' ELSE '' END"""


@query("export_findings", f"""
WITH {CHANGES}
SELECT change_id, framework, finding_ord AS export_ord, rule_id, action, masked_evidence, {_ARTICLES} AS articles FROM findings""")
def export_findings(spark, sf):
    rows = reports.export_findings(change_scan(spark, sf).findings)
    return rows.select("change_id", "framework", "export_ord", "rule_id", "action", "masked_evidence",
                       F.array_join(F.coalesce("articles", "gdpr_article"), ", ").alias("articles"))


ISSUES = f"""
issues AS (SELECT change_id, framework, fw, row_number() OVER (PARTITION BY change_id, framework ORDER BY {_RANK}, finding_ord) AS severity_pos,
  CASE fw WHEN 0 THEN 'Data Compliance: ' ELSE 'AI change control: ' END || masked_evidence AS description,
  CASE fw WHEN 0 THEN 'gate/data-compliance/' ELSE 'gate/ai-change-control/' END || rule_id AS check_name,
  CASE action WHEN 'block' THEN 'critical' WHEN 'review' THEN 'major' ELSE 'minor' END AS severity,
  coalesce(file, 'MERGE_REQUEST_DESCRIPTION') AS path, coalesce(line, 1)::BIGINT AS begin_line,
  sha256(framework || chr(0) || rule_id || chr(0) || coalesce(file, 'MERGE_REQUEST_DESCRIPTION') || chr(0) || coalesce(line, 1) || chr(0) || masked_evidence) AS fingerprint FROM findings)
"""


@query("code_quality", f"""
WITH {CHANGES}, {ISSUES}
SELECT change_id, framework, severity_pos, description, check_name, severity, path, begin_line, fingerprint FROM issues""")
def code_quality(spark, sf):
    rows = reports.code_quality(change_scan(spark, sf).findings)
    return rows.select("change_id", "framework", F.col("severity_pos").cast("bigint").alias("severity_pos"), "description", "check_name",
                       "severity", F.col("location.path").alias("path"), F.col("location.lines.begin").alias("begin_line"), "fingerprint")


@query("code_quality_json", f"""
WITH {CHANGES}, {ISSUES},
p AS (SELECT change_id, count(*) AS n, string_agg(fingerprint, ',' ORDER BY fw, severity_pos) AS prints FROM issues GROUP BY ALL)
SELECT doc_id AS change_id, coalesce(n, 0) AS n, coalesce(prints, '') AS prints FROM documents LEFT JOIN p ON p.change_id = doc_id""")
def code_quality_json(spark, sf):
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("change_id"))
    report = reports.code_quality_json(docs, reports.code_quality(change_scan(spark, sf).findings))
    back = F.from_json("report", "array<struct<description:string,fingerprint:string,location:struct<path:string,lines:struct<begin:bigint>>>>")
    return report.select("change_id", F.size(back).cast("bigint").alias("n"), F.array_join(F.transform(back, lambda i: i["fingerprint"]), ",").alias("prints"))


SUMMARY = f"""
rows AS (SELECT change_id, fw, string_agg('| ' || action || ' | ' || rule_id || ' | ' || {_ARTICLES} || ' | ' || masked_evidence || ' |', chr(10) ORDER BY finding_ord) AS t
         FROM findings GROUP BY ALL),
sizes AS (SELECT change_id, fw, count(*) AS n FROM findings GROUP BY ALL)
"""


@query("summary_markdown", f"""
WITH {sql.scan("docs", _CARD)}, {sql.VERDICTS}, {SUMMARY}
SELECT v.change_id, v.framework, '**Verdict: ' || verdict || '** — ' || n_block || ' blocking, ' || n_review || ' need review, ' || n_advise || ' advisory.' || chr(10) || chr(10) ||
  CASE WHEN n IS NULL THEN 'No findings.' ELSE '| Action | Rule | ' || CASE v.fw WHEN 0 THEN 'GDPR' ELSE 'May be relevant to' END || ' | Evidence (masked) |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || t END AS summary
FROM verdicts v LEFT JOIN rows USING (change_id, fw) LEFT JOIN sizes USING (change_id, fw)""")
def summary_markdown(spark, sf):
    """The summary up to its warnings, which have a query of their own."""
    scan = document_scan(spark, sf).stored(shared_folder(spark, "scan"))
    rows = reports.summaries(scan.verdicts, scan.findings, footer="-- end")
    return rows.select("change_id", "framework", F.regexp_replace("summary", r"(?s)(\n\n\*\*Warnings:\*\*.*)?\n\n-- end\z", "").alias("summary"))


@query("note_markdown", f"""
WITH {CHANGES}, {sql.VERDICTS},
top AS (SELECT *, row_number() OVER (PARTITION BY change_id, fw ORDER BY {_RANK}, finding_ord) AS k FROM findings),
rows AS (SELECT change_id, fw, string_agg('| ' || action || ' | `' || rule_id || '` | `' || masked_evidence || '` |', chr(10) ORDER BY k) AS t FROM top GROUP BY ALL),
sizes AS (SELECT change_id, fw, count(*) AS n FROM findings GROUP BY ALL),
parts AS (SELECT v.change_id, v.fw, '**' || CASE v.fw WHEN 0 THEN 'Data Compliance' ELSE 'AI change control' END || ':** ' ||
   CASE verdict WHEN 'pass' THEN '✅ passed' WHEN 'fail' THEN '❌ failed' ELSE '⚠️ needs review' END || chr(10) ||
   CASE WHEN n IS NULL THEN '' ELSE chr(10) || '| Action | Rule | Evidence (masked) |' || chr(10) || '| --- | --- | --- |' || chr(10) || t || chr(10) END AS part
  FROM verdicts v LEFT JOIN rows USING (change_id, fw) LEFT JOIN sizes USING (change_id, fw))
SELECT change_id, '<!-- compliance-gate -->' || chr(10) || '### Compliance gate' || chr(10) || chr(10) || string_agg(part, chr(10) ORDER BY fw) || chr(10) || '_Updated on every pipeline._' AS note
FROM parts GROUP BY change_id""")
def note_markdown(spark, sf):
    scan = change_scan(spark, sf, once=True).stored(shared_folder(spark, "scan"))
    return reports.notes(scan.verdicts, scan.findings)


def _payload_inputs(spark, sf):
    scan = change_scan(spark, sf, once=True).stored(shared_folder(spark, "scan"))
    changes = views.changes(spark, sf).select("change_id", "repo", "provider", "pr_number", "commit_sha")
    return changes, scan.verdicts, scan.findings


@query("payload_v1", f"""
WITH {CHANGES}, {sql.VERDICTS},
f AS (SELECT change_id, count(*) AS n, string_agg(rule_id || '/' || action || '/' || masked_evidence, ';' ORDER BY finding_ord) AS items FROM findings WHERE fw = 0 GROUP BY ALL)
SELECT change_id, sha256(c.repo || '|' || c.pr_number || '|' || c.commit_sha || '|' || ruleset_hash || '|' || verdict || '|' || coalesce(n, 0) || '|' || coalesce(items, '')) AS digest
FROM changes c JOIN verdicts v USING (change_id) LEFT JOIN f USING (change_id) WHERE v.fw = 0""")
def payload_v1(spark, sf):
    rows = reports.single_payloads(*_payload_inputs(spark, sf))
    back = rows.select("change_id", F.from_json("payload", """repo string, pr_number bigint, commit_sha string, ruleset_version int, ruleset_hash string,
        verdict string, findings array<struct<rule_id:string,action:string,masked_evidence:string>>""").alias("p"))
    items = F.array_join(F.transform("p.findings", lambda f: F.concat_ws("/", f["rule_id"], f["action"], f["masked_evidence"])), ";")
    return back.select("change_id", F.sha2(F.concat_ws("|", "p.repo", F.col("p.pr_number").cast("string"), "p.commit_sha", "p.ruleset_hash", "p.verdict",
                                                       F.size("p.findings").cast("string"), items), 256).alias("digest"))


@query("payload_v2", f"""
WITH {CHANGES}, {sql.VERDICTS},
f AS (SELECT change_id, fw, count(*) AS n, string_agg(rule_id || '/' || action, ';' ORDER BY finding_ord) AS items FROM findings GROUP BY ALL),
r AS (SELECT change_id, string_agg(framework || '|' || ruleset_hash || '|' || verdict || '|' || coalesce(n, 0) || '|' || coalesce(items, ''), '#' ORDER BY fw) AS results
      FROM verdicts LEFT JOIN f USING (change_id, fw) GROUP BY ALL)
SELECT change_id, sha256(c.repo || '|' || c.provider || '|' || results) AS digest FROM changes c JOIN r USING (change_id)""")
def payload_v2(spark, sf):
    rows = reports.payloads(*_payload_inputs(spark, sf))
    back = rows.select("change_id", F.from_json("payload", """repo string, provider string, results array<struct<framework:string,ruleset_hash:string,
        verdict:string,findings:array<struct<rule_id:string,action:string>>>>""").alias("p"))
    result = F.transform("p.results", lambda r: F.concat_ws(
        "|", r["framework"], r["ruleset_hash"], r["verdict"], F.size(r["findings"]).cast("string"),
        F.array_join(F.transform(r["findings"], lambda f: F.concat_ws("/", f["rule_id"], f["action"])), ";")))
    return back.select("change_id", F.sha2(F.concat_ws("|", "p.repo", "p.provider", F.array_join(result, "#")), 256).alias("digest"))


@query("written_findings", f"""
WITH {CHANGES}
SELECT change_id, framework, finding_ord, rule_id, masked_evidence FROM findings""")
def written_findings(spark, sf):
    """The findings table as a reader of the written files sees it."""
    folder = shared_folder(spark, "findings")
    sinks.write_table(change_scan(spark, sf).findings, folder)
    return spark.read.parquet(folder).select("change_id", "framework", "finding_ord", "rule_id", "masked_evidence")


@query("clamped_fields", """
SELECT doc_id, left(text, 500) AS shown, array_to_string(list_transform(string_split(text, ' ')[1:20], lambda w: left(w, 4)), ' ') AS words FROM documents""")
def clamped_fields(spark, sf):
    """Fields bounded by limits that the caller names."""
    docs = views.table(spark, sf, "documents")
    return docs.select("doc_id", masking.clamp_text(F.col("text"), 500).alias("shown"),
                       F.array_join(masking.clamp_list(F.split("text", " "), 20, 4), " ").alias("words"))


@query("relative_paths", r"""
SELECT page_id, regexp_replace(repeat('./', (page_id % 4)::INT) || repeat('/', (page_id % 3)::INT) || url, '^(\./+|/+)+', '') AS path FROM pages""")
def relative_paths(spark, sf):
    made = F.expr("concat(repeat('./', int(page_id % 4)), repeat('/', int(page_id % 3)), url)")
    return views.table(spark, sf, "pages").select("page_id", masking.relative_path(made).alias("path"))


@query("action_verdicts", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'needs_review' ELSE 'pass' END AS verdict FROM events""")
def action_verdicts(spark, sf):
    action = F.get(F.array(*map(F.lit, ("block", "review", "advise", "other"))), (F.col("event_id") % 4).cast("int"))
    return views.table(spark, sf, "events").select("event_id", ver.action_verdict(action).alias("verdict"))


@query("registered_validator", """
SELECT c_custkey, regexp_matches(c_name, '[02468]$') AS even, 2 AS known FROM customer""")
def registered_validator(spark, sf):
    """A validator that the caller adds to the registry, beside one that is there and one that is not."""
    checksums.register_validator("ends-even", lambda v: f"{v} rlike '[02468]$'", min_digits=1)
    known = len(checksums.known(["iban", "ends-even", "nowhere"]))
    return views.table(spark, sf, "customer").select(
        "c_custkey", checksums.is_valid("ends-even", F.col("c_name")).alias("even"), F.lit(known).cast("bigint").alias("known"))


ALLOWLISTED = """concat('{"schema": 2, "rulesets": [{"framework": "Data Compliance", "ruleset_version": 1, "ruleset_hash": "h", "rules": [], "allowlist": {"emails": ["',
  c_mktsegment, '@X.io"], "ibans": ["DE 89-', c_nationkey, '"], "domains": ["Low.org"]}}]}')"""


@query("allowlist_entries", """
SELECT DISTINCT 'Data Compliance' AS framework, kind, entry FROM (
  SELECT 'emails' AS kind, lower(c_mktsegment) || '@x.io' AS entry FROM customer UNION ALL SELECT 'ibans', 'de89' || c_nationkey FROM customer
  UNION ALL SELECT 'domains', 'low.org' FROM customer)""")
def allowlist_entries(spark, sf):
    docs = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(ALLOWLISTED).alias("json"))
    return allowlist.allow_entries(load_rulesets(docs))
