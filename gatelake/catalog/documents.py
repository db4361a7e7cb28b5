"""Queries over ruleset documents, file trees and inventory runs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SIGNATURE_FAMILIES
from ..operators import inventory as inv, verdicts as ver
from ..operators.rules import compile_rulesets
from ..sources import rulesets as src
from . import views
from .registry import query
from .rulesets import INVENTORY_RULES

# One ruleset document per customer: both shapes, and every way one can be unusable.
DOCUMENT = r"""case cast(c_custkey % 9 as int)
 when 0 then concat('{"ruleset_version": ', c_custkey, ', "ruleset_hash": "', md5(c_name), '", "rules": [{"id": "r', c_custkey, '", "tier": 1, "detect": {"pattern": "', lower(c_mktsegment), '"}}]}')
 when 1 then concat('{"schema": 2, "rulesets": [{"framework": "Other", "rules": 5}, {"framework": "EU AI Act", "ruleset_version": 1.5, "ruleset_hash": "h', c_nationkey, '", "rules": [{"id": "a", "baseline": true}, {"id": "eaa-ci-ai-import", "baseline": true}], "context": {"repo_linked": true}, "context_hash": "', sha2(c_name, 256), '"}], "unavailable": [{"framework": "EU<AI>', c_nationkey, '", "reason": "not_served"}, {"framework": "x", "reason": "NOT"}]}')
 when 2 then concat('{"schema": 2, "rulesets": [{"framework": "Data Compliance", "ruleset_version": 3, "ruleset_hash": "h", "rules": [], "context": {"repo_linked": "true"}, "context_hash": "', upper(sha2(c_name, 256)), '", "dropped_rules": ["bare", {"id": "x", "missing_caps": ["context"]}, {"id": "y", "missing_caps": ["context", "graph"]}, {"id": "z", "missing_caps": []}]}]}')
 when 3 then '{"schema": 2, "rulesets": [{"framework": "EU AI Act", "ruleset_version": "1", "ruleset_hash": "h", "rules": []}]}'
 when 4 then concat('not json ', c_name)
 when 5 then concat('[', c_custkey, ']')
 when 6 then '{"schema": 2}'
 when 7 then concat('{"schema": 2, "rulesets": [{"framework": "', c_mktsegment, '"}]}')
 else concat('{"ruleset_version": 1, "ruleset_hash": ', c_custkey, ', "rules": []}') end"""


def documents(spark, sf):
    return views.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(DOCUMENT).alias("json"))


@query("rulesets_loaded", """
SELECT c_custkey AS doc_id, 'legacy' AS shape, 'Data Compliance' AS framework, c_custkey AS ruleset_version, md5(c_name) AS ruleset_hash, 1 AS n_rules, 'ok' AS error FROM customer WHERE c_custkey % 9 = 0
UNION ALL SELECT c_custkey, 'schema2', 'EU AI Act', 1, 'h' || c_nationkey, 2, 'ok' FROM customer WHERE c_custkey % 9 = 1
UNION ALL SELECT c_custkey, 'schema2', 'Data Compliance', 3, 'h', 0, 'ok' FROM customer WHERE c_custkey % 9 = 2
UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, NULL, (['missing-version', 'not-json', 'not-object', 'no-rulesets', 'no-known-framework', 'missing-hash'])[c_custkey % 9 - 2]
FROM customer WHERE c_custkey % 9 > 2""")
def rulesets_loaded(spark, sf):
    docs = documents(spark, sf)
    good = src.load_rulesets(docs).select("doc_id", "shape", "framework", F.floor(F.col("ruleset_version")).cast("bigint").alias("ruleset_version"),
                                          "ruleset_hash", F.array_size("rules").alias("n_rules"), F.lit("ok").alias("error"))
    return good.unionByName(src.document_errors(docs), allowMissingColumns=True)


@query("ruleset_context_check", """
SELECT c_custkey AS doc_id, c_custkey % 9 = 1 AS kept, CASE WHEN c_custkey % 9 = 1 THEN sha256(c_name) END AS context_hash, c_custkey % 9 = 2 AS context_rejected,
       CASE WHEN c_custkey % 9 = 1 THEN 'EUAI' || c_nationkey || ': not_served' END AS unavailable
FROM customer WHERE c_custkey % 9 < 3""")
def ruleset_context_check(spark, sf):
    docs = documents(spark, sf)
    gone = src.unavailable(docs).groupBy("doc_id").agg(F.concat_ws("; ", F.array_sort(F.collect_list(
        F.concat("framework", F.lit(": "), "reason")))).alias("unavailable"))
    return src.load_rulesets(docs).select("doc_id", F.col("context").isNotNull().alias("kept"), "context_hash", "context_rejected") \
        .join(gone, "doc_id", "left")


@query("withheld_rules", """
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 9 = 2 THEN 4 ELSE 0 END AS withheld, CASE WHEN c_custkey % 9 = 2 THEN 1 ELSE 0 END AS server_side,
       CASE WHEN c_custkey % 9 = 2 THEN 3 ELSE 0 END AS unsupported FROM customer WHERE c_custkey % 9 < 3""")
def withheld_rules(spark, sf):
    return ver.withheld_rules(src.load_rulesets(documents(spark, sf))).select("doc_id", "withheld", "server_side", "unsupported")


@query("service_warnings", """
SELECT c_custkey AS doc_id, 'EUAI' || c_nationkey AS framework, 'unserved' AS code, 'EUAI' || c_nationkey || ' was not served in this run (not_served), so it was not scanned.' AS detail, false AS floors
FROM customer WHERE c_custkey % 9 = 1
UNION ALL SELECT c_custkey, 'Data Compliance', 'unsupported_rules', '3 rule(s) withheld because a capability they need is not supported here.', false FROM customer WHERE c_custkey % 9 = 2
UNION ALL SELECT c_custkey, 'Data Compliance', 'withheld_rules', '1 rule(s) withheld: no registry context could be attached (no valid repository).', false FROM customer WHERE c_custkey % 9 = 2
UNION ALL SELECT c_custkey, 'Data Compliance', 'context_rejected', 'The registry context of Data Compliance could not be used and was ignored; findings keep their declared action.', false FROM customer WHERE c_custkey % 9 = 2
UNION ALL SELECT c_custkey, NULL, 'no_ruleset', 'Ruleset unavailable: ' || (['missing-version', 'not-json', 'not-object', 'no-rulesets', 'no-known-framework', 'missing-hash'])[c_custkey % 9 - 2], true
FROM customer WHERE c_custkey % 9 > 2""")
def service_warnings(spark, sf):
    return ver.service_warnings(documents(spark, sf))


@query("inventory_rules", """
SELECT c_custkey AS doc_id, 1 AS rule_ord, 'eaa-ci-ai-import' AS rule_id FROM customer WHERE c_custkey % 9 = 1""")
def inventory_rules(spark, sf):
    rules = src.explode_rules(src.load_rulesets(documents(spark, sf)))
    return src.inventory_rules(rules).select("doc_id", "rule_ord", F.col("rule.id").alias("rule_id"))


AUDITED = """to_json(named_struct('id', concat('p', p_partkey), 'tier', int(p_partkey % 3 + 1), 'detect', named_struct(
 'pattern', concat(get(array('', '(?i)', '(?x)', '(?gi)', '('), int(p_partkey % 5)), p_name),
 'exclude_pattern', get(array('', '(?i)', lower(p_type)), int(p_partkey % 3)),
 'require_context', if(p_partkey % 7 = 0, concat('a++', p_brand), p_brand),
 'file_scope', array(get(array('*', 'src/*', '*a*b*c*d*e'), int(p_partkey % 4)), p_name))))"""


@query("rule_audit", """
SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 5 IN (2, 4) THEN 'pattern' END, CASE WHEN p_partkey % 3 = 1 THEN 'exclude_pattern' END,
         CASE WHEN p_partkey % 7 = 0 THEN 'require_context' END) AS unusable_fields,
       false AS gate_refused, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS blanket, CASE WHEN p_partkey % 4 = 2 THEN 1 ELSE 0 END AS complex
FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 3 <> 0
UNION ALL
SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 5 IN (2, 4) THEN 'pattern' END, CASE WHEN p_partkey % 7 = 0 THEN 'require_context' END),
       false, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END, CASE WHEN p_partkey % 4 = 2 THEN 1 ELSE 0 END
FROM part WHERE p_partkey % 3 IN (0, 2)""")
def rule_audit(spark, sf):
    parts = views.table(spark, sf, "part").select("p_partkey", F.from_json(F.expr(AUDITED), src.RULE).alias("rule"))
    audit = src.audit_rules(parts, "p_partkey")
    return audit.select("p_partkey", F.array_join("unusable_fields", ",").alias("unusable_fields"), "gate_refused",
                        F.size("blanket_globs").alias("blanket"), F.size("complex_globs").alias("complex"))


_FAMILY_WORDS = "'@ai-sdk/x', 'langchain-openai', 'llama_index', 'azure.ai.openai', 'bedrock-runtime', '@anthropic-ai/vertexai', 'Google', 'TRANSFORMERS', 'mistralai', 'Cohere', 'groq', 'replicate', 'ollama', 'litellm', 'openai', 'spring-ai-openai', 'plain'"
_FAMILY_SQL = " ".join(f"WHEN regexp_matches(lower(m), '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, p in SIGNATURE_FAMILIES)


@query("signature_family", f"""
WITH w AS (SELECT o_orderkey, ([{_FAMILY_WORDS}])[o_orderkey % 17 + 1] || ' ' || o_orderpriority AS m, CASE WHEN o_custkey % 10 = 0 THEN 'eaa-ci-emotion-biometric' ELSE 'eaa-ci-ai-import' END AS rule_id FROM orders)
SELECT o_orderkey, rule_id, CASE WHEN rule_id = 'eaa-ci-emotion-biometric' THEN 'emotion-biometric' {_FAMILY_SQL} ELSE 'other-ai' END AS signature_key FROM w""")
def signature_family(spark, sf):
    rows = views.table(spark, sf, "orders").select("o_orderkey", F.expr(
        f"concat(get(array({_FAMILY_WORDS}), int(o_orderkey % 17)), ' ', o_orderpriority)").alias("m"),
        F.when(F.col("o_custkey") % 10 == 0, "eaa-ci-emotion-biometric").otherwise("eaa-ci-ai-import").alias("rule_id"))
    return rows.select("o_orderkey", "rule_id", inv.family(F.col("rule_id"), F.col("m")).alias("signature_key"))


TREE = r"""
files AS (
  SELECT 'org/site' || (page_id % 7) AS repo, (['src/', 'docs/', 'web/', 'dist/', 'lib/'])[page_id % 5 + 1] || page_id || (['.html', '.ts', '.min.js', '.md'])[page_id // 5 % 4 + 1] AS path,
    CASE WHEN page_id % 11 = 4 THEN NULL ELSE html || chr(10) || 'import x from "' || (['@ai-sdk/openai', 'langchain/openai', 'openai', 'cohere', 'llama-index'])[page_id % 5 + 1] || '"' || chr(10) ||
      'call("https://' || (['api.mistral.ai', 'x.openai.azure.com', 'api.anthropic.com', 'api.openai.com'])[page_id % 4 + 1] || '");' END AS content,
    strlen(html) > 524000 AS big, strlen(html) AS html_bytes FROM pages),
kept AS (SELECT *, NOT regexp_matches(path, '(^|/)dist/|[.]min[.][^/]*$') AS open_, NOT regexp_matches(path, '(^|/)dist/|[.]min[.][^/]*$') AND NOT regexp_matches(path, '^docs/') AS in_import,
         NOT regexp_matches(path, '(^|/)dist/|[.]min[.][^/]*$') AND regexp_matches(path, '[.]html$|[.]ts$') AS in_endpoint FROM files),
tlines AS (SELECT repo, path, in_import, in_endpoint, open_, unnest(string_split(content, chr(10))) AS t FROM kept WHERE open_ AND content IS NOT NULL),
found AS (
  SELECT repo, path, t, 'eaa-ci-ai-import' AS rule_id, unnest(regexp_extract_all(t, '(?i)(import|from|require)\s*\(?["''][a-z@/._-]+["'']')) AS m, row_number() OVER () AS rn FROM tlines WHERE in_import AND NOT regexp_matches(t, '(?i)doctype')
  UNION ALL SELECT repo, path, t, 'eaa-ci-ai-endpoint', unnest(regexp_extract_all(t, '[a-z]+\.openai\.(azure\.)?com|api\.[a-z]+\.(com|ai)|track\([0-9]+\)')), row_number() OVER () FROM tlines WHERE in_endpoint
  UNION ALL SELECT repo, path, t, 'eaa-ci-emotion-biometric', unnest(regexp_extract_all(t, '(?i)emotion|<b>')), row_number() OVER () FROM tlines),
keyed AS (SELECT DISTINCT repo, path, rule_id, rn, CASE WHEN rule_id = 'eaa-ci-emotion-biometric' THEN 'emotion-biometric' FAMILY ELSE 'other-ai' END AS signature_key FROM found)
""".replace("FAMILY", _FAMILY_SQL)


def _inventory(spark, sf):
    rules = inv.baseline_rules(compile_rulesets(spark, [{"framework": "EU AI Act", "rules": INVENTORY_RULES}])[0])
    files = inv.scoped_files(views.source_tree(spark, sf), rules)
    return rules, files, inv.opened_files(files)


@query("inventory_lines", f"""
WITH {TREE} SELECT repo, path, rule_id, signature_key, count(*) AS lines FROM keyed GROUP BY ALL""")
def inventory_lines(spark, sf):
    rules, _, opened = _inventory(spark, sf)
    return inv.matching_lines(opened, rules).select("repo", "path", "rule_id", "signature_key", "lines")


@query("inventory", f"""
WITH {TREE}, totals AS (SELECT repo, rule_id, signature_key, count(*) AS "count" FROM keyed GROUP BY ALL),
paths AS (SELECT repo, rule_id, signature_key, string_agg(path, ',' ORDER BY path) AS sample_paths FROM
  (SELECT *, row_number() OVER (PARTITION BY repo, rule_id, signature_key ORDER BY path) AS k FROM (SELECT DISTINCT repo, rule_id, signature_key, path FROM keyed)) WHERE k <= 3 GROUP BY ALL)
SELECT repo, rule_id, signature_key, "count", sample_paths FROM totals JOIN paths USING (repo, rule_id, signature_key)""")
def inventory(spark, sf):
    rules, _, opened = _inventory(spark, sf)
    rows = inv.observations(inv.matching_lines(opened, rules), sample_paths=3)
    return rows.select("repo", "rule_id", "signature_key", "count", F.array_join("sample_paths", ",").alias("sample_paths"))


@query("inventory_stats", f"""
WITH {TREE}
SELECT repo, count(*) AS listed, count_if(NOT open_)::BIGINT AS out_of_scope, 0 AS skipped_size, count_if(open_ AND content IS NULL)::BIGINT AS skipped_binary,
  0 AS skipped_unreadable, count_if(open_ AND content IS NOT NULL)::BIGINT AS files_scanned,
  sum(CASE WHEN open_ AND content IS NOT NULL THEN len(list_filter(string_split(content, chr(10)), lambda l: length(l) > 8192)) ELSE 0 END)::BIGINT AS long_lines
FROM kept GROUP BY repo""")
def inventory_stats(spark, sf):
    rules, files, opened = _inventory(spark, sf)
    return inv.run_stats(files, opened, rules).drop("commit_sha", "truncated")


@query("inventory_completeness", f"""
WITH {TREE}, r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS k FROM kept WHERE open_)
SELECT repo, max(k) > 12 AS truncated, least(max(k), 12) AS opened FROM r GROUP BY repo""")
def inventory_completeness(spark, sf):
    """A cap of twelve files per repository leaves the larger ones incomplete."""
    rules = inv.baseline_rules(compile_rulesets(spark, [{"framework": "EU AI Act", "rules": INVENTORY_RULES}])[0])
    files = inv.scoped_files(views.source_tree(spark, sf), rules)
    stats = inv.run_stats(files, inv.opened_files(files, 12), rules)
    return stats.select("repo", "truncated", (F.col("files_scanned") + F.col("skipped_binary")).alias("opened"))


# Whole files of a page's size are read up to this many bytes in the query below, so each rule meets files it cannot read.
READ_BYTES = 1200
_BROKEN = [{**r, "detect": {**r["detect"], "pattern": "("}} if r["id"].endswith("sdk-manifest") else r for r in INVENTORY_RULES]
_BLANKET = [{**r, "detect": {**r["detect"], "file_scope": ["*", *r["detect"]["file_scope"]]}} if r["id"].endswith("endpoint") else r for r in INVENTORY_RULES]
# Name, rules, file cap.
SUMMARY_RUNS = (("plain", INVENTORY_RULES, None), ("capped", INVENTORY_RULES, 12), ("broken", _BROKEN, None), ("blanket", _BLANKET, None))


@query("inventory_summary", rf"""
WITH {TREE}, sized AS (SELECT *, content IS NULL AS nul, coalesce(strlen(content), html_bytes + 1) AS bytes FROM kept),
runs AS (SELECT * FROM (VALUES ('plain', 1000000000), ('capped', 12), ('broken', 1000000000), ('blanket', 1000000000)) v(run, cap)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run, repo ORDER BY path) AS k FROM sized, runs WHERE open_),
op AS (SELECT *, CASE WHEN bytes > {READ_BYTES} THEN 'size' WHEN nul THEN 'binary' ELSE 'scanned' END AS state FROM ranked WHERE k <= cap),
hit AS (SELECT run, keyed.repo, rule_id, signature_key, count(*) AS n FROM keyed JOIN op ON op.repo = keyed.repo AND op.path = keyed.path AND state = 'scanned' GROUP BY ALL),
obs AS (SELECT run, repo, string_agg(rule_id || '/' || signature_key || '/' || n, ',' ORDER BY rule_id, signature_key) AS observations FROM hit GROUP BY ALL),
per AS (SELECT run, repo, count(*) AS opened, count_if(state = 'size') AS skipped_size, count_if(state = 'binary') AS skipped_binary, count_if(state = 'scanned') AS files_scanned,
  (count_if(state <> 'size') = 0 OR count_if(in_import) > 0 AND count_if(in_import AND state <> 'size') = 0 OR count_if(in_endpoint) > 0 AND count_if(in_endpoint AND state <> 'size') = 0) AS unread
  FROM op GROUP BY ALL),
every AS (SELECT run, repo, count(*) AS listed, count_if(NOT open_) AS out_of_scope FROM sized, runs GROUP BY ALL)
SELECT run, repo, listed, out_of_scope::BIGINT AS out_of_scope, coalesce(skipped_size, 0)::BIGINT AS skipped_size, coalesce(skipped_binary, 0)::BIGINT AS skipped_binary,
  coalesce(files_scanned, 0)::BIGINT AS files_scanned, concat_ws(',', CASE WHEN run = 'broken' THEN 'rule_not_run' END, CASE WHEN run = 'blanket' THEN 'refused_scope' END,
    CASE WHEN listed - out_of_scope > coalesce(opened, 0) THEN 'file_cap' END, CASE WHEN unread THEN 'unread_scope' END) AS reasons,
  coalesce(observations, '') AS observations
FROM every LEFT JOIN per USING (run, repo) LEFT JOIN obs USING (run, repo)""")
def inventory_summary(spark, sf):
    """Counters, reasons and observations in one pass over the content, with a size limit and every way to be incomplete."""
    tree, out = views.source_tree(spark, sf), None
    for name, rules, cap in SUMMARY_RUNS:
        chosen = inv.baseline_rules(compile_rulesets(spark, [{"framework": "EU AI Act", "rules": rules}])[0])
        files = inv.scoped_files(tree, chosen)
        run = inv.run_summary(files, inv.opened_files(files, cap), chosen, READ_BYTES).select(
            F.lit(name).alias("run"), "repo", "listed", "out_of_scope", "skipped_size", "skipped_binary", "files_scanned",
            F.array_join("reasons", ",").alias("reasons"), F.array_join(F.transform("observations", lambda o: F.concat_ws(
                "/", o["rule_id"], o["signature_key"], o["count"].cast("string"))), ",").alias("observations"))
        out = run if out is None else out.unionByName(run)
    return out


RULE_OF = "get(array('eaa-ci-ai-import', 'eaa-ci-ai-endpoint', 'eaa-ci-emotion-biometric', 'custom'), int(event_id % 4))"
KEY_OF = "get(array('openai', 'cohere', 'emotion-biometric', event_type), int(event_id div 4 % 4))"
RULE_SQL = "(['eaa-ci-ai-import', 'eaa-ci-ai-endpoint', 'eaa-ci-emotion-biometric', 'custom'])[event_id % 4 + 1]"
KEY_SQL = "(['openai', 'cohere', 'emotion-biometric', event_type])[event_id // 4 % 4 + 1]"


@query("inventory_contract", f"""
WITH o AS (SELECT event_id, {RULE_SQL} AS rule_id, {KEY_SQL} AS signature_key FROM events)
SELECT * FROM o WHERE rule_id = 'custom' OR signature_key NOT IN ('openai', 'cohere', 'emotion-biometric')
  OR (rule_id = 'eaa-ci-emotion-biometric') <> (signature_key = 'emotion-biometric')""")
def inventory_contract(spark, sf):
    rows = views.table(spark, sf, "events").select("event_id", F.expr(RULE_OF).alias("rule_id"), F.expr(KEY_OF).alias("signature_key"))
    return inv.contract_violations(rows)


def _runs(spark, sf):
    """Each event as an inventory run of its user's repository, ordered by event id."""
    events = views.table(spark, sf, "events")
    runs = events.select(F.col("user_id").alias("repo"), F.col("event_id").alias("run"), (F.col("value") < 10).alias("truncated"))
    found = events.select(
        F.col("user_id").alias("repo"), F.col("event_id").alias("run"), F.expr(RULE_OF).alias("rule_id"),
        F.expr(KEY_OF).alias("signature_key"), (F.floor("value") + 1).cast("bigint").alias("count"))
    return runs, found


@query("inventory_state", f"""
WITH c AS (SELECT user_id, max(event_id) AS since FROM events WHERE NOT value < 10 GROUP BY ALL),
o AS (SELECT user_id AS repo, event_id AS run, {RULE_SQL} AS rule_id, {KEY_SQL} AS signature_key, floor(value)::BIGINT + 1 AS "count" FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY repo, rule_id, signature_key ORDER BY run DESC) AS k FROM o)
SELECT repo, rule_id, signature_key, run, "count" FROM l LEFT JOIN c ON c.user_id = l.repo WHERE k = 1 AND (since IS NULL OR run >= since)""")
def inventory_state(spark, sf):
    return inv.current_state(*_runs(spark, sf))


@query("inventory_latest_runs", """
SELECT repo, run, age FROM (SELECT user_id AS repo, event_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events) WHERE age <= 10""")
def inventory_latest_runs(spark, sf):
    runs, _ = _runs(spark, sf)
    return inv.latest_runs(runs).select("repo", "run", F.col("age").cast("bigint").alias("age"))
