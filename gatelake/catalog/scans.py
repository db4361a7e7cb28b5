"""Queries that scan documents and changes with the demo rulesets."""
from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..constants import CARD_LENGTHS, CARD_NO_LUHN, CARD_RANGES
from ..operators import detect, findings as fnd, pairs, reports, verdicts as ver
from ..operators.diff import diff_lines, side_lines
from ..operators.rules import compile_rulesets, scopes
from ..plans.workspace import shared_folder
from ..plans.scan import context_booleans, scan_changes, scan_lines
from ..sources.changes import cap_diffs
from ..sources.rulesets import load_rulesets, to_documents
from . import sql, views
from .registry import query
from .rulesets import RULESETS, SOUND_RULESETS, rule

_CARD = sql.card_ok("v", CARD_RANGES, CARD_LENGTHS, CARD_NO_LUHN)
DOCS, CHANGES, ALL_CHANGES = sql.scan("docs", _CARD), sql.scan("changes", _CARD), sql.scan("changes", _CARD, False)
COUNTS = ("n_block", "n_review", "n_advise")


def _only(documents, *ids):
    return [{**d, "rules": [r for r in d["rules"] if r["id"] in ids]} for d in documents]


def document_scan(spark, sf, rules=SOUND_RULESETS):
    sources = views.table(spark, sf, "documents").select(F.col("doc_id").alias("change_id"), F.col("text").isNull().alias("unreadable"))
    compiled = compile_rulesets(spark, rules)
    return scan_lines(views.doc_lines(spark, sf, scopes(compiled)), compiled, sources)


def _with_context(changes, contexts, compiled):
    joined = changes.join(contexts, "change_id", "left")
    return joined.withColumn("context", context_booleans(F.col("registry"), compiled)).drop("registry")


def change_scan(spark, sf, rules=SOUND_RULESETS, keep=(), once=False):
    """``once`` parses the diffs once for hits and coverage, which pays where both are read."""
    compiled = compile_rulesets(spark, rules)
    changes = _with_context(views.changes(spark, sf), views.contexts(spark, sf), compiled)
    return scan_changes(changes, compiled, keep=keep, scratch=shared_folder(spark, "lines") if once else None)


@query("ruleset_scan", f"""
WITH {DOCS} SELECT change_id, framework, finding_ord, rule_id, action, masked_evidence, file, line FROM findings""")
def ruleset_scan(spark, sf):
    return document_scan(spark, sf).findings.select(
        "change_id", "framework", "finding_ord", "rule_id", "action", "masked_evidence", "file", "line")


WATCHED = 300
WATCHED_SQL = f"""
w AS (SELECT unnest(regexp_extract_all(text, '[a-z]{{5,}}')) AS word FROM documents),
ranked AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS ro FROM w GROUP BY word QUALIFY ro < {WATCHED}),
rules AS (SELECT ro, word, 'watch-' || ro AS rule_id, CASE ro % 4 WHEN 0 THEN '\\b' || word || '\\b' WHEN 1 THEN '(?i)\\b' || word || '[a-z]*'
  WHEN 2 THEN word || '[.]' ELSE '(?:' || word || ',|' || word || '[.] )' END AS pattern FROM ranked)"""


def watch_rules(spark, sf):
    """One rule for each of the ``WATCHED`` most frequent words of the documents, in four shapes and six scopes."""
    words = views.documents(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0))).alias("word"))
    ranked = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(WATCHED).collect()
    out = []
    for i, word in enumerate(r.word for r in ranked):
        pattern = (rf"\b{word}\b", rf"(?i)\b{word}[a-z]*", rf"{word}\.", rf"(?:{word},|{word}\. )")[i % 4]
        scope = {"file_scope": ["/en/", "**/de/*.md$"]} if i % 3 == 0 else {}
        scope |= {"exclude_paths": ["^src1/"]} if i % 5 == 0 else {}
        out.append(rule(f"watch-{i}", "review", 2, pattern=pattern, **scope))
    return {"framework": "Data Compliance", "ruleset_version": 1, "ruleset_hash": "watch", "rules": out}


@query("watchlist_scan", f"""
WITH {sql.DOC_LINES}, {WATCHED_SQL.strip()},
hits AS (SELECT change_id, rule_id, len(regexp_extract_all(text, pattern)) AS n FROM lines JOIN rules ON contains(lower(text), word)
  WHERE (ro % 3 <> 0 OR contains(file, '/en/') OR contains(file, '/de/')) AND (ro % 5 <> 0 OR NOT starts_with(file, 'src1/')))
SELECT rule_id, sum(n)::BIGINT AS n_matches, count(DISTINCT change_id) AS n_changes FROM hits WHERE n > 0 GROUP BY rule_id""")
def watchlist_scan(spark, sf):
    """Three hundred rules over every line in one scan."""
    compiled = compile_rulesets(spark, [watch_rules(spark, sf)])
    hits = detect.line_hits(views.doc_lines(spark, sf, scopes(compiled)), compiled)
    # Per change first, so that a frequent word does not gather its changes.
    per_change = hits.groupBy("rule_ord", "change_id").agg(F.count("*").alias("n"))
    return per_change.groupBy("rule_ord").agg(F.sum("n").alias("n_matches"), F.count("*").alias("n_changes")).select(
        F.concat(F.lit("watch-"), F.col("rule_ord").cast("string")).alias("rule_id"), "n_matches", "n_changes")


@query("findings_dedup", f"""
WITH {CHANGES}
SELECT change_id, framework, finding_ord, rule_id, action, masked_evidence, file, line FROM findings""")
def findings_dedup(spark, sf):
    return change_scan(spark, sf).findings.select(
        "change_id", "framework", "finding_ord", "rule_id", "action", "masked_evidence", "file", "line")


@query("action_counts", f"""
WITH {CHANGES}
SELECT framework, rule_id, count_if(action = 'block')::BIGINT AS n_block, count_if(action = 'review')::BIGINT AS n_review,
       count_if(action = 'advise')::BIGINT AS n_advise FROM findings GROUP BY ALL""")
def action_counts(spark, sf):
    return fnd.action_counts(change_scan(spark, sf).findings, "framework", "rule_id")


def _raw_hits(spark, sf, *ids):
    """Hits before de-duplication, counted so that equal ones stay visible."""
    compiled = compile_rulesets(spark, _only(SOUND_RULESETS, *ids))
    lines = side_lines(diff_lines(views.changes(spark, sf)))
    hits = detect.line_hits(lines, compiled)
    return hits.groupBy("change_id", fnd.action_name(F.col("severity")).alias("action"), F.col("evidence").alias("masked_evidence")).agg(
        F.count("*").alias("hits"))


def _raw_sql(*ids):
    names = ", ".join(f"'{i}'" for i in ids)
    return f"""WITH {CHANGES} SELECT change_id, action, masked_evidence, count(*) AS hits FROM masked WHERE rule_id IN ({names}) GROUP BY ALL"""


@query("gated_matches", _raw_sql("gated-ip"))
def gated_matches(spark, sf):
    return _raw_hits(spark, sf, "gated-ip")


@query("signature_hits", _raw_sql("license"))
def signature_hits(spark, sf):
    return _raw_hits(spark, sf, "license")


@query("graded_hits", _raw_sql("secret"))
def graded_hits(spark, sf):
    return _raw_hits(spark, sf, "secret")


@query("validated_matches", _raw_sql("card"))
def validated_matches(spark, sf):
    return _raw_hits(spark, sf, "card")


@query("description_hits", r"""
WITH t AS (SELECT conv_id || '-' || turn AS change_id, text AS t FROM conversations),
m AS (SELECT change_id, unnest(regexp_extract_all(t, '(?i)\b(the|und|los)\b')) AS v FROM t WHERE NOT regexp_matches(t, '(?i)tion\b'))
SELECT change_id, 'review' AS action, replace('mention @ PR description', v, '***') AS masked_evidence, count(*) AS hits FROM m GROUP BY ALL""")
def description_hits(spark, sf):
    compiled = compile_rulesets(spark, _only(SOUND_RULESETS, "mentions"))
    hits = detect.description_hits(views.turns(spark, sf), compiled)
    return hits.groupBy("change_id", fnd.action_name(F.col("severity")).alias("action"), F.col("evidence").alias("masked_evidence")).agg(
        F.count("*").alias("hits"))


@query("paired_hits", f"""
WITH {CHANGES}
SELECT change_id, rule_id, action, masked_evidence, file, line FROM findings WHERE rule_id IN ('swapped', 'swapped-hunk')""")
def paired_hits(spark, sf):
    compiled = compile_rulesets(spark, _only(SOUND_RULESETS, "swapped", "swapped-hunk"))
    lines = side_lines(diff_lines(views.changes(spark, sf)))
    return fnd.findings(pairs.paired_hits(lines, compiled), compiled).select(
        "change_id", "rule_id", "action", "masked_evidence", "file", "line")


@query("context_graded", f"""
WITH {CHANGES} SELECT change_id, rule_id, action, masked_evidence FROM findings WHERE fw = 1""")
def context_graded(spark, sf):
    found = change_scan(spark, sf, SOUND_RULESETS[1:]).findings
    return found.select("change_id", "rule_id", "action", "masked_evidence")


SERVED = {"schema": 2, "rulesets": [{**d, "context": c, "context_hash": h * 64} for d, c, h in zip(
    SOUND_RULESETS, ({"quality": False}, {"quality": True, "toxic": False}), "ab", strict=True)]}


def served_scan(spark, sf):
    """Changes scanned with rulesets from one document, each framework with a context of its own."""
    document = views.table(spark, sf, "documents").limit(1).select(F.lit("served").alias("doc_id"), F.lit(json.dumps(SERVED)).alias("json"))
    return scan_changes(views.changes(spark, sf), compile_rulesets(spark, to_documents(load_rulesets(document))), scratch=shared_folder(spark, "lines"))


@query("framework_contexts", f"""
WITH {CHANGES} SELECT change_id, framework, rule_id,
  CASE WHEN rule_id IN ('eaa-ci-ai-endpoint', 'eaa-ci-ai-import') THEN 'advise' ELSE action END AS action, masked_evidence FROM findings""")
def framework_contexts(spark, sf):
    return served_scan(spark, sf).findings.select("change_id", "framework", "rule_id", "action", "masked_evidence")


@query("payload_contexts", r"""
SELECT doc_id AS change_id, 'Data Compliance' AS framework, '{"quality":false}' AS context, repeat('a', 64) AS context_hash FROM documents
UNION ALL SELECT doc_id, 'EU AI Act', '{"quality":true,"toxic":false}', repeat('b', 64) FROM documents""")
def payload_contexts(spark, sf):
    scan = served_scan(spark, sf).stored(shared_folder(spark, "scan"))
    changes = views.changes(spark, sf).select("change_id", "repo", "provider", "pr_number", "commit_sha")
    rows = reports.payloads(changes, scan.verdicts, scan.findings, reports.ruleset_contexts(scan.verdicts, scan.rulesets))
    body = F.try_variant_get(F.parse_json("payload"), "$.results", "array<variant>")
    result = rows.select("change_id", F.explode(body).alias("r"))
    return result.select("change_id", F.try_variant_get("r", "$.framework", "string").alias("framework"),
                         F.to_json(F.try_variant_get("r", "$.context", "variant")).alias("context"),
                         F.try_variant_get("r", "$.context_hash", "string").alias("context_hash"))


SUPPRESSED = r"""
sup AS (
  SELECT change_id, 'gated-ip' AS rule_id, 8 AS ro, count(*) AS n FROM sl
  WHERE side = 'added' AND NOT ex AND (regexp_matches(t, '(?i)\bder\b') OR NOT regexp_matches(t, '[aeiou]{3}')) GROUP BY ALL
  UNION ALL
  SELECT m.change_id, 'swapped-hunk', 11, count(*) FROM sl m JOIN sl p ON m.change_id = p.change_id AND m.file = p.file AND m.hunk_index = p.hunk_index
  WHERE m.side = 'removed' AND p.side = 'added' AND NOT m.ex AND regexp_matches(m.t, '\bthe\b') AND regexp_matches(p.t, '\bof\b.*\b(and|in)\b')
    AND NOT (regexp_matches(m.t, '[0-9]') OR regexp_matches(p.t, '[0-9]')) GROUP BY ALL
  UNION ALL
  SELECT change_id, 'mentions', 12, 1 FROM changes WHERE regexp_matches(description, '(?i)tion\b'))
"""


@query("suppression_counts", f"""
WITH {CHANGES}, {SUPPRESSED}
SELECT change_id, 'Rule "' || rule_id || '" suppressed ' || n || ' candidate line(s) via its exclude_pattern/require_pattern gating.' AS detail
FROM sup""")
def suppression_counts(spark, sf):
    return change_scan(spark, sf, once=True).warnings.where("code = 'suppressed'").select("change_id", "detail")


@query("verdicts", f"""
WITH {DOCS}, {sql.VERDICTS} SELECT change_id, framework, verdict, n_block, n_review, n_advise FROM verdicts""")
def verdicts(spark, sf):
    return document_scan(spark, sf).verdicts.select("change_id", "framework", "verdict", *COUNTS)


@query("floored_verdicts", f"""
WITH {CHANGES}, {sql.VERDICTS}
SELECT change_id, framework, verdict, incomplete FROM verdicts WHERE change_id % 9 <> 4
UNION ALL SELECT change_id, framework, 'needs_review', true FROM verdicts WHERE change_id % 9 = 4""")
def floored_verdicts(spark, sf):
    """Changes without a readable diff are never a silent pass."""
    compiled = compile_rulesets(spark, SOUND_RULESETS)
    changes = views.changes(spark, sf).join(views.contexts(spark, sf), "change_id", "left").withColumns({
        "context": context_booleans(F.col("registry"), compiled),
        "diff": F.when(F.col("change_id") % 9 != 4, F.col("diff"))}).drop("registry")
    return scan_changes(changes, compiled, scratch=shared_folder(spark, "lines")).verdicts.select("change_id", "framework", "verdict", "incomplete")


DIFF_CAP = 2000  # the cap itself is what truncated_verdicts shows


@query("truncated_verdicts", f"""
WITH {CHANGES}, {sql.VERDICTS}
SELECT v.change_id, framework, length(diff) > {DIFF_CAP} AS incomplete, CASE WHEN length(diff) > {DIFF_CAP} THEN 'not passed' ELSE verdict END AS outcome,
       CASE WHEN length(diff) > {DIFF_CAP} THEN 'Diff exceeded the configured size cap and was truncated; verdict floored to needs_review.' END AS detail
FROM verdicts v JOIN changes c USING (change_id)""")
def truncated_verdicts(spark, sf):
    """A diff longer than a named cap is flagged, and no change with one passes."""
    compiled = compile_rulesets(spark, SOUND_RULESETS)
    changes = cap_diffs(_with_context(views.changes(spark, sf), views.contexts(spark, sf), compiled), DIFF_CAP)
    rows = scan_changes(changes, compiled, scratch=shared_folder(spark, "lines")).verdicts
    cut = F.filter("warnings", lambda w: w["code"] == "truncated_diff")
    outcome = F.when(F.col("incomplete") & (F.col("verdict") != "pass"), "not passed").otherwise(F.col("verdict"))
    return rows.select("change_id", "framework", "incomplete", outcome.alias("outcome"), F.get(cut, F.lit(0))["detail"].alias("detail"))


@query("framework_verdicts", f"""
WITH {CHANGES}, {sql.VERDICTS}
SELECT framework, ruleset_version::BIGINT AS ruleset_version, ruleset_hash, verdict, count(*) AS changes FROM verdicts GROUP BY ALL""")
def framework_verdicts(spark, sf):
    return change_scan(spark, sf, once=True).verdicts.groupBy("framework", "ruleset_version", "ruleset_hash", "verdict").agg(
        F.count("*").alias("changes"))


@query("gate_decision", f"""
WITH {CHANGES}, {sql.VERDICTS}
SELECT change_id, framework, verdict, fw = 1 AS advisory, verdict = 'fail' AND fw = 0 AS step_failed,
  CASE WHEN verdict = 'pass' THEN 'success' WHEN verdict = 'fail' AND fw = 0 THEN 'failure' ELSE 'neutral' END AS conclusion,
  CASE WHEN verdict = 'fail' AND fw = 0 THEN framework || ' failed: ' || n_block || ' blocking finding(s).' END AS message FROM verdicts""")
def gate_decision(spark, sf):
    return ver.gate_decision(change_scan(spark, sf, once=True).verdicts).select(
        "change_id", "framework", "verdict", "advisory", "step_failed", "conclusion", "message")


@query("primary_outcome", f"""
WITH {CHANGES}, {sql.VERDICTS},
kept AS (SELECT * FROM verdicts WHERE fw = 1 OR change_id IN (SELECT doc_id FROM labels))
SELECT change_id, framework, verdict FROM (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY fw) AS k FROM kept) WHERE k = 1""")
def primary_outcome(spark, sf):
    """All verdicts of the second framework; the first one has judged only the changes that labels names."""
    verdicts = change_scan(spark, sf, once=True).verdicts
    judged = views.table(spark, sf, "labels").select(F.col("doc_id").alias("change_id"))
    rows = verdicts.where("fw_ord = 1").unionByName(verdicts.where("fw_ord <> 1").join(judged, "change_id", "left_semi"))
    return ver.primary_outcome(rows).select("change_id", "framework", "verdict")


@query("not_recorded", f"""
WITH {CHANGES}, {sql.VERDICTS}
SELECT change_id, framework, verdict FROM verdicts v
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = v.change_id AND (l.quality = 1 OR v.fw = 0))""")
def not_recorded(spark, sf):
    labels = views.table(spark, sf, "labels")
    stored = labels.select(F.col("doc_id").alias("change_id"), F.explode(F.when(
        F.col("quality") == 1, F.array(F.lit("Data Compliance"), F.lit("EU AI Act"))).otherwise(F.array(F.lit("Data Compliance")))).alias("framework"))
    submitted = change_scan(spark, sf, once=True).verdicts.select("change_id", "framework", "verdict")
    return ver.not_recorded(submitted, stored, "change_id", "framework")


@query("top_findings", f"""
WITH {CHANGES},
r AS (SELECT *, row_number() OVER (PARTITION BY change_id, framework ORDER BY CASE action WHEN 'block' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, finding_ord) AS k FROM findings)
SELECT change_id, framework, finding_ord, rule_id, action, k AS severity_pos FROM r WHERE k <= 3""")
def top_findings(spark, sf):
    top = fnd.top_by_severity(change_scan(spark, sf).findings, 3, "change_id", "framework")
    return top.select("change_id", "framework", "finding_ord", "rule_id", "action", F.col("severity_pos").cast("bigint").alias("severity_pos"))


WARNED = SUPPRESSED + r""",
long AS (SELECT change_id, file, min(pos) AS pos FROM sl WHERE length(text) > 8192 AND NOT ex GROUP BY ALL),
longs AS (SELECT change_id, count(*) AS n, '`' || arg_min(file, pos) || '`' AS first_file FROM long GROUP BY ALL),
notes AS (
  SELECT doc_id AS change_id, 0 AS fw, 1 AS o, 'tier1_gate' AS code, true AS floors,
    'Tier-1 rule(s) tier1-gated declare exclude_pattern/require_pattern; a tier-1 control cannot be gated, so those fields were IGNORED. Verdict floored to needs_review.' AS detail FROM documents
  UNION ALL SELECT doc_id, 1, 2, 'unusable_pattern', true, 'Rule "bad-pattern" declares pattern that could not be compiled; that part of the rule did not run. Verdict floored to needs_review.' FROM documents
  UNION ALL SELECT DISTINCT change_id, 1, 1, 'unreadable_applies_when', false, 'Rule "odd-context" declares an applies_when that cannot be read; its findings keep their declared action.' FROM hits WHERE rule_id = 'odd-context'
  UNION ALL SELECT doc_id, 1, 3, 'blanket_glob', true, '1 path glob(s) match EVERY path (`_`) and were REFUSED: as an exclusion they would suppress the whole rule, as a scope they would select nothing. Verdict floored to needs_review.' FROM documents
  UNION ALL SELECT change_id, f, 4, 'long_lines', false, n || ' file(s) contain lines longer than 8192 characters, the first is ' || first_file || '; they were scanned whole.' FROM longs, (VALUES (0), (1)) x(f)
  UNION ALL SELECT change_id, 0, ro, 'suppressed', false, 'Rule "' || rule_id || '" suppressed ' || n || ' candidate line(s) via its exclude_pattern/require_pattern gating.' FROM sup)
"""


@query("warnings", f"""
WITH {ALL_CHANGES}, {WARNED}
SELECT change_id, CASE fw WHEN 0 THEN 'Data Compliance' ELSE 'EU AI Act' END AS framework, code, floors, detail,
       row_number() OVER (PARTITION BY change_id, fw ORDER BY o) AS warning_ord FROM notes""")
def warnings(spark, sf):
    return change_scan(spark, sf, RULESETS, once=True).warnings.select(
        "change_id", "framework", "code", "floors", "detail", F.col("warning_ord").cast("bigint").alias("warning_ord"))


@query("backfill", f"""
WITH {CHANGES}, {sql.VERDICTS}
SELECT v.change_id, c.repo, c.pr_number, c.commit_sha, framework, ruleset_hash, verdict, n_block, n_review, n_advise, incomplete, false AS published
FROM verdicts v JOIN changes c USING (change_id)""")
def backfill(spark, sf):
    """Verdicts for the whole history of changes; nothing is published on old commits."""
    scan = change_scan(spark, sf, keep=("repo", "pr_number", "commit_sha"), once=True)
    return scan.verdicts.select("change_id", "repo", "pr_number", "commit_sha", "framework", "ruleset_hash", "verdict",
                                *COUNTS, "incomplete", F.lit(False).alias("published"))


@query("stream_scan", r"""
SELECT conv_id || '-' || turn AS change_id, CASE WHEN regexp_matches(text, '(?i)\b(the|und|los)\b') THEN 'needs_review' ELSE 'pass' END AS verdict,
       regexp_matches(text, '(?i)\b(the|und|los)\b')::BIGINT AS n_review FROM conversations""")
def stream_scan_query(spark, sf):
    """Conversation turns as a stream of changes, scanned batch by batch."""
    from ..streaming.changes import current, stream_scan
    folder = shared_folder(spark, "stream")
    rules = [{**d, "rules": [{**r, "detect": {**r["detect"], "exclude_pattern": None}} for r in d["rules"] if r["id"] == "mentions"]}
             for d in SOUND_RULESETS[:1]]
    schema = views.table(spark, sf, "conversations").schema
    turns = spark.readStream.schema(schema).parquet(f"{sf}/conversations.parquet*")
    changes = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("change_id"), F.col("conv_id").cast("string").alias("repo"), F.lit("github").alias("provider"),
        F.lit(1).alias("pr_number"), F.lit("c0ffee").alias("commit_sha"), F.lit("").alias("diff"), F.col("text").alias("description"))
    stream_scan(changes, compile_rulesets(spark, rules), folder, f"{folder}/checkpoint").awaitTermination()
    return current(spark, folder, "verdicts").select("change_id", "verdict", "n_review")


@query("stream_changes", f"""
WITH {CHANGES}, {sql.VERDICTS}
SELECT v.change_id, c.commit_sha, framework, ruleset_hash, verdict, n_block, n_review, n_advise, incomplete
FROM verdicts v JOIN changes c USING (change_id)""")
def stream_changes(spark, sf):
    """All changes with their diffs, each sent twice, as a stream under both rulesets and a registry of contexts."""
    from ..streaming.changes import current, stream_scan
    folder, compiled = shared_folder(spark, "stream"), compile_rulesets(spark, SOUND_RULESETS)
    schema = views.table(spark, sf, "documents").schema

    def sent():
        return views.as_changes(spark.readStream.schema(schema).parquet(f"{sf}/documents.parquet*"))

    changes = _with_context(sent().unionByName(sent()), views.contexts(spark, sf), compiled)
    stream_scan(changes, compiled, folder, f"{folder}/checkpoint").awaitTermination()
    return current(spark, folder, "verdicts").select("change_id", "commit_sha", "framework", "ruleset_hash", "verdict", *COUNTS, "incomplete")
