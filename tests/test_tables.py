"""Rulesets, inventories, reports, streaming and the registered queries."""
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from gatelake.catalog import ORACLES, QUERIES
from gatelake.operators import inventory as inv, reports, verdicts as ver
from gatelake.operators.rules import compile_rulesets
from gatelake.sources import rulesets as src, sinks, tree
from gatelake.streaming.changes import current, stream_scan

from helpers import diff, rule, ruleset, scan

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def make_tree(spark, files):
    rows = [("r", "c", p, None if b is None else len(b), b) for p, b in files]
    return spark.createDataFrame(rows, "repo string, commit_sha string, path string, length bigint, content binary").withColumn(
        "content", F.col("content"))


ENDPOINT = rule("eaa-ci-ai-endpoint", pattern=r"api\.(openai|anthropic)\.com", baseline=True)


def inventory(spark, files, *rules, **kw):
    compiled = compile_rulesets(spark, [ruleset(*rules, framework="EU AI Act")])[0]
    chosen = inv.baseline_rules(compiled)
    scoped = inv.scoped_files(make_tree(spark, files), chosen)
    opened = inv.opened_files(scoped, kw.get("cap"))
    rows = inv.observations(inv.matching_lines(opened, chosen, kw.get("max_bytes")), sample_paths=kw.get("paths", 3)).collect()
    stats = inv.run_stats(scoped, opened, chosen, kw.get("max_bytes")).collect()
    return {(r.rule_id, r.signature_key): (r["count"], r.sample_paths) for r in rows}, stats[0] if stats else None


def test_inventory_counts_lines_per_family(spark):
    files = [("a.ts", b"api.openai.com api.openai.com\nnothing\napi.openai.com"), ("b.ts", b"api.anthropic.com api.openai.com\r\n\xff"),
             ("dist/c.ts", b"api.openai.com"), ("bin", b"\x00api.openai.com"), ("big", b"api.openai.com" + b"x" * 524288),
             ("edge", b"api.openai.com".ljust(524288, b" ")), ("link", None)]
    rows, stats = inventory(spark, files, ENDPOINT, rule("other", pattern="x", baseline=True), max_bytes=524288)
    key = "eaa-ci-ai-endpoint"
    assert rows == {(key, "anthropic"): (1, ["b.ts"]), (key, "openai"): (4, ["a.ts", "b.ts", "edge"])}
    assert (stats.listed, stats.out_of_scope, stats.skipped_binary, stats.skipped_size, stats.skipped_unreadable, stats.files_scanned,
            stats.long_lines, stats.truncated) == (7, 1, 1, 1, 1, 3, 1, False)


def test_inventory_is_whole(spark):
    """No file, size, line, row, count or path limit unless the caller names one."""
    text = [(f"f{i:05}.ts", b"api.openai.com") for i in range(5200)] + [("big.ts", b"x" * 700_000 + b"\napi.anthropic.com"),
                                                                      ("long.ts", b"y" * 9000 + b" api.openai.com"), ("p/" * 200 + "q.ts", b"api.openai.com")]
    rows, stats = inventory(spark, text, ENDPOINT, paths=6000)
    key = "eaa-ci-ai-endpoint"
    assert rows[key, "openai"][0] == 5202 and len(rows[key, "openai"][1]) == 5202 and rows[key, "anthropic"] == (1, ["big.ts"])
    assert (stats.files_scanned, stats.skipped_size, stats.truncated) == (5203, 0, False)


def test_inventory_completeness(spark):
    text = [(f"f{i}.ts", b"api.openai.com") for i in range(4)]
    assert inventory(spark, text, ENDPOINT, cap=3)[1].truncated
    assert inventory(spark, text, ENDPOINT, cap=3)[0] == {("eaa-ci-ai-endpoint", "openai"): (3, ["f0.ts", "f1.ts", "f2.ts"])}
    assert not inventory(spark, text, ENDPOINT, cap=4)[1].truncated
    assert inventory(spark, text, {**ENDPOINT, "detect": {**ENDPOINT["detect"], "pattern": "("}}, ENDPOINT)[1].truncated
    assert inventory(spark, [("a.ts", None)], ENDPOINT)[1].truncated
    assert not inventory(spark, [("a.ts", b"\x00")], ENDPOINT)[1].truncated
    refused = {**ENDPOINT, "detect": {**ENDPOINT["detect"], "file_scope": ["*", ".ts"]}}
    assert inventory(spark, text, refused)[1].truncated


@pytest.mark.parametrize("cap", [None, 2])
def test_run_summary_is_the_same_in_one_pass(spark, cap):
    files = [("a.ts", b"api.openai.com api.openai.com\nnothing\napi.openai.com"), ("b.ts", b"api.anthropic.com api.openai.com\r\n\xff"),
             ("dist/c.ts", b"api.openai.com"), ("bin", b"\x00api.openai.com"), ("empty", b""), ("long", b"y" * 9000 + b"\n" + b"z" * 9000),
             ("only.big", b"api.openai.com" + b"x" * 20000), ("link", None)]
    rules = [ENDPOINT, rule("eaa-ci-ai-import", pattern="import", baseline=True, file_scope=[".big$"]), rule("eaa-ci-emotion-biometric", pattern="no", baseline=True)]
    rows, stats = inventory(spark, files, *rules, cap=cap, max_bytes=19000)
    chosen = inv.baseline_rules(compile_rulesets(spark, [ruleset(*rules, framework="EU AI Act")])[0])
    scoped = inv.scoped_files(make_tree(spark, files), chosen)
    got = inv.run_summary(scoped, inv.opened_files(scoped, cap), chosen, 19000).collect()[0].asDict()
    assert [(o.rule_id, o.signature_key, o["count"]) for o in got.pop("observations")] == sorted((*k, n) for k, (n, _) in rows.items())
    assert got.pop("reasons") == (["unread_scope"] if cap is None else ["file_cap"])
    assert got == stats.asDict()


def test_run_summary_without_files_or_rules(spark):
    none = make_tree(spark, [])
    chosen = inv.baseline_rules(compile_rulesets(spark, [ruleset(ENDPOINT, framework="EU AI Act")])[0])
    assert inv.run_summary(inv.scoped_files(none, chosen), inv.opened_files(inv.scoped_files(none, chosen)), chosen).collect() == []
    tree_ = inv.scoped_files(make_tree(spark, [("a.ts", b"x"), ("a.ts", b"x")]), [])
    row = inv.run_summary(tree_, inv.opened_files(tree_), []).collect()[0]
    assert (row.listed, row.out_of_scope, row.files_scanned, row.reasons, row.observations) == (2, 2, 0, [], [])


def test_tree_reader(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_bytes(b"\xef\xbb\xbfone\r\ntwo")
    (tmp_path / "big.ts").write_bytes(b"x" * 600_000)
    files = tree.read_tree(spark, str(tmp_path), "r", max_bytes=524288)
    rows = tree.tree_lines(files, 524288).orderBy("path", "pos").collect()
    assert [(r.path, r.text) for r in rows] == [("src/a.ts", "one"), ("src/a.ts", "two")]
    assert tree.tree_lines(tree.read_tree(spark, str(tmp_path), "r")).count() == 3
    # A rule whose only file is too large to be read was not run, whichever reader listed the file.
    chosen = inv.baseline_rules(compile_rulesets(spark, [ruleset({**ENDPOINT, "detect": {**ENDPOINT["detect"], "file_scope": ["^big"]}})])[0])
    for listed in (files, tree.list_tree(spark, str(tmp_path), "r")):
        scoped = inv.scoped_files(listed, chosen)
        stats = inv.run_stats(scoped, inv.opened_files(scoped), chosen, 524288).collect()[0]
        assert (stats.skipped_size, stats.truncated) == (1, True)


def test_rulesets_to_scan(spark):
    body = json.dumps({"schema": 2, "rulesets": [{"framework": "EU AI Act", "ruleset_version": 2, "ruleset_hash": "h", "rules": [rule("a", pattern="hit")]},
                                                 {"framework": "Unknown", "rules": 1}]})
    docs = spark.createDataFrame([("d", body)], "doc_id string, json string")
    loaded = src.load_rulesets(docs)
    assert [(r.framework, r.rule_ord, r.rule.id) for r in src.explode_rules(loaded).collect()] == [("EU AI Act", 0, "a")]
    s = scan(spark, [diff(["hit"])], *src.to_documents(loaded))
    assert [f.framework for f in s.findings.collect()] == ["EU AI Act"]


def test_rejected_context_is_reported(spark):
    body = json.dumps({"schema": 2, "rulesets": [{"framework": "EU AI Act", "ruleset_version": 2, "ruleset_hash": "h", "rules": [rule("a", pattern="hit")],
                                                 "context": {"x": True}, "context_hash": "short"}]})
    loaded = src.load_rulesets(spark.createDataFrame([("d", body)], "doc_id string, json string"))
    s = scan(spark, [diff(["hit"])], *src.to_documents(loaded))
    assert [(w.code, w.floors) for w in s.warnings.collect()] == [("context_rejected", False)]


def test_gate_and_degraded(spark):
    rules = compile_rulesets(spark, [ruleset(rule("a", "block", pattern="hit")), ruleset(rule("b", "block", pattern="hit"), framework="EU AI Act")])
    s = scan(spark, [diff(["hit"])], ruleset(rule("a", "block", pattern="hit")), ruleset(rule("b", "block", pattern="hit"), framework="EU AI Act"))
    rows = ver.gate_decision(s.verdicts).orderBy("fw_ord").collect()
    assert [(r.conclusion, r.step_failed, r.message) for r in rows] == [
        ("failure", True, "Data Compliance failed: 1 blocking finding(s)."), ("neutral", False, None)]
    changes = spark.createDataFrame([("x",)], "change_id string")
    assert [r.verdict for r in ver.degraded(changes, rules, "no access").collect()] == ["needs_review"] * 2
    assert ver.degraded(changes, [], "outage").collect()[0].warnings[0].detail == "Ruleset unavailable: outage"


def many(spark, n):
    body = diff([f"low {i}" for i in range(n)] + ["high"])
    return scan(spark, [body], ruleset(rule("low", "advise", pattern="low"), rule("high", "block", pattern="high")))


def test_export_keeps_the_most_severe(spark):
    s = many(spark, 230)
    assert reports.export_findings(s.findings).count() == reports.code_quality(s.findings).count() == 231
    rows = reports.export_findings(s.findings, 200).orderBy("export_ord").collect()
    assert len(rows) == 200 and rows[0].rule_id == "high"
    few = reports.export_findings(many(spark, 3).findings, 200).orderBy("export_ord").collect()
    assert [r.rule_id for r in few] == ["low", "low", "low", "high"]


def test_markdown_limits(spark):
    s = many(spark, 230)
    assert reports.notes(s.verdicts, s.findings).collect()[0].note.count("| advise |") == 230
    assert reports.summaries(s.verdicts, s.findings).collect()[0].summary.count("| advise |") == 230
    summary = reports.summaries(s.verdicts, s.findings, limit=100).collect()[0].summary
    assert summary.startswith("**Verdict: fail** — 1 blocking, 0 need review, 230 advisory.") and "_…and 131 more findings" in summary
    note = reports.notes(s.verdicts, s.findings, limit=25).collect()[0].note
    assert note.count("| advise |") == 24 and "…and 206 more finding(s)." in note


def test_code_quality_report(spark, tmp_path):
    s = scan(spark, [diff(["hit"]), diff(["none"])], ruleset(rule("a", pattern="hit")))
    issues = reports.code_quality(s.findings)
    out = {r.change_id: r.report for r in reports.code_quality_json(s.verdicts.select("change_id"), issues).collect()}
    assert out["1"] == "[]\n" and json.loads(out["0"])[0]["location"] == {"path": "src/a.ts", "lines": {"begin": 2}}
    sinks.write_issues(issues, str(tmp_path / "issues"))
    sinks.write_table(s.findings, str(tmp_path / "findings"))
    assert spark.read.parquet(str(tmp_path / "findings")).count() == 1


def test_stream(spark, tmp_path):
    rows = [(str(i), "r", "github", 1, "c", diff(["hit"] if i % 2 else ["x"]), "") for i in range(6)]
    schema = "change_id string, repo string, provider string, pr_number int, commit_sha string, diff string, description string"
    # The second file sends a change again, unchanged and at another commit.
    parts = [rows[:3], rows[3:] + [rows[1], (*rows[1][:4], "d", diff(["x"]), "")]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rules = compile_rulesets(spark, [ruleset(rule("a", "block", pattern="hit"))])
    stream_scan(stream, rules, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.change_id, r.commit_sha, r.verdict) for r in current(spark, str(tmp_path / "out"), "verdicts").collect())
    assert got == sorted([(str(i), "c", "fail" if i % 2 else "pass") for i in range(6)] + [("1", "d", "pass")])
    assert sorted((r.change_id, r.commit_sha) for r in current(spark, str(tmp_path / "out"), "findings").collect()) == [(str(i), "c") for i in (1, 3, 5)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr([row[names.index(c)] for c in columns]) for row in result.fetchall())
