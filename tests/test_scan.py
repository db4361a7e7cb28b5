import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from gatelake.operators import detect
from gatelake.operators.diff import diff_lines
from gatelake.operators.findings import findings as findings_of
from gatelake.operators.rules import compile_rulesets, scopes
from gatelake.sources.text import text_lines
from gatelake.plans.scan import scan_changes, scan_lines

from helpers import changes, diff, findings, rendered, rule, ruleset, scan

IBAN = rule("iban", "block", 1, method="checksum", validator=["iban"], allowlist="synthetic")
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def verdicts(s):
    return [(r.change_id, r.framework, r.verdict) for r in s.verdicts.orderBy("change_id", "fw_ord").collect()]


def codes(s):
    return [(r.change_id, r.code) for r in s.warnings.orderBy("change_id", "fw_ord", "warning_ord").collect()]


def random_files(rng):
    paths = ["x.ts", "d/y.ts", "d/e/z.md"]
    files = []
    for _ in range(rng.randint(1, 3)):
        old, new = rng.choice(paths), rng.choice(paths)
        preamble = [p for p in ("index 1..2 100644", "similarity index 90%", f"rename from {old}", f"rename to {new}", "old mode 1", "new mode 2")
                    if rng.random() < 0.3]
        hunks = []
        for _ in range(rng.randint(0, 3)):
            lines = [(rng.choice(["added", "removed", "context"]), rng.choice(["new", "", " ctx", "a\r", "é \t", "odd @@"])) for _ in range(rng.randint(1, 8))]
            lines += [(None, "No newline at end of file")] if rng.random() < 0.3 else []
            hunks.append((rng.randint(1, 90), rng.randint(1, 90), lines))
        files.append((old, None if hunks and rng.random() < 0.2 else new, preamble, hunks))
    return files


@pytest.mark.parametrize("chunk", [4096, 1, 5])
def test_diffs_give_back_their_line_tables(spark, monkeypatch, chunk):
    monkeypatch.setattr("gatelake.operators.diff.CHUNK", chunk)
    rng = random.Random(1)
    made = [rendered(random_files(rng)) for _ in range(300 if chunk > 1 else 60)]
    rows = {}
    for r in diff_lines(changes(spark, [(t, "") for t, _ in made])).collect():
        rows.setdefault(int(r.change_id), []).append((r.pos, r.side, r.file, r.line_no, r.text, r.hunk_index))
    for i, (text, table) in enumerate(made):
        assert sorted(rows.get(i, [])) == sorted(table), text


def test_one_long_change_is_read_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr("gatelake.operators.diff.CHUNK", 64)
    body = "\n".join(f"diff --git a/f{n} b/f{n}\n--- a/f{n}\n+++ b/f{n}\n@@ -1,9 +1,99 @@\n" + "\n".join(f"+x{i}" for i in range(99)) for n in range(40))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = diff_lines(spark.createDataFrame([(None, body), ("b", None)], "change_id string, diff string")).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.task for r in rows}) > 1 and len(rows) == 40 * 99
    assert sorted((r.file, r.line_no, r.hunk_index, r.text) for r in rows) == sorted((f"f{n}", i + 1, 0, f"x{i}") for n in range(40) for i in range(99))


@pytest.mark.parametrize("text,hits", [
    ("Wire to DE12500105170648489890 for the payout.", 1), ("Please pay GB82 WEST 1234 5698 7654 32 by Friday.", 1),
    ("Please pay AT61-1904-3002-3457-3201 by Friday.", 1), ('const account = "LB3812-3-4ABCDEFGHIJKLMNOPQRST";', 1),
    ("Bump 1904 to 3000 and 2011 to 1234 in the config.", 0), ("plain prose without any number", 0),
])
def test_iban_in_prose(spark, text, hits):
    assert len(findings(spark, [diff([text])], ruleset(IBAN))) == hits


def test_allowlisted_identifier_in_a_sentence(spark):
    doc = ruleset(IBAN, allowlist={"ibans": ["GB82WEST12345698765432"]})
    assert findings(spark, [diff(["Please pay GB82 WEST 1234 5698 7654 32 by Friday.", "GB82 WEST 1234 5698 7654 32"])], doc) == []


def test_verdicts_and_floors(spark):
    rows = [diff(["const x = 1;"]), diff(["a@corp.io"]), diff(["x" * 9000]), None, (diff(["ok"]), "d" * 9000)]
    doc = ruleset(rule("mail", pattern=MAIL), rule("gpt", target="pr_description", pattern="uses GPT"))
    s = scan(spark, rows, doc)
    assert [v for _, _, v in verdicts(s)] == ["pass", "needs_review", "pass", "needs_review", "pass"]
    assert codes(s) == [("2", "long_lines"), ("3", "no_diff")]


def test_long_texts_are_scanned_whole(spark):
    doc = ruleset(rule("mail", "block", pattern=MAIL), rule("gpt", target="pr_description", pattern="uses GPT"),
                  rule("c", "block", method="checksum", validator=["credit_card"]),
                  rule("p", "block", paired={"minus": "was on", "plus": "now off", "window": "same_hunk"}))
    far = "x " * 9000
    rows = [diff([far + "a@corp.io"]), (diff(["ok"]), far + "uses GPT"), diff([far + "4111 1111 1111 1111"]), diff([far + "now off"], [far + "was on"])]
    assert [(c, r) for c, r, _, _ in findings(spark, rows, doc)] == [("0", "mail"), ("1", "gpt"), ("2", "c"), ("3", "p")]


def test_long_diffs_are_scanned_whole(spark):
    body = "\n".join([diff(["y" * 4000] * 1300), diff(["a@corp.io"], path="z.ts")])
    assert len(body) > 5_000_000
    assert [r for _, r, _, _ in findings(spark, [body], ruleset(rule("mail", pattern=MAIL)))] == ["mail"]


def test_paths_alike_at_first_stay_apart(spark):
    long = "d/" * 150
    texts = ["\n".join(diff(["hit"], path=f"{long}{n}.ts") for n in "ab")]
    assert [e for *_, e in findings(spark, texts, ruleset(rule("m", pattern="hit")))] == [f"m @ {long}{n}.ts:2" for n in "ab"]


def test_many_rules_read_the_lines_once(spark, tmp_path):
    spark.createDataFrame([(i, f"word{i}") for i in range(100)], "id int, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    rules = compile_rulesets(spark, [ruleset(*[rule(f"r{i}", pattern=f"word{i}\\b") for i in range(100)])])
    s = scan_lines(text_lines(docs, "id", "text", F.lit("f")), rules, docs.select(F.col("id").alias("change_id")))
    plan = s.hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert s.findings.count() == 100


def test_rules_that_cannot_be_read_are_named(spark):
    doc = ruleset(rule("odd", "explode", pattern="hit"), {"action": "block", "detect": {"pattern": "hit"}}, "text", 7, rule("num", pattern=5),
                  rule("val", "block", 1, method="checksum", validator="iban"), rule("fine", "block", pattern="hit"),
                  rule("globs", pattern="hit", file_scope="src/"), rule("pair", paired=["x"]))
    s = scan(spark, [diff(["hit"])], doc)
    assert [f.rule_id for f in s.findings.orderBy("finding_ord").collect()] == ["fine", "globs"]
    assert [c for _, c in codes(s)] == ["rule_failed"] * 6
    assert [r.detail.split('"')[1] for r in s.warnings.orderBy("warning_ord").collect()] == ["odd", "unknown", "unknown", "unknown", "num", "pair"]
    assert s.verdicts.collect()[0].verdict == "fail"


def test_nothing_to_scan_is_no_silent_pass(spark):
    s = scan(spark, [diff(["hit"]), None])
    assert verdicts(s) == [("0", "Data Compliance", "needs_review"), ("1", "Data Compliance", "needs_review")]
    assert s.findings.count() == 0 and {c for _, c in codes(s)} == {"no_ruleset"}
    docs = spark.createDataFrame([(1, None), (2, "ok")], "id int, text string")
    rules = compile_rulesets(spark, [ruleset(rule("m", pattern="hit"))])
    s = scan_lines(text_lines(docs, "id", "text", F.lit("f")), rules, docs.select(F.col("id").alias("change_id"), F.col("text").isNull().alias("unreadable")))
    assert [(r.change_id, r.verdict, r.incomplete) for r in s.verdicts.orderBy("change_id").collect()] == [(1, "needs_review", True), (2, "pass", False)]


def test_context_of_a_checksum_rule(spark):
    weak = rule("weak", "block", 1, method="checksum", validator=["svnr"], require_context="svnr")
    plain = rule("word", "block", 2, pattern="secret", require_context="here")
    got = findings(spark, [diff(["svnr 1237010180", "id 1237010180", "secret here", "secret"])], ruleset(weak, plain))
    assert [(r, a) for _, r, a, _ in got] == [("weak", "block"), ("weak", "review"), ("word", "block"), ("word", "review")]


def test_timestamps_are_not_identifiers(spark):
    def valid(date, hour):
        d = [int(c) for c in (date.replace("-", "") + hour)]
        total = sum(a * b for a, b in zip(d, (3, 7, 9, 0, 5, 8, 4, 2, 1, 6)))
        return total % 11 == d[3] and 1 <= d[4] * 10 + d[5] <= 28 and 1 <= d[6] * 10 + d[7] <= 12

    stamps = [(f"{y}-{m:02}-{d:02}", f"{h:02}") for y in range(1980, 2030) for m in range(1, 13) for d in range(1, 13) for h in range(24)]
    date, hour = next(s for s in stamps if valid(*s))
    rows = [diff([f"{date}T{hour}:00:00Z"]), diff([f"{date} {hour}:00:00"]), diff([f"{date}-{hour}"]), diff([f"id {date} {hour} end"])]
    doc = ruleset(rule("svnr", "block", 1, method="checksum", validator=["svnr"]))
    assert [c for c, *_ in findings(spark, rows, doc)] == ["2", "3"]


def test_gates(spark):
    ok = diff(["ok ok", "ok", "ok x", "y"])
    stateful = ruleset(rule("a", pattern="o", exclude_pattern="(?gi)OK"))
    assert findings(spark, [ok], stateful) == []
    s = scan(spark, [ok], ruleset(rule("a", pattern="x|y", require_pattern="y")))
    assert s.findings.count() == 1
    assert s.warnings.collect()[0].detail == 'Rule "a" suppressed 3 candidate line(s) via its exclude_pattern/require_pattern gating.'
    tier1 = scan(spark, [ok], ruleset(rule("a", "block", 1, pattern="ok", exclude_pattern=".")))
    assert tier1.verdicts.collect()[0].verdict == "fail" and codes(tier1) == [("0", "tier1_gate")]


def test_unusable_rules_floor_and_others_go_on(spark):
    doc = ruleset(rule("bad", pattern="(?x)foo"), rule("worse", pattern="(", exclude_pattern="["), {"id": "broken"}, rule("fine", "advise", 3, pattern="hit"),
                  rule("scope", pattern="hit", file_scope=["*"]))
    s = scan(spark, [diff(["hit"])], doc)
    assert [f.rule_id for f in s.findings.collect()] == ["fine"]
    assert [c for _, c in codes(s)] == ["unusable_pattern", "unusable_pattern", "rule_failed", "blanket_glob"]
    assert s.verdicts.collect()[0].verdict == "needs_review"


def test_signature_tokens_are_starred(spark):
    doc = ruleset(rule("sdk", method="signature", signature="sdks", file_scope=["package.json"]), rule("lone", method="signature", signature="ctx"),
                  signatures={"sdks": ["mixpanel", "segment"]})
    got = findings(spark, [diff(['"segment": 1, "mixpanel": 2', "none"], path="package.json")], doc)
    assert got == [("0", "sdk", "review", "sdk:*** @ package.json:2")]


def test_locations(spark):
    doc = ruleset(rule("m", diff_side="either", pattern="hit"), rule("d", target="pr_description", pattern="hit"))
    rows = scan(spark, [(diff(["hit"], ["hit"]), "hit hit")], doc).findings.orderBy("finding_ord").collect()
    assert [(r.masked_evidence, r.file, r.line) for r in rows] == [
        ("m @ src/a.ts:2", "src/a.ts", 2), ("d @ PR description", None, None)]
    removed_only = scan(spark, [diff([], ["hit"])], doc).findings.collect()
    assert [(r.masked_evidence, r.line) for r in removed_only] == [("m @ src/a.ts:2", None)]


def test_context_lowers_only(spark):
    spec = [{"when": {"repo_linked": True}, "action": "advise"}]
    doc = ruleset(rule("a", pattern="hit", applies_when=spec), rule("b", "advise", pattern="hit", applies_when=[{"when": {"repo_linked": True}, "action": "review"}]),
                  framework="EU AI Act")
    for context, expected in (({"repo_linked": True}, ["advise", "advise"]), ({"repo_linked": False}, ["review", "advise"]), ({"other": True}, ["review", "advise"])):
        assert [a for _, _, a, _ in findings(spark, [diff(["hit"])], doc, context=context)] == expected


def test_each_framework_grades_by_its_own_context(spark):
    spec = [{"when": {"linked": True}, "action": "advise"}]
    docs = [ruleset(rule("a", "block", pattern="hit", applies_when=spec), framework=f, context=c) for f, c in (
        ("Data Compliance", {"linked": False}), ("EU AI Act", {"linked": True}))]
    assert [a for _, _, a, _ in findings(spark, [diff(["hit"])], *docs)] == ["block", "advise"]
    rows = changes(spark, [(diff(["hit"]), "")]).withColumn("context", F.expr("map('EU AI Act', map('linked', true), 'Data Compliance', map('linked', false))"))
    plain = compile_rulesets(spark, [{k: v for k, v in d.items() if k != "context"} for d in docs])
    assert [r.action for r in scan_changes(rows, plain).findings.orderBy("fw_ord").collect()] == ["block", "advise"]


def test_frameworks_are_independent(spark):
    one, two = ruleset(rule("a", "block", pattern="hit")), ruleset(rule("a", "advise", pattern="hit"), framework="EU AI Act")
    rows = [diff(["hit"]), diff(["none"])]
    both = verdicts(scan(spark, rows, one, two))
    assert both == sorted(verdicts(scan(spark, rows, one)) + verdicts(scan(spark, rows, two)))


def brute_pairs(tables, minus, plus, window, require):
    import re
    out = set()
    for i, rows in enumerate(tables):
        seen, lines = set(), []
        for m in (r for r in rows if r[1] == "removed"):
            for p in (r for r in rows if r[1] == "added" and r[2] == m[2]):
                same = m[5] == p[5]
                if window == "same_hunk" and not same:
                    continue
                if not re.search(minus, m[4]) or not re.search(plus, p[4]):
                    continue
                if require and not (re.search(require, m[4]) or re.search(require, p[4])):
                    continue
                if (m[2], m[3], p[3]) in seen:
                    continue
                seen.add((m[2], m[3], p[3]))
                ev = f"lab ({'same' if same else 'cross'}-hunk) @ {p[2]}:{p[3]}"
                raw = m[4].strip()
                lines.append((ev.replace(raw, "***") if raw else ev, "block" if same else "review"))
        for ev, action in dict(reversed(lines)).items():
            out.add((str(i), action, ev))
    return out


@pytest.mark.parametrize("window", ["same_hunk", "same_file"])
@pytest.mark.parametrize("require", [None, "^n", "z|5"])
def test_pairs_match_brute_force(spark, window, require):
    rng = random.Random(7)
    words = ["old", "n old", "new", "n new", "z", "12", "1", "5", "lab", "hunk", "f.ts:1", "none", "t", "same-hunk", "s:", "ts:2", "2", "3", "21", "9" * 30]

    def hunk(start):
        return start, start + 2, [(rng.choice(["added", "removed", "added", "removed", "context"]), rng.choice(words)) for _ in range(rng.randint(2, 8))]

    made = [rendered([(name, name, [], [hunk(10 * k + 1) for k in range(rng.randint(1, 4))]) for name in ("f.ts", "g.ts", "f.ts")[:rng.randint(2, 3)]]) for _ in range(80)]
    texts = [text for text, _ in made]
    doc = ruleset(rule("p", "block", mask="lab", paired={"minus": "[a-z0-9]", "plus": "new|1|z", "window": window},
                       **({"require_pattern": require} if require else {})))
    got = {(c, a, e) for c, _, a, e in findings(spark, texts, doc)}
    assert got == brute_pairs([table for _, table in made], "[a-z0-9]", "new|1|z", window, require)


def test_partners_grow_with_the_lines(spark):
    """Removed numbers against added lines: a few partners for each line, not one for each pair."""
    from gatelake.operators.diff import side_lines
    from gatelake.operators.pairs import paired_partners
    rules = compile_rulesets(spark, [ruleset(rule("p", "block", mask="lab", paired={"minus": "[0-9]", "plus": "b", "window": "same_file"}))])
    sizes = []
    for n in (50, 200):
        text, _ = rendered([("f.ts", "f.ts", [], [(1, 1, [("removed", str(i)) for i in range(1000, 1000 + n)]), (500, 500, [("added", "b")] * n)])])
        sizes.append(paired_partners(side_lines(diff_lines(changes(spark, [(text, "")]))), rules).count())
    assert sizes == [50, 200]


@pytest.mark.parametrize("n", [40, 400])
def test_removed_numbers_match_brute_force(spark, n):
    """Many distinct numbers, of which a few lie in each line's own number; first partners keep their order."""
    rng = random.Random(n)
    hunks = [(100 * k + 1, 100 * k + 1, [(rng.choice(["removed", "added"]), str(rng.randint(0, n))) for _ in range(12)]) for k in range(8)]
    text, table = rendered([("f.ts", "f.ts", [], hunks), ("g.ts", "g.ts", [], hunks[3:]), ("f.ts", "f.ts", [], hunks[:3])])
    doc = ruleset(rule("p", "block", mask="lab", paired={"minus": "[0-9]", "plus": "[0-9]", "window": "same_file"}))
    rows = scan(spark, [text], doc).findings.orderBy("finding_ord").collect()
    assert [(r.action, r.masked_evidence) for r in rows] == ordered_pairs(table)


def ordered_pairs(rows):
    """(action, evidence) of all pairs of one change, by their first removed and then added line."""
    out, seen = {}, set()
    for m in (r for r in rows if r[1] == "removed"):
        for p in (r for r in rows if r[1] == "added" and r[2] == m[2]):
            if (m[2], m[3], p[3]) not in seen:
                seen.add((m[2], m[3], p[3]))
                same = m[5] == p[5]
                ev = f"lab ({'same' if same else 'cross'}-hunk) @ {p[2]}:{p[3]}".replace(m[4].strip(), "***")
                out.setdefault(ev, "block" if same else "review")
    return [(action, ev) for ev, action in out.items()]


def test_long_removed_texts_are_starred(spark):
    """A removed text of any length that is part of the path shows in no evidence."""
    path = "/".join(["part" * 5] * 40) + "/f.ts"
    raw = path[7:-3]
    rows = findings(spark, [diff(["now off"], [raw], path=path)], ruleset(rule("p", "block", mask="lab", paired={"minus": "part", "plus": "off", "window": "same_file"})))
    assert len(raw) > 600 and [raw in e for *_, e in rows] == [False] and "***" in list(rows)[0][3]


def test_many_pairs_are_all_compared(spark):
    """Where every pair was compared nothing is floored, however many there are."""
    body = "\n".join(["diff --git a/f b/f", "@@ -1,500 +1,500 @@"] + ["-a"] * 500 + ["+b"] * 450)
    s = scan(spark, [body, diff(["b"], ["a"])], ruleset(rule("p", "block", paired={"minus": "zz", "plus": "b", "window": "same_hunk"})))
    assert codes(s) == [] and [v for _, _, v in verdicts(s)] == ["pass", "pass"]


def test_long_files_are_counted(spark):
    text = "\n".join(diff(["x" * 9000], path=f"src/f{i}.ts") for i in range(7))
    s = scan(spark, [text], ruleset(rule("m", pattern="hit")))
    assert [(r.floors, r.detail) for r in s.warnings.collect()] == [
        (False, "7 file(s) contain lines longer than 8192 characters, the first is `src/f0.ts`; they were scanned whole.")]


def test_raw_values_never_leave(spark):
    secret = "jane.doe@acme.co.uk"
    s = scan(spark, [(diff([secret, "4111 1111 1111 1111"], [secret]), secret)],
             ruleset(rule("m", diff_side="either", pattern=MAIL, mask=f"mail {secret}"), rule("c", "block", method="checksum", validator=["credit_card"]),
                     rule("d", target="pr_description", pattern=MAIL)))
    text = str(s.findings.drop("file").collect()) + str(s.verdicts.collect())
    assert s.findings.count() >= 3
    assert secret not in text and "4111 1111" not in text


def test_result_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"a{i}@corp.io\n4111 1111 1111 1111\nx") for i in range(40)], "id int, text string")
    rules = compile_rulesets(spark, [ruleset(rule("m", pattern=MAIL), rule("c", "block", method="checksum", validator=["credit_card"]))])
    outcomes = []
    for n in (1, 5):
        part = docs.repartition(n)
        lines = text_lines(part, "id", "text", F.concat(F.lit("f"), F.col("id").cast("string")))
        s = scan_lines(lines, rules, docs.select(F.col("id").alias("change_id")))
        outcomes.append(sorted(map(str, s.findings.collect())))
    assert outcomes[0] == outcomes[1] and len(outcomes[0]) == 80


def test_one_change_with_most_lines(spark):
    """A skewed change gives the same findings as the plain count."""
    big = "\n".join([diff()] + [f"+a{i}@corp.io" for i in range(3000)])
    found = findings_of(scan(spark, [big, diff(["b@corp.io"])], ruleset(rule("m", pattern=MAIL))).hits,
                        compile_rulesets(spark, [ruleset(rule("m", pattern=MAIL))]))
    assert {r["change_id"]: r["count"] for r in found.groupBy("change_id").count().collect()} == {"0": 3000, "1": 1}


def test_large_rulesets_find_what_plain_rules_find(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(90)]
    shapes = [r"\b{w}\b", r"(?i){w}[a-z]*", r"(?:{w}|{w}x)\.", r"{w}.*", "(?i)[ab]{w}|ee{w}"]
    some = [rule(f"r{i}", pattern=shapes[i % 5].format(w=w), diff_side="either", **(
        {"file_scope": ["^src/", "b.ts$"]} if i % 3 == 0 else {"exclude_paths": ["src/a*"]} if i % 3 == 1 else {}),
        **({"require_pattern": "e"} if i % 4 == 0 else {})) for i, w in enumerate(words)]
    some += [rule("sig", method="signature", signature="abcd"), rule("iban", method="checksum", validator=["iban"], mask="IBAN")]
    compiled = compile_rulesets(spark, [ruleset(*some, signatures={"abcd": ["Abcd", "DABA"]})])
    plain = [dataclasses.replace(compiled[0], rules=tuple(dataclasses.replace(r, texts=()) for r in compiled[0].rules))]
    assert len(detect._blocks([(compiled[0], r) for r in compiled[0].rules])[1]) > 2
    texts = [" ".join(rng.choice([w, w.upper(), w + ".", "İ" + w, "DE89370400440532013000"]) for w in rng.sample(words, 4)) for _ in range(60)]
    rows = [(i, rng.choice(["src/a.ts", "src/b.ts", "lib/b.ts", "dist/x.js"]), t) for i, t in enumerate([*texts, "", "Abcd DABA"])]
    docs = spark.createDataFrame(rows, "id int, path string, text string")

    def hits(rulesets, settled):
        lines = text_lines(docs, "id", "text", F.col("path"), scopes=scopes(rulesets) if settled else ())
        return sorted(map(tuple, detect.line_hits(lines, rulesets).collect()))

    expected = hits(plain, False)
    assert len({h[2] for h in expected}) > 40
    assert hits(compiled, True) == expected == hits(compiled, False)


def test_a_text_names_only_the_rules_that_ask_for_it(spark):
    """Rules are reached by whole texts, also where one text begins with another or is longer than the index."""
    long = "abc" * 20
    texts = ["the", "therefore", "other", long + "x", long + "y", "a.b|c", *[f"word{i}z" for i in range(30)]]
    compiled = compile_rulesets(spark, [ruleset(*[rule(f"r{i}", pattern=t.replace(".", r"\.").replace("|", r"\|")) for i, t in enumerate(texts)])])
    blocks = dict(detect._blocks([(compiled[0], r) for r in compiled[0].rules])[1])
    assert blocks["the"] == [0] and blocks["therefore"] == [0, 1] and blocks["word7z"] == [13] and blocks[long[:detect.HEAD]] == [3, 4]
    rows = ["therefore", "otherefore", "bathe", long + "y", "ab" + long + "x", "A.B|C a.b|c", "word3zword4z word", "", None]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "change_id int, text string").selectExpr(
        "*", "'f' as file", "'added' as side", "0 as side_ord", "0 as pos", "1L as line_no")
    got = sorted((h.change_id, h.rule_ord) for h in detect.line_hits(lines, compiled).collect())
    assert got == sorted((i, n) for i, row in enumerate(rows) for n, t in enumerate(texts) if t in (row or ""))


def _parses(spark, make):
    """How often the plan of the rows that ``make`` gives reads hunk headers; what is written already does not count."""
    return make()._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(raw#")


def test_queries_on_changes_parse_their_diffs_beforehand(spark, tmp_path):
    from gatelake.catalog import scans
    docs = [(i, f"un.{i}@corp.io\nthe token = {i}\nMIT of x and y", "en", "src1", 9) for i in range(6)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("floored_verdicts", "payload_contexts"):
        assert _parses(spark, lambda: getattr(scans, name)(spark, str(tmp_path))) == 0


def test_a_batch_is_parsed_once(spark, tmp_path, monkeypatch):
    from gatelake.plans import scan as plans
    from gatelake.streaming.changes import current, stream_scan
    sent = [(str(n % 2), "c0", diff([f"un{n % 2}@corp.io"]), "") for n in range(4)]
    spark.createDataFrame(sent, "change_id string, commit_sha string, diff string, description string").write.parquet(f"{tmp_path}/in")
    scratch = []
    plain = plans.side_lines
    monkeypatch.setattr(plans, "side_lines", lambda lines: (scratch.append(lines.inputFiles()), plain(lines))[1])
    stream = spark.readStream.schema("change_id string, commit_sha string, diff string, description string").parquet(f"{tmp_path}/in")
    compiled = compile_rulesets(spark, [ruleset(rule("m", pattern=MAIL))])
    stream_scan(stream, compiled, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert scratch and all("/out/lines/" in file for files in scratch for file in files)
    assert sorted((v.change_id, v.n_review) for v in current(spark, f"{tmp_path}/out", "verdicts").collect()) == [("0", 1), ("1", 1)]
