"""Small builders shared by the tests."""
from gatelake.operators.rules import compile_rulesets
from gatelake.plans.scan import scan_changes

def rule(id_, action="review", tier=2, **detect):
    extra = {k: detect.pop(k) for k in ("articles", "gdpr_article", "baseline") if k in detect}
    return {"id": id_, "name": id_, "action": action, "tier": tier,
            "detect": {"method": "pattern", "target": "diff", "diff_side": "added", "mask": id_, **detect}, **extra}


def ruleset(*rules, framework="Data Compliance", **extra):
    return {"framework": framework, "ruleset_version": 1, "ruleset_hash": "h", "rules": list(rules), **extra}


def diff(added=(), removed=(), path="src/a.ts", context=("ctx",)):
    lines = [f"diff --git a/{path} b/{path}", f"--- a/{path}", f"+++ b/{path}", "@@ -1,1 +1,2 @@"]
    lines += [" " + c for c in context] + ["-" + r for r in removed] + ["+" + a for a in added]
    return "\n".join(lines)


def changes(spark, rows):
    """rows: list of (diff, description)."""
    return spark.createDataFrame([(str(i), d, t) for i, (d, t) in enumerate(rows)], "change_id string, diff string, description string")


def scan(spark, rows, *documents, context=None):
    rows = [(r, "") if isinstance(r, str) or r is None else r for r in rows]
    df = changes(spark, rows)
    if context is not None:
        from pyspark.sql import functions as F
        df = df.withColumn("context", F.create_map(*[F.lit(x) for kv in context.items() for x in kv]).cast("map<string,boolean>"))
    return scan_changes(df, compile_rulesets(spark, list(documents)))


def findings(spark, rows, *documents, **kw):
    found = scan(spark, rows, *documents, **kw).findings.orderBy("change_id", "fw_ord", "finding_ord").collect()
    return [(f.change_id, f.rule_id, f.action, f.masked_evidence) for f in found]


def rendered(files):
    """A diff text and the line table it stands for.

    files: (old path, new path, preamble lines, hunks); a hunk is (old start, new start, [(side, text)]), where the side
    None makes a line that belongs to neither version. The table has (pos, side, file, line_no, text, hunk_index).
    """
    text, rows = [], []
    for old_path, new_path, preamble, hunks in files:
        text += [f"diff --git a/{old_path} b/{new_path or old_path}", *preamble]
        if hunks:
            text += [f"--- a/{old_path}", f"+++ b/{new_path}" if new_path else "+++ /dev/null"]
        for index, (old, new, lines) in enumerate(hunks):
            text.append(f"@@ -{old},{len(lines)} +{new},{len(lines)} @@ fn")
            at = {"removed": old, "added": new, "context": new}
            before = [side for side, _ in lines]
            for i, (side, words) in enumerate(lines):
                if side is not None:
                    seen = before[:i].count
                    ahead = seen("removed") if side == "removed" else seen("added")
                    rows.append((len(text), side, new_path or old_path, at[side] + ahead + seen("context"), words, index))
                text.append({"removed": "-", "added": "+", "context": " ", None: "\\ "}[side] + words)
    return "\n".join(text), rows
