"""Technology-usage inventory of file trees: counts per (rule, family), never content."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import (EMOTION_KEY, EMOTION_RULE_ID, INVENTORY_KEEP_RUNS, INVENTORY_RULE_IDS, LONG_LINE_CHARS, OTHER_FAMILY,
                         SIGNATURE_FAMILIES, SIGNATURE_KEYS)
from ..functions import globs
from ..sources.tree import decoded, is_binary
from .rules import Rule, Ruleset

REPO = ("repo", "commit_sha")
SALT = 64
_PAIRS = "array<struct<rule_id:string,signature_key:string>>"


def baseline_rules(ruleset: Ruleset) -> list[Rule]:
    return [r for r in ruleset.rules if r.baseline and r.id in INVENTORY_RULE_IDS]


def _running(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.pattern and not r.failed]


def family(rule_id: Column, match: Column) -> Column:
    """Signature family of a matched text: the first listed pattern, else the catch-all."""
    lower = F.lower(match)
    found = F.coalesce(*[F.when(lower.rlike(p), F.lit(k)) for k, p in SIGNATURE_FAMILIES], F.lit(OTHER_FAMILY))
    return F.when(rule_id == EMOTION_RULE_ID, EMOTION_KEY).otherwise(found)


def scoped_files(tree: DataFrame, rules: list[Rule]) -> DataFrame:
    """Files with the positions of the rules whose scope covers them, before any content is touched."""
    covering = F.array_compact(F.array(*[
        F.when(F.expr(r.scope_sql("path")), F.lit(i)) for i, r in enumerate(_running(rules))]))
    return tree.withColumn("excluded", globs.is_built_in_exclusion(F.col("path"))) \
        .withColumn("covering", covering).drop("excluded")


def cap_paths(files: DataFrame, max_files: int) -> DataFrame:
    """For repositories with more than ``max_files`` covered files, the last path that is still read.

    Only (repo, path) is shuffled.  Ranking first inside hashed slices keeps a repository
    that holds a large share of all files from meeting in one task.
    """
    narrow = files.where(F.size("covering") > 0).select(*REPO, "path")
    sliced = narrow.withColumn("slice", F.pmod(F.xxhash64("path"), F.lit(SALT)))
    local = Window.partitionBy(*REPO, "slice").orderBy("path")
    kept = sliced.withColumn("n", F.row_number().over(local)).where(F.col("n") <= max_files + 1)
    overall = Window.partitionBy(*REPO).orderBy("path")
    ranked = kept.withColumn("n", F.row_number().over(overall)).where(F.col("n") <= max_files + 1)
    over = ranked.groupBy(*REPO).agg(
        F.max(F.when(F.col("n") == max_files, F.col("path"))).alias("last_path"), F.max("n").alias("n"))
    return over.where(F.col("n") > max_files).drop("n")


def opened_files(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """Covered files, or of each repository the first ``max_files`` by path where the caller names a cap."""
    covered = files.where(F.size("covering") > 0)
    if max_files is None:
        return covered
    joined = covered.join(cap_paths(files, max_files), list(REPO), "left")
    return joined.where(F.col("last_path").isNull() | (F.col("path") <= F.col("last_path"))).drop("last_path")


def _with_content(opened: DataFrame, max_bytes: int | None) -> DataFrame:
    """What became of each opened file: unreadable, too large, binary, or its lines."""
    too_large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    state = (F.when(F.col("length").isNull(), "unreadable").when(too_large, "size")
             .when(F.col("content").isNull(), "unreadable").when(is_binary(F.col("content")), "binary").otherwise("scanned"))
    return opened.withColumn("state", state)


def _lines_of(content: Column) -> Column:
    return F.split(decoded(content), r"\r?\n", -1)


def _families_found(rules: list[Rule], text: Column) -> Column:
    """The (rule, family) pairs a line counts for, each once: ARRAY<STRUCT<rule_id, signature_key>>."""
    def found(i: int, r: Rule) -> Column:
        cond = F.array_contains("covering", i) & F.expr(r.gate_sql("text"))
        if r.hint:
            cond = cond & F.contains(text, F.lit(r.hint))
        values = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        if r.id == EMOTION_RULE_ID:
            keys = F.transform(F.slice(values, 1, 1), lambda m: F.lit(EMOTION_KEY))
        else:
            keys = F.array_distinct(F.transform(values, lambda m: family(F.lit(r.id), m)))
        pairs = F.transform(keys, lambda k: F.struct(F.lit(r.id).alias("rule_id"), k.alias("signature_key")))
        return F.when(cond, pairs).otherwise(F.array().cast(_PAIRS))

    return F.flatten(F.array(*[found(i, r) for i, r in enumerate(rules)]).cast(f"array<{_PAIRS}>"))


def matching_lines(opened: DataFrame, rules: list[Rule], max_bytes: int | None = None) -> DataFrame:
    """(repo, commit, path, rule, family, count of matching lines), counted per file before any shuffle."""
    running = _running(rules)
    lines = (_with_content(opened, max_bytes).where(F.col("state") == "scanned")
             .select(*REPO, "path", "covering", F.explode_outer(_lines_of(F.col("content"))).alias("line"))
             .where(F.length("line") > 0)
             .select(*REPO, "path", "covering", F.col("line").alias("text")))

    hits = lines.select(*REPO, "path", F.inline_outer(_families_found(running, F.col("text"))))
    return hits.where(F.col("rule_id").isNotNull()).groupBy(*REPO, "path", "rule_id", "signature_key") \
        .agg(F.count("*").alias("lines"))


def observations(counted: DataFrame, sample_paths: int = 0) -> DataFrame:
    """Counts per (repo, rule, family), with up to ``sample_paths`` example paths where the caller asks for some."""
    keys = [*REPO, "rule_id", "signature_key"]
    totals = counted.groupBy(*keys).agg(F.sum("lines").alias("count"))
    if not sample_paths:
        return totals
    order = Window.partitionBy(*keys).orderBy("path")
    first = counted.select(*keys, "path").withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_paths)
    paths = first.groupBy(*keys).agg(F.array_sort(F.collect_list("path")).alias("sample_paths"))
    return totals.join(paths, keys, "left")


def _known_gaps(rules: list[Rule]) -> list[str]:
    """Why a run is incomplete whatever the files: a rule that does not run, or a refused glob in a file scope."""
    running = _running(rules)
    refused = any(globs.refusal(g) for r in running for g in r.file_scope)
    return ["rule_not_run"] * (len(running) < len(rules)) + ["refused_scope"] * refused


def run_summary(files: DataFrame, opened: DataFrame, rules: list[Rule], max_bytes: int | None = None) -> DataFrame:
    """Counters, reasons for incompleteness and observations, one row per (repo, commit), from one pass over the content.

    Each content is decoded once: files, long lines and matching lines become tagged rows of one aggregate, which is
    folded in the map tasks. What then meets per repository is one row per state and one per rule and family, all of
    closed vocabularies. The reasons are rule_not_run, refused_scope, file_cap (covered files that were not opened) and
    unread_scope (a rule covers files, and none of them could be read; binary ones count as read). ``observations``
    are sorted by rule and family; repositories without files have no row.
    """
    running = _running(rules)
    seen = _with_content(opened, max_bytes)
    lines = seen.select(*REPO, "covering", "state", F.posexplode_outer(
        F.when(F.col("state") == "scanned", _lines_of(F.col("content")))).alias("pos", "text"))
    kinds = "array<struct<kind:string,rule_id:string,signature_key:string>>"

    def tagged(kind: str, cond: Column) -> Column:
        row = F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("signature_key"))
        return F.when(cond, F.array(row)).otherwise(F.array().cast(kinds))

    matched = F.transform(_families_found(running, F.col("text")), lambda p: F.struct(
        F.lit("line").alias("kind"), p["rule_id"].alias("rule_id"), p["signature_key"].alias("signature_key")))
    rows = lines.select(*REPO, "covering", "state", F.inline(F.concat(
        tagged("file", F.coalesce("pos", F.lit(0)) == 0), tagged("long", F.length("text") > LONG_LINE_CHARS),
        F.when(F.length("text") > 0, matched).otherwise(F.array().cast(kinds)))))
    is_file, state = F.col("kind") == "file", F.col("state")
    folded = rows.groupBy(*REPO, "kind", "state", "rule_id", "signature_key").agg(F.count("*").alias("n"), *[
        F.count_if(is_file & F.array_contains("covering", i)).alias(f"covers_{i}") for i, _ in enumerate(running)])

    def total(name: str, cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(name))), F.lit(0)).cast("bigint")

    read = state.isin("scanned", "binary")
    unread = [(total(f"covers_{i}", is_file) > 0) & (total(f"covers_{i}", is_file & read) == 0) for i, _ in enumerate(running)]
    found = F.when(F.col("kind") == "line", F.struct("rule_id", "signature_key", F.col("n").alias("count")))
    per_run = folded.groupBy(*REPO).agg(
        total("n", is_file).alias("opened"), total("n", F.col("kind") == "long").alias("long_lines"),
        *[total("n", is_file & (state == s)).alias(c) for s, c in (
            ("size", "skipped_size"), ("binary", "skipped_binary"), ("unreadable", "skipped_unreadable"), ("scanned", "files_scanned"))],
        F.exists(F.array(*unread).cast("array<boolean>"), lambda u: u).alias("unread"),
        F.array_sort(F.collect_list(found)).alias("observations"))
    listed = files.groupBy(*REPO).agg(F.count("*").alias("listed"), F.count_if(F.size("covering") == 0).alias("out_of_scope"))
    counters = ["skipped_size", "skipped_binary", "skipped_unreadable", "long_lines", "files_scanned"]
    reasons = F.array_compact(F.array(
        *[F.lit(gap) for gap in _known_gaps(rules)],
        F.when(F.col("listed") - F.col("out_of_scope") > F.coalesce("opened", F.lit(0)), "file_cap"),
        F.when(F.col("unread"), "unread_scope")))
    return listed.join(per_run, list(REPO), "left").select(
        *REPO, "listed", "out_of_scope", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counters],
        reasons.alias("reasons"), (F.size(reasons) > 0).alias("truncated"),
        F.coalesce("observations", F.array().cast("array<struct<rule_id:string,signature_key:string,count:bigint>>")).alias("observations"))


def run_stats(files: DataFrame, opened: DataFrame, rules: list[Rule], max_bytes: int | None = None) -> DataFrame:
    """Counters and completeness per (repo, commit)."""
    running = _running(rules)
    listed = files.groupBy(*REPO).agg(
        F.count("*").alias("listed"), F.count_if(F.size("covering") == 0).alias("out_of_scope"))
    seen = _with_content(opened, max_bytes)
    state = F.col("state")
    long_lines = F.when(state == "scanned", F.size(F.filter(
        _lines_of(F.col("content")), lambda t: F.length(t) > LONG_LINE_CHARS))).otherwise(0)
    seen = seen.select(*REPO, "covering", "state", long_lines.alias("long_lines"))
    read = state.isin("scanned", "binary")
    blind = []
    for i, _ in enumerate(running):
        here = F.array_contains("covering", i)
        blind.append((F.count_if(here) > 0) & (F.count_if(here & read) == 0))
    any_blind = blind[0] if blind else F.lit(False)
    for b in blind[1:]:
        any_blind = any_blind | b
    states = seen.groupBy(*REPO).agg(
        F.count("*").alias("opened"),
        *[F.count_if(state == s).alias(n) for s, n in (
            ("size", "skipped_size"), ("binary", "skipped_binary"), ("unreadable", "skipped_unreadable"),
            ("scanned", "files_scanned"))],
        F.sum("long_lines").alias("long_lines"), any_blind.alias("blind"))
    static = bool(_known_gaps(rules))
    zero = F.lit(0).cast("bigint")
    counters = ["skipped_size", "skipped_binary", "skipped_unreadable", "long_lines", "files_scanned"]
    in_scope = F.col("listed") - F.col("out_of_scope")
    return listed.join(states, list(REPO), "left").select(
        *REPO, "listed", "out_of_scope", *[F.coalesce(c, zero).alias(c) for c in counters],
        (F.lit(static) | (in_scope > F.coalesce("opened", zero)) | F.coalesce("blind", F.lit(False))).alias("truncated"))


def contract_violations(rows: DataFrame) -> DataFrame:
    """Observations outside the closed vocabularies, or pairing the emotion key with another rule."""
    bad = (~F.col("rule_id").isin(*INVENTORY_RULE_IDS)) | (~F.col("signature_key").isin(*SIGNATURE_KEYS)) | (
        (F.col("rule_id") == EMOTION_RULE_ID) != (F.col("signature_key") == EMOTION_KEY))
    return rows.where(F.coalesce(bad, F.lit(True)))


def latest_runs(runs: DataFrame, keep: int = INVENTORY_KEEP_RUNS) -> DataFrame:
    """The newest runs per repository; earlier ones are pruned before the shuffle."""
    w = Window.partitionBy("repo").orderBy(F.col("run").desc())
    return runs.withColumn("age", F.row_number().over(w)).where(F.col("age") <= keep)


def current_state(runs: DataFrame, found: DataFrame) -> DataFrame:
    """Latest detections per repository: a complete run replaces everything before it, an incomplete one adds.

    ``runs`` is (repo, run, truncated), ``found`` is (repo, run, rule_id, signature_key, count).
    """
    complete = runs.where(~F.col("truncated")).groupBy("repo").agg(F.max("run").alias("since"))
    # One row per repository and key survives before the join, so a busy repository stays small.
    newest = found.groupBy("repo", "rule_id", "signature_key").agg(F.max(F.struct("run", "count")).alias("n"))
    rows = newest.join(complete, "repo", "left")
    return rows.where(F.col("since").isNull() | (F.col("n.run") >= F.col("since"))) \
        .select("repo", "rule_id", "signature_key", F.col("n.run").alias("run"), F.col("n.count").alias("count"))
