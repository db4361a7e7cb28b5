"""Unified diffs to line tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import DIFF_METADATA_PREFIXES
from ..functions.patterns import to_java
from ..functions.text import any_of, found, quoted

# --- fixed values: header forms ---------------------------------------------------------------
GIT_HEADER = to_java(r"^diff --git a\/(.+?) b\/(.+)$")
NEW_FILE = to_java(r"^\+\+\+ b\/(.+)$")
OLD_FILE = to_java(r"^--- a\/(.+)$")
HUNK = to_java(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


#: Lines of a diff that are read together; a longer diff is read by several tasks.
CHUNK = 4096


def raw_lines(changes: DataFrame, key="change_id", keep=()) -> DataFrame:
    """One row per physical diff line, with its chunk and how many chunks the diff has.

    Diffs are cut into chunks of lines before they are dealt: one shuffle of few wide rows, in which a change of any
    length is spread, and the windows by chunk below reuse that partitioning.
    """
    # The outer form keeps Spark from splitting each text a second time in a filter.
    cut = changes.select(key, *keep, F.split("diff", "\n", -1).alias("all")).select(
        key, *keep, F.expr(f"cast(ceil(size(all) / {CHUNK}) as int)").alias("chunks"), F.posexplode_outer(F.expr(
            f"transform(sequence(0, cast((size(all) - 1) div {CHUNK} as int)), i -> slice(all, i * {CHUNK} + 1, {CHUNK}))")).alias("chunk", "part"))
    placed = cut.where(F.col("chunk").isNotNull()).withColumn("size", F.size("part")).repartition(F.col(key), F.col("chunks"), F.col("chunk"))
    lines = placed.select(key, *keep, "chunks", "chunk", "size", F.posexplode_outer("part").alias("at", "raw"))
    return lines.selectExpr(key, *keep, "chunks", "chunk", "at = size - 1 as ends", f"chunk * {CHUNK} + at as pos", "raw").where(F.col("pos").isNotNull())


def _kind_sql() -> str:
    """git header / new path / old path / hunk / metadata / content; the first that fits."""
    meta = any_of(f"startswith(raw, {quoted(p)})" for p in DIFF_METADATA_PREFIXES)
    return (f"case when startswith(raw, 'diff --git a/') and {found('raw', GIT_HEADER)} then 'git' "
            f"when startswith(raw, '+++ b/') and {found('raw', NEW_FILE)} then 'new' "
            f"when startswith(raw, '--- a/') and {found('raw', OLD_FILE)} then 'old' "
            f"when startswith(raw, '@@ -') and {found('raw', HUNK)} then 'hunk' "
            f"when {meta} then 'meta' else 'content' end")


def _part(pattern: str, group: int) -> str:
    return f"regexp_extract(raw, {quoted(pattern)}, {group})"


def _states(lines: DataFrame, key: str) -> DataFrame:
    """What comes into each later chunk of a change, from the states in which the chunks before it ended.

    States compose: paths and scopes are the last known, the counters add up, and bases are moved by the counters of the
    chunks before theirs. A change has one row per chunk here.
    """
    ends = lines.where("chunks > 1 and ends").selectExpr(
        key, "chunk", "path", "old_path", "scope", "hunks", "olds", "news", "old_base", "new_base", "hunk_base")
    before = f"over (partition by {key} order by chunk rows between unbounded preceding and 1 preceding)"
    counted = ends.selectExpr(
        key, "chunk", "old_base", "new_base", "hunk_base",
        f"last(path, true) {before} as path_in", f"first(old_path, true) {before} as old_path_in", f"last(scope, true) {before} as scope_in",
        *[f"coalesce(sum({c}) {before}, 0L) as {c}_in" for c in ("hunks", "olds", "news")])
    return counted.selectExpr(
        key, "chunk", "path_in", "old_path_in", "scope_in", "hunks_in", "olds_in", "news_in",
        f"last(old_base - olds_in, true) {before} as old_base_in", f"last(new_base - news_in, true) {before} as new_base_in",
        f"last(hunk_base + hunks_in, true) {before} as hunk_base_in").where("chunk > 0")


def all_lines(changes: DataFrame, key="change_id", keep=()) -> DataFrame:
    """Every raw line with its file, hunk, side and number; ``side`` is null outside hunks.

    A segmented scan: running values within each chunk, in one sort by (change, chunk, position); only changes of
    several chunks then take over what the chunks before have left.
    """
    carried = [key, *keep, "chunks", "chunk", "ends", "pos", "raw", "kind"]
    lines = raw_lines(changes, key, keep).selectExpr("*", f"{_kind_sql()} as kind").selectExpr(
        *carried,
        f"case when kind = 'git' then {_part(GIT_HEADER, 2)} when kind = 'new' and raw <> '+++ b//dev/null' then {_part(NEW_FILE, 1)} end as path",
        f"case when kind = 'old' and raw <> '--- a//dev/null' then {_part(OLD_FILE, 1)} end as old_path",
        "case when kind = 'content' then case substr(raw, 1, 1) when '+' then 'added' when '-' then 'removed' else 'context' end end as mark",
        f"case when kind = 'hunk' then try_cast({_part(HUNK, 1)} as bigint) end as old_start",
        f"case when kind = 'hunk' then try_cast({_part(HUNK, 3)} as bigint) end as new_start")
    w = f"over (partition by {key}, chunks, chunk order by pos rows between unbounded preceding and current row)"
    first = lines.selectExpr(
        *carried, "mark", "old_start", "new_start",
        f"last(path, true) {w} as path", f"first(old_path, true) {w} as old_path",
        f"last(if(kind in ('git', 'hunk'), kind, null), true) {w} as scope",
        f"sum(if(kind = 'hunk', 1L, 0L)) {w} as hunks",
        f"sum(if(mark in ('removed', 'context'), 1L, 0L)) {w} as olds",
        f"sum(if(mark in ('added', 'context'), 1L, 0L)) {w} as news")
    second = first.selectExpr(
        *carried, "mark", "path", "old_path", "scope", "hunks", "olds", "news",
        f"last(old_start - olds, true) {w} as old_base", f"last(new_start - news, true) {w} as new_base",
        f"last(if(kind = 'git', hunks, null), true) {w} as hunk_base")
    states = _states(second, key).withColumnsRenamed({key: "key_in", "chunk": "chunk_in"})
    joined = second.join(states, second[key].eqNullSafe(states.key_in) & (second.chunk == states.chunk_in), "left")
    return joined.selectExpr(
        key, *keep, "pos", "if(kind = 'content' and coalesce(scope, scope_in) = 'hunk', mark, null) as side",
        "coalesce(path, path_in, old_path_in, old_path, '') as file",
        "if(mark = 'removed', coalesce(old_base, old_base_in + olds_in) + olds, coalesce(new_base, new_base_in + news_in) + news) - 1 as line_no",
        "if(substr(raw, 1, 1) in ('+', '-', ' '), substr(raw, 2), raw) as text",
        "hunks + coalesce(hunks_in, 0) - coalesce(hunk_base + coalesce(hunks_in, 0), hunk_base_in, 0) - 1 as hunk_index")


def diff_lines(changes: DataFrame, key="change_id", keep=()) -> DataFrame:
    """The content lines of each diff (added, removed and context)."""
    return all_lines(changes, key, keep).where(F.col("side").isNotNull())


def side_lines(lines: DataFrame, side: str | None = None) -> DataFrame:
    """Added, removed, or both; ``side_ord`` keeps added lines before removed ones."""
    wanted = [side] if side in ("added", "removed") else ["added", "removed"]
    return lines.where(F.col("side").isin(wanted)).withColumn(
        "side_ord", F.when(F.col("side") == "removed", 1).otherwise(0))


def diff_stats(lines: DataFrame, key="change_id") -> DataFrame:
    def n(side):
        return F.count_if(F.col("side") == side).alias(side)
    return lines.groupBy(key, "file").agg(n("added"), n("removed"), n("context"),
                                          F.countDistinct("hunk_index").alias("hunks"))


def bucket_sizes(lines: DataFrame, key="change_id") -> DataFrame:
    """Removed and added line counts per hunk, from which pair counts follow without pairing."""
    return lines.groupBy(key, "file", "hunk_index").agg(
        F.count_if(F.col("side") == "removed").alias("n_minus"),
        F.count_if(F.col("side") == "added").alias("n_plus"))


def pair_counts(lines: DataFrame, key="change_id") -> DataFrame:
    """How many before/after pairs each window would enumerate per change."""
    hunks = bucket_sizes(lines, key).withColumn("in_hunk", F.col("n_minus") * F.col("n_plus"))
    files = hunks.groupBy(key, "file").agg(
        F.sum("in_hunk").alias("in_hunk"), (F.sum("n_minus") * F.sum("n_plus")).alias("in_file"))
    return files.groupBy(key).agg(F.sum("in_hunk").alias("same_hunk_pairs"), F.sum("in_file").alias("same_file_pairs"))
