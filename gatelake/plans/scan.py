"""Scan a table of changes, or any table of lines, with compiled rulesets."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import coverage, detect, findings as fnd, pairs, verdicts as ver
from ..operators.diff import all_lines, side_lines
from ..operators.rules import Ruleset


@dataclass
class Scan:
    """Lazy results of one scan; nothing runs until a table is written or read."""
    rulesets: list
    hits: DataFrame
    coverage: Callable[[], DataFrame]
    key: str = "change_id"
    has_description: bool = False
    has_pairs: bool = False
    keep: tuple = ()

    def stored(self, folder: str) -> Scan:
        """The same scan over its written hits and coverage, so several reports read the lines once.

        ``folder`` must be shared by all executors; a lost executor then costs a re-read, not a rescan.
        """
        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

        hits, stats = kept(self.hits, "hits"), kept(self.coverage(), "coverage")
        return replace(self, hits=hits, coverage=lambda: stats)

    @property
    def findings(self) -> DataFrame:
        return fnd.findings(self.hits, self.rulesets, self.key)

    def _counts(self) -> DataFrame:
        unique = fnd.deduplicated(self.hits, self.rulesets, self.key)
        return unique.groupBy(self.key, "fw_ord").agg(
            *[F.count_if(F.col("severity") == s).alias(n) for n, s in (("n_block", 0), ("n_review", 1), ("n_advise", 2))],
            F.collect_set("rule_ord").alias("hit_rules"))

    @property
    def verdicts(self) -> DataFrame:
        """One row per change and framework, also where nothing was found."""
        if not self.rulesets:
            return ver.degraded(self.coverage(), [], "no ruleset", self.key, self.keep)
        frameworks = F.array(*[F.struct(
            F.lit(fw.fw_ord).alias("fw_ord"), F.lit(fw.framework).alias("framework"),
            F.lit(fw.version).cast("bigint").alias("ruleset_version"), F.lit(fw.hash).alias("ruleset_hash"))
            for fw in self.rulesets])
        base = self.coverage().withColumn("_fw", F.explode(frameworks)).select("*", "_fw.*").drop("_fw")
        counts = self._counts()
        joined = base.join(counts, [self.key, "fw_ord"], "left")
        per_fw = F.coalesce(*[
            F.when(F.col("fw_ord") == fw.fw_ord, coverage.warnings_of(fw, self.has_description, self.has_pairs))
            for fw in self.rulesets])
        warned = joined.withColumns({
            "hit_rules": F.coalesce("hit_rules", F.array().cast("array<int>")),
            **{c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_block", "n_review", "n_advise")}})
        no_diff = F.array(F.struct(
            F.lit("no_diff").alias("code"), F.lit("Diff unavailable: no diff text").alias("detail"), F.lit(True).alias("floors")))
        warned = warned.withColumn("warnings", F.when(F.col("unreadable"), no_diff).otherwise(per_fw))
        incomplete = F.exists("warnings", lambda w: w["floors"])
        return warned.select(
            self.key, "fw_ord", "framework", "ruleset_version", "ruleset_hash", *self.keep,
            ver.verdict_of(F.col("n_block"), F.col("n_review"), incomplete).alias("verdict"),
            "n_block", "n_review", "n_advise", incomplete.alias("incomplete"), "warnings")

    @property
    def warnings(self) -> DataFrame:
        """One row per warning, numbered in the order raised."""
        return self.verdicts.select(
            self.key, "fw_ord", "framework", F.posexplode("warnings").alias("pos", "w")).select(
            self.key, "fw_ord", "framework", (F.col("pos") + 1).alias("warning_ord"), "w.*")


def _unscanned(sources: DataFrame, key: str, keep=()) -> Scan:
    """A scan without any ruleset: no hit, and verdicts that say so."""
    return Scan([], detect.line_hits(_no_lines(sources, key), [], key), lambda: sources, key, keep=tuple(keep))


def _no_lines(sources: DataFrame, key: str) -> DataFrame:
    return sources.select(key, *[F.lit(None).cast(t).alias(c) for c, t in (
        ("side", "string"), ("side_ord", "int"), ("pos", "int"), ("file", "string"), ("line_no", "bigint"), ("text", "string"))])


def scan_lines(lines: DataFrame, rulesets: list[Ruleset], sources: DataFrame, key="change_id") -> Scan:
    """Scan line rows of any table; ``sources`` lists every key, so quiet ones get a verdict too.

    A boolean ``unreadable`` in ``sources`` marks keys whose text is missing: they are never a silent pass.
    """
    if not rulesets:
        return _unscanned(sources, key)
    unreadable = F.col("unreadable") if "unreadable" in sources.columns else F.lit(False)
    base = sources.select(key, F.lit(False).alias("truncated"), unreadable.alias("unreadable"))
    hits = detect.graded_by_context(detect.line_hits(lines, rulesets, key), None, rulesets, key)
    return Scan(rulesets, hits,
                lambda: base.join(coverage.text_stats(lines, rulesets, key), key, "left"), key)


def scan_changes(changes: DataFrame, rulesets: list[Ruleset], key="change_id", keep=(), scratch: str | None = None) -> Scan:
    """Scan changes (diff, description, optional truncated and context, see ``graded_by_context``).

    Line hits, pairs and coverage each need the parsed lines. With a ``scratch`` folder, shared by all executors, these
    are written there at once and read by all three; without it each parses the diffs again.
    """
    if not rulesets:
        return _unscanned(changes, key, tuple(keep))
    if "truncated" not in changes.columns:
        changes = changes.withColumn("truncated", F.lit(False))
    lines = all_lines(changes, key)
    if scratch:
        lines.write.mode("overwrite").parquet(scratch)
        lines = lines.sparkSession.read.schema(lines.schema).parquet(scratch)
    sided = side_lines(lines)
    hits = detect.line_hits(sided, rulesets, key)
    has_pairs = bool(pairs.paired_rules(rulesets))
    if has_pairs:
        hits = hits.unionByName(pairs.paired_hits(sided, rulesets, key))
    described = any(r.pattern for fw in rulesets for r in fw.of_kind("description"))
    if described:
        hits = hits.unionByName(detect.description_hits(changes.where(F.col("diff").isNotNull()), rulesets, key))
    hits = detect.graded_by_context(hits, changes if "context" in changes.columns else None, rulesets, key)
    notes = coverage.description_columns(rulesets) if described else []
    base = changes.select(key, "truncated", F.col("diff").isNull().alias("unreadable"), *keep, *notes)
    return Scan(rulesets, hits, lambda: base.join(coverage.line_stats(lines, rulesets, key), key, "left"), key,
                described, has_pairs, tuple(keep))


def context_booleans(context: Column, rulesets: list[Ruleset]) -> Column:
    """The booleans the rulesets grade by, from a VARIANT context; other types never match."""
    names = sorted({k for fw in rulesets for r in fw.rules for cond, _ in r.lowering for k, _ in cond})
    if not names:
        return F.lit(None).cast("map<string,boolean>")

    def value(name):
        path = f"$['{name}']"
        kind = F.schema_of_variant(F.try_variant_get(context, path, "variant"))
        return F.when(kind == "BOOLEAN", F.try_variant_get(context, path, "boolean"))

    pairs_ = [x for n in names for x in (F.lit(n), value(n))]
    return F.create_map(*pairs_)
