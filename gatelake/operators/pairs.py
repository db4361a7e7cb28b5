"""Before/after rules: a removed line and an added line of the same file (or hunk).

The pairs themselves are never built.  A finding names only the added line and whether the
partner sits in the same hunk, so per added line it is enough to know the first partner in
its hunk and the first one elsewhere; both are window minima over the lines that already
matched their half.  A removed text that occurs inside the evidence string of an added line
is starred there, which makes it a different finding.  Such needles are found by equality:
a text can occur in the label and path (on every line of the file), run from the path into
the line number, or lie within the number, so each added line asks for the few substrings
of its own number, and each distinct removed text is entered once under the one it needs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import masking
from ..functions.allowlist import is_allowlisted_sql
from ..functions.globs import is_built_in_exclusion
from ..functions.patterns import js_trim
from ..functions.text import all_of, found, quoted
from .detect import lower_sql
from .rules import Rule, Ruleset

SAME, CROSS = " (same-hunk)", " (cross-hunk)"
NUMBER_DIGITS = 19  # a line number is a bigint


def paired_rules(rulesets: list[Ruleset]) -> list[tuple[Ruleset, Rule]]:
    return [(fw, r) for fw in rulesets for r in fw.of_kind("paired") if r.minus and r.plus]


def _stem(rule: Rule, suffix: str) -> Column:
    return F.concat(F.lit(masking.literal_label(rule.mask + suffix) + " @ "), F.col("safe_file"))


def _place(rules: list[tuple[Ruleset, Rule]], suffix: str) -> Column:
    """Where the trimmed removed text can occur in evidence of its rule and file, or null.

    ``stem``: in label and path; ``edge``: at their end and on into the line number; ``number``: within the number.
    """
    trimmed, tail = F.col("trimmed"), F.col("tail")
    stem = F.coalesce(*[F.when(F.col("rule") == i, _stem(r, suffix)) for i, (_, r) in enumerate(rules)])
    is_number = trimmed.rlike(rf"\A[0-9]{{1,{NUMBER_DIGITS}}}\z")
    return (F.when((F.col("side") != "removed") | (trimmed == ""), None).when(F.contains(stem, trimmed), "stem")
            .when((tail != "") & F.endswith(F.concat(stem, F.lit(":")), tail), "edge").when(is_number, "number"))


def _halves(fw: Ruleset, rule: Rule, index: int) -> Column:
    """The role of a line in a rule, or null: matched its half, in scope, not excluded."""
    tests = [rule.scope_sql(), f"if(side = 'removed', {found('text', rule.minus)}, {found('text', rule.plus)})"]
    if rule.exclude:
        tests.append(f"not {found('text', rule.exclude)}")
    if rule.synthetic:
        value = f"regexp_extract(text, {quoted(rule.minus)}, 0)"
        tests.append(f"(side <> 'removed' or not {is_allowlisted_sql(value, fw.allowlist)})")
    required = found("text", rule.require) if rule.require else "true"
    return F.when(F.expr(all_of(tests)), F.struct(
        F.lit(index).alias("rule"), F.expr(required).alias("met"),
        (F.col("hunk_index") if rule.same_hunk_only else F.lit(-1).cast("bigint")).alias("bucket")))


def _roles(lines: DataFrame, key: str) -> DataFrame:
    """Keep the first line per (side, line number) and say which partners it may take.

    A pair passes a precondition when either half meets it, and of several lines sharing a
    number only the first passing pair counts.  Role ``a``: the removed line meets it, any
    added line will do; ``b``: it does not, the added line must; ``c``: no added line of
    that number does, so the first removed line that does stands in.
    """
    number = Window.partitionBy(key, "rule", "file", "bucket", "side", "line_no")
    lines = lines.withColumns({
        "any": F.min(F.struct("pos", "met")).over(number),
        "met_pos": F.min(F.when(F.col("met"), F.col("pos"))).over(number)})
    is_first, is_met = F.col("pos") == F.col("any.pos"), F.col("pos") == F.col("met_pos")
    removed = F.array(
        F.when(is_first & F.col("met"), F.lit("a")).when(is_first, "b"),
        F.when(~F.col("any.met") & is_met, F.lit("c")))
    added = F.array(
        F.when(is_first, F.lit("a")),
        F.when(is_met, F.lit("b")).when(F.col("met_pos").isNull() & is_first, "c"))
    roles = F.array_compact(F.when(F.col("side") == "removed", removed).otherwise(added))
    return lines.withColumn("role", F.explode_outer(roles)).where(F.col("role").isNotNull())


def paired_partners(lines: DataFrame, rulesets: list[Ruleset], key="change_id") -> DataFrame:
    """Added lines that have a partner: (rule, plus line, same_hunk, minus_pos, needle)."""
    rules = paired_rules(rulesets)
    keep = [key, "pos", "side", "file", "line_no", "text", "hunk_index"]
    halves = (lines.where(F.col("side").isin("added", "removed")).select(*keep)
              .withColumn("excluded", is_built_in_exclusion(F.col("file")))
              .withColumn("half", F.explode_outer(F.array_compact(F.array(
                  *[_halves(fw, r, i) for i, (fw, r) in enumerate(rules)]))))
              .where(F.col("half").isNotNull()).select(*keep, "half.*"))
    # Only the few lines that matched a half are shaped any further.
    halves = halves.withColumns({"safe_file": masking.safe_label(F.col("file")), "trimmed": js_trim(F.col("text"))})
    halves = halves.withColumn("tail", F.regexp_extract("trimmed", r"(?s)\A(.*:)[0-9]*\z", 1))
    halves = halves.withColumns({"near_place": _place(rules, SAME), "far_place": _place(rules, CROSS)})
    halves = _roles(halves.drop("text"), key)

    # All windows below are over a file or a part of it, so the rows are dealt once.
    group = [key, "rule", "file", "bucket", "role"]
    file, hunk = Window.partitionBy(*group), Window.partitionBy(*group, "hunk_index")
    removed = F.col("side") == "removed"
    ordinary = F.when(removed & F.col("far_place").isNull(), F.struct("pos", "hunk_index"))
    rows = (halves.withColumn("best", F.min(ordinary).over(file))
            .withColumn("next", F.min(F.when(F.col("hunk_index") != F.col("best.hunk_index"), ordinary)).over(file))
            .withColumns({f"any_{p}": F.bool_or((F.col("near_place") == p) | (F.col("far_place") == p)).over(file) for p in ("edge", "number")})
            .withColumn("any_needle", F.bool_or(F.col("near_place").isNotNull() | F.col("far_place").isNotNull()).over(file))
            .withColumn("here", F.min(F.when(removed & F.col("near_place").isNull(), F.col("pos"))).over(hunk)))
    there = F.when(F.col("best.hunk_index") != F.col("hunk_index"), F.col("best.pos")).otherwise(F.col("next.pos"))
    rows = _with_needles(rows.withColumn("there", there).drop("best", "next"), group)

    def partner(same_hunk, pos, needle):
        return F.when(pos.isNotNull(), F.struct(F.lit(same_hunk).alias("same_hunk"), pos.cast("int").alias("minus_pos"), needle.alias("needle")))

    none = F.lit(None).cast("string")
    partners = F.concat(
        F.array(partner(True, F.least("here", "near_plain"), none), partner(False, F.least("there", "far_plain"), none)),
        F.transform("near_hits", lambda n: partner(True, n["pos"], n["needle"])),
        F.transform("far_hits", lambda n: partner(False, _elsewhere(n), n["needle"])))
    rows = rows.withColumn("partner", F.explode_outer(F.array_compact(partners)))
    rows = rows.where(F.col("partner").isNotNull())
    return rows.select(*[c for c in keep if c not in ("text", "side")], "safe_file", "rule", "partner.*")


def _elsewhere(n: Column) -> Column:
    """First place of a needle outside the hunk of the added line."""
    return F.when(n["hunk"] != F.col("hunk_index"), n["pos"]).otherwise(n["second"])


def _asked() -> Column:
    """What an added line asks for: the parts of its number that some needle of its file could be."""
    number = F.col("line_no").cast("string")
    none = F.array().cast("array<string>")
    heads = F.when(F.col("any_edge") & number.isNotNull(), F.transform(F.sequence(F.lit(0), F.length(number)), lambda n: F.substr(number, F.lit(1), n)))
    parts = F.when(F.col("any_number") & number.isNotNull(), F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(number)), lambda i: F.transform(
            F.sequence(F.lit(1), F.length(number) - i + 1), lambda n: F.substr(number, i, n))))))

    def asks(place, values):
        return F.transform(F.coalesce(values, none), lambda v: F.struct(F.lit(place).alias("place"), v.alias("digits")))

    return F.concat(asks("stem", F.array(F.lit(""))), asks("edge", heads), asks("number", parts))


def _with_needles(rows: DataFrame, group: list[str]) -> DataFrame:
    """Added lines with the needles in their evidence, and the first needle-like partner that is not in it.

    ``near`` rows look for needles in the hunk, the others in the file. Distinct needles that only some lines show
    are ranked by first place; a line's first one not shown follows the run of shown ranks 1, 2, ..., so each needle
    carries the place of the next rank. Outside the hunk, ranks first placed in the line's own hunk are stepped over
    (each knows the next rank of another hunk), and those needles are ranked again by their first place elsewhere.
    """
    def entry(near: bool):
        place = F.col("near_place" if near else "far_place")
        digits = F.when(place == "edge", F.substr("trimmed", F.length("tail") + 1)).when(place == "number", F.col("trimmed")).otherwise("")
        return F.when(place.isNotNull(), F.struct(F.lit(near).alias("near"), place.alias("place"), digits.alias("digits")))

    def asks(near: bool):
        return F.transform(_asked(), lambda a: F.struct(F.lit(near).alias("near"), a["place"].alias("place"), a["digits"].alias("digits")))

    nothing = F.struct(F.lit(None).cast("boolean").alias("near"), F.lit(None).cast("string").alias("place"), F.lit(None).cast("string").alias("digits"))
    added = F.when(F.col("any_needle"), F.concat(asks(True), asks(False))).otherwise(F.array(nothing))
    rows = rows.withColumn("is_added", F.col("side") == "added")
    rows = rows.withColumn("ask", F.explode(F.when(F.col("is_added"), added).otherwise(F.array_compact(F.array(entry(True), entry(False))))))
    rows = rows.select("*", "ask.*").drop("ask", "side", "near_place", "far_place", "tail", "any_edge", "any_number", "any_needle")
    rows = rows.withColumns({"area": F.when(F.col("near"), F.col("hunk_index")), "needle": F.when(~F.col("is_added"), F.col("trimmed"))}).drop("trimmed")

    # One row per distinct needle: its first place, and the first one in another hunk.
    area = [*group, "near", "area"]
    same = Window.partitionBy(*area, "is_added", "place", "digits", "needle")
    rows = rows.withColumn("one", F.when(~F.col("is_added"), F.min(F.struct("pos", "hunk_index")).over(same)))
    rows = rows.withColumn("second", F.when(~F.col("is_added"), F.min(F.when(F.col("hunk_index") != F.col("one.hunk_index"), F.col("pos"))).over(same)))
    rows = rows.where(F.col("is_added") | (F.col("pos") == F.col("one.pos"))).drop("one")

    ranked = ~F.col("is_added") & (F.col("place") != "stem")
    rows = rows.withColumn("ranked", ranked)
    by_place = Window.partitionBy(*area, "ranked").orderBy("pos")
    own = Window.partitionBy(*area, "ranked", "hunk_index").orderBy(F.asc_nulls_last("second"), "pos")
    later = Window.partitionBy(*area, "ranked").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"rank": F.when(F.col("ranked"), F.row_number().over(by_place)), "before": F.lag("hunk_index").over(by_place)})
    rows = rows.withColumn("start", F.when(F.col("ranked") & ~F.col("before").eqNullSafe(F.col("hunk_index")), F.struct("rank", F.col("pos").alias("place"))))
    rows = rows.withColumn("me", F.when(F.col("ranked"), F.struct(
        "rank", F.col("pos").alias("place"), F.col("hunk_index").alias("hunk"), F.min("start").over(later).alias("leave"))))
    rows = rows.withColumns({"after": F.lead("me").over(by_place), "own_rank": F.when(F.col("ranked"), F.row_number().over(own)),
                             "own_after": F.when(F.col("ranked"), F.lead("second").over(own))})
    rows = rows.withColumn("head", F.min("me").over(Window.partitionBy(*area)))
    rows = rows.withColumn("own_head", F.min(F.when(F.col("ranked"), F.col("second"))).over(Window.partitionBy(*area, "hunk_index")))

    # One needle for a number; for the others, distinct substrings of one label and path.
    found_ = F.collect_list(F.when(~F.col("is_added"), F.struct(
        "rank", "after", "own_rank", "own_after", "pos", F.col("hunk_index").alias("hunk"), "second", "needle")))
    rows = rows.withColumn("hits", found_.over(Window.partitionBy(*area, "place", "digits"))).where("is_added")

    def gathered(near: bool):
        return F.flatten(F.collect_list(F.when(F.col("near") if near else ~F.col("near"), F.col("hits"))))

    def of(column: str, near: bool):
        return F.max(F.when(F.col("near") if near else ~F.col("near"), F.col(column)))

    lines = rows.groupBy(*group, "pos").agg(
        *[F.first(c).alias(c) for c in ("line_no", "hunk_index", "safe_file", "here", "there")],
        gathered(True).alias("near_hits"), gathered(False).alias("far_hits"),
        of("head", True).alias("near_head"), of("head", False).alias("far_head"), of("own_head", False).alias("own_head"))

    def first_not_shown(hits, rank: str, after: str, head: Column, step=lambda at: at):
        """The first rank, with its place, that is not among the hits; ``step`` moves on from a rank that does not count."""
        runs = F.array_sort(F.transform(F.filter(hits, lambda n: n["rank"].isNotNull()), lambda n: F.struct(n[rank].alias("rank"), n[after].alias("after"))))
        return F.aggregate(runs, step(head), lambda at, n: F.when(n["rank"] == at["rank"], step(n["after"])).otherwise(at))["place"]

    def plain(at: Column):
        return F.struct(at["rank"].alias("rank"), at["place"].alias("place"))

    def away(at: Column):
        mine = at["hunk"] == F.col("hunk_index")
        return F.when(mine, at["leave"]).otherwise(plain(at))

    def numbered(after: str):
        return F.transform("far_hits", lambda n: n.withField(after, F.struct((n["own_rank"] + 1).alias("rank"), n[after].alias("place"))))

    own_hits = F.filter(numbered("own_after"), lambda n: n["hunk"] == F.col("hunk_index"))
    own_first = F.struct(F.lit(1).alias("rank"), F.col("own_head").alias("place"))
    return lines.withColumns({
        "near_plain": first_not_shown("near_hits", "rank", "after", F.col("near_head"), plain),
        "far_plain": F.least(first_not_shown("far_hits", "rank", "after", F.col("far_head"), away),
                             first_not_shown(own_hits, "own_rank", "own_after", own_first))})


def paired_hits(lines: DataFrame, rulesets: list[Ruleset], key="change_id") -> DataFrame:
    """Hits of the before/after rules: same hunk keeps the action, elsewhere one step down."""
    rules = paired_rules(rulesets)
    partners = paired_partners(lines, rulesets, key)

    def per_rule(make):
        return F.coalesce(*[F.when(F.col("rule") == i, make(fw, r)) for i, (fw, r) in enumerate(rules)])

    def stem(fw, rule):
        return F.when(F.col("same_hunk"), _stem(rule, SAME)).otherwise(_stem(rule, CROSS))

    def severity(fw, rule):
        return F.expr(f"if(same_hunk, {rule.severity}, {lower_sql(str(rule.severity))})")

    number = F.coalesce(F.concat(F.lit(":"), F.col("line_no").cast("string")), F.lit(""))
    partners = partners.withColumn("text", F.concat(per_rule(stem), number))
    shown = F.when(F.col("needle").isNull(), F.col("text")).otherwise(F.replace("text", F.col("needle"), F.lit("***")))
    order = F.shiftleft(F.col("minus_pos").cast("bigint"), 31) + F.col("pos")  # positions are below 2**31
    return partners.select(
        key, per_rule(lambda fw, r: F.lit(fw.fw_ord)).alias("fw_ord"), per_rule(lambda fw, r: F.lit(r.ord)).alias("rule_ord"),
        order.alias("ord"), per_rule(severity).alias("severity"), shown.alias("evidence"),
        "file", F.col("line_no").alias("line"))


def pair_summary(lines: DataFrame, key="change_id") -> DataFrame:
    """The pair relation without its pairs: per added line, how many removed lines it meets and the first."""
    rows = lines.where(F.col("side").isin("added", "removed")).select(key, "file", "hunk_index", "side", "pos", "line_no")
    removed = F.col("side") == "removed"
    hunk, file = Window.partitionBy(key, "file", "hunk_index"), Window.partitionBy(key, "file")
    return (rows.withColumns({
        "same_hunk": F.count_if(removed).over(hunk), "same_file": F.count_if(removed).over(file),
        "first_in_hunk": F.min(F.when(removed, F.col("pos"))).over(hunk),
        "first_in_file": F.min(F.when(removed, F.col("pos"))).over(file)})
        .where((F.col("side") == "added") & (F.col("same_file") > 0))
        .select(key, "file", "hunk_index", "pos", "line_no", "same_hunk", "same_file", "first_in_hunk", "first_in_file"))
