"""Quality rules as a ledger of bits.

Every rule is evaluated once for every document; the ledger keeps the measurements and one bit for each rule that
failed. A policy is a versioned set of rules, that is a mask, so verdicts of any policy and ablations over its rules
need bitwise operations on the ledger and no text.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import BREAKS, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measurements, true where a document fails the rule. Its bit is its place in RULES."""
    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("capitals", "2 * n_capitals > word_chars"),
    Rule("exclamations", "2 * n_exclamations > n_words"),
)
BITS = {rule.name: 1 << i for i, rule in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[name] for name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STRICT = Policy("strict", 1, tuple(BITS))
POLICIES = (BASE, STRICT)


def _neighbours(ordered: Column, same) -> Column:
    """Elements of an ordered array that are the same as the one before or after them."""
    return let(ordered, lambda a: F.filter(a, lambda x, j: ((j > 0) & same(F.get(a, j - 1), x)) | F.coalesce(
        same(F.get(a, j + 1), x), F.lit(False))))


def repeated_words(found: Column) -> Column:
    """Words of the array that lie in a window of five words which occurs twice or more in it.

    Windows are found by hash. Only where two hashes agree are the words themselves compared.
    """
    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(keys: Column, whole: Column) -> Column:
        placed = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        agreeing = _neighbours(placed, lambda x, y: x["h"] == y["h"])
        texts = F.array_sort(F.transform(agreeing, lambda x: F.struct(F.slice(whole, x["i"] + 1, F.lit(WINDOW)).alias("g"), x["i"].alias("i"))))
        starts = F.array_sort(F.transform(_neighbours(texts, lambda x, y: x["g"] == y["g"]), lambda x: x["i"]))
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(starts, none, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
                           lambda a: a["n"])

    def counted(whole: Column) -> Column:
        keys = let(F.transform(whole, lambda w: F.xxhash64(w)), windows)
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k, whole)).otherwise(F.lit(0).cast("long")))

    return let(found, lambda whole: F.when(F.size(whole) > WINDOW, counted(whole)).otherwise(F.lit(0).cast("long")))


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with all measurements of every whole text, as longs; a null text is empty."""
    def without(chars: str) -> Column:
        return F.length(F.translate("text", chars, ""))

    def lines(chosen: Column) -> Column:
        return let(chosen, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup")))

    chars = F.length("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", words(F.col("text")).alias("words"),
                       lines(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).alias("lines"))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), without(BREAKS).cast("long").alias("word_chars"),
                       (chars - without(SYMBOLS)).cast("long").alias("n_symbols"), F.col("lines.dup").alias("n_dup_lines"),
                       repeated_words(F.col("words")).alias("n_repeat_words"), F.col("lines.n").alias("n_lines"),
                       (chars - without(CAPITALS)).cast("long").alias("n_capitals"), (chars - without("!")).cast("long").alias("n_exclamations"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the measurements and fail_bits, with bit i set where RULES[i] fails.

    Null and empty texts have no words and fail few_words. Null and repeated ids stay as they are; an empty table
    gives no rows; other columns are not read.
    """
    bits = [F.when(F.expr(rule.fails), BITS[rule.name]).otherwise(0) for rule in RULES]
    return measurements(docs, id_col, text_col).withColumn("fail_bits", sum(bits[1:], bits[0]).cast("long"))


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def verdicts(rows: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """A ledger with base_failed (any rule of BASE) and kept (no rule of BASE nor of policy)."""
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE)).alias("base_failed"),
                       (passes(BASE) & passes(policy)).alias("kept"), "fail_bits")


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """(policy, version, rule, failed, dropped, only, dropped_without) for every rule of every policy over a ledger.

    failed: rows that fail the rule; dropped: rows that the policy drops; only: rows dropped by this rule alone;
    dropped_without: rows that the policy without the rule drops. The ledger is folded to one row for each pattern of
    bits first, of which there are 2 ** len(RULES) at most.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*[F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"),
                               F.lit(p.mask).cast("long").alias("mask"), F.lit(BITS[r]).cast("long").alias("bit")) for p in policies for r in p.rules])
    each = patterns.select("fail_bits", "n", F.inline(cases))
    bits = F.col("fail_bits")

    def rows_where(case: Column) -> Column:
        return F.sum(F.when(case, F.col("n")).otherwise(0))

    return each.groupBy("policy", "version", "rule").agg(
        rows_where(bits.bitwiseAND(F.col("bit")) != 0).alias("failed"), rows_where(bits.bitwiseAND(F.col("mask")) != 0).alias("dropped"),
        rows_where(bits.bitwiseAND(F.col("mask")) == F.col("bit")).alias("only"),
        rows_where(bits.bitwiseAND(F.col("mask") - F.col("bit")) != 0).alias("dropped_without"))


QUERY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) x(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 5)) y(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[ \x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \x09-\x0D]')) AS lines, coalesce(n, 0) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, length(t) - length(replace(t, '!', '')) AS n_exclamations
  FROM d LEFT JOIN repeated USING (doc_id)),
k AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines FROM m),
b AS (SELECT *, (n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
        + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT
        + 32 * (2 * n_capitals > word_chars)::INT + 64 * (2 * n_exclamations > n_words)::INT AS fail_bits FROM k)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM b
"""
