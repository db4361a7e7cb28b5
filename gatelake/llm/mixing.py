"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent and normalised. The exponent is bisected until the weights
reach a target entropy, or until no source is repeated more often than a limit. Each source then fills its part of the
token budget with permutations of its own rows: whole passes, and of the last pass as much as still fits. The rows of
a source lie in blocks by a hash; a pass is the blocks in order, so the row where the budget ends is found from the
sums of the blocks, then of that block's own blocks, and only rows of one such small block are ever ordered. The hash is
that of id and text; where the pass ends among rows equal in both, they are counted to the end.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored, words

TARGET_ENTROPY = 0.95   # of the entropy of equal weights
MAX_REPEATS = 3.0
BLOCK_DIGITS = 2        # hex digits of a block number: 256 blocks, each of 256 blocks
ROUNDS, SPLITS = 9, 32  # each round cuts the exponent's interval into so many parts, which is five bisections
SMALL = 10_000          # sources whose plan may be broadcast


def token_count(text: Column) -> Column:
    """Words of a text, the native measure of its tokens."""
    return F.size(words(text)).cast("long")


def shares_of(rows: DataFrame) -> DataFrame:
    """(source, tokens, share) of sources with tokens."""
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    total = sums.agg(F.sum("tokens").alias("total"))
    return stored(sums.join(F.broadcast(total)).select("source", "tokens", (F.col("tokens") / F.col("total")).alias("share")), "shares")


def weights_at(shares: DataFrame, exponent: Column) -> DataFrame:
    """shares with the normalised weight of every source at each exponent."""
    raised = shares.select("*", exponent.alias("exponent")).withColumn("raised", F.pow("share", "exponent"))
    sums = raised.groupBy("exponent").agg(F.sum("raised").alias("sum"))
    return raised.join(F.broadcast(sums), "exponent").select(  # one row per exponent tried
        "source", "tokens", "share", "exponent", (F.col("raised") / F.col("sum")).alias("weight"))


def exponent_for(shares: DataFrame, budget: int, target_entropy: float | None, max_repeats: float | None) -> float:
    """The smallest exponent in [0, 1] that keeps the limits, or 1 where none does.

    Entropy and repetition both fall as the exponent rises. With a target entropy the exponent rises from 0 until the
    entropy is down at the target; with a repetition limit until no source passes more often than that. With both the
    larger exponent holds.
    """
    low, high = 0.0, 1.0
    n = shares.count()
    met = F.lit(True)
    if target_entropy is not None:
        met = met & (F.col("entropy") <= F.lit(target_entropy) * F.log(F.lit(float(max(n, 1)))) + 1e-12)
    if max_repeats is not None:
        met = met & (F.col("repeats") <= max_repeats)
    for _ in range(ROUNDS):
        step = (high - low) / SPLITS
        tried = F.explode(F.array(*[F.lit(low + k * step) for k in range(SPLITS + 1)]))
        seen = weights_at(shares, tried).groupBy("exponent").agg(
            F.sum(-F.col("weight") * F.log("weight")).alias("entropy"), F.max(F.col("weight") * budget / F.col("tokens")).alias("repeats"))
        least = seen.where(met).agg(F.min("exponent")).first()[0]
        if least is None:
            return 1.0
        low, high = max(low, least - step), least
        if low == high:
            break
    return round(high, 9)


def _place(key: Column, level: int) -> Column:
    return F.substring(key, level * BLOCK_DIGITS + 1, BLOCK_DIGITS)


def _cut(rows: DataFrame, quota: DataFrame, level: int) -> DataFrame:
    """quota (source, left) with the block in which left tokens end and what is left for that block."""
    sums = rows.groupBy("source", _place(F.col("key"), level).alias("block")).agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy("source").orderBy("block")  # at most 16 ** BLOCK_DIGITS rows
    after = F.col("upto") > F.col("left")
    return sums.withColumn("upto", F.sum("tokens").over(upto)).join(quota, "source").groupBy("source").agg(
        F.min(F.when(after, F.struct("block", (F.col("left") - F.col("upto") + F.col("tokens")).alias("left")))).alias("cut"))


def mixed(docs: DataFrame, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS,
          budget: int | None = None, seed: int = 1, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """docs with draws: how often each row is passed in the mix; 0 where the last pass ends before it.

    The budget, in words, is that of docs unless named. A source gets floor(weight * budget). It may have to repeat;
    where even unchanged shares pass a limit the shares stay as they are. The null source is a source of its own. Rows
    without words cost nothing: they are drawn in every whole pass, and in the last one if they come before its end;
    sources without any words have weight 0 and their rows are drawn once. Rows equal in id and text have neighbouring
    places in a pass, any of them first. An empty table gives no rows. All columns are kept; draws and the others added
    here replace none.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"),
                         F.md5(F.coalesce(F.col(text_col), F.lit(""))))).alias("key")
    rows = stored(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0null")).alias("source"),
                              key, token_count(F.col(text_col)).alias("n_tokens")), "mix-rows")
    shares = shares_of(rows)
    total = int(shares.agg(F.sum("tokens")).first()[0] or 0)
    budget = total if budget is None else budget
    exponent = exponent_for(shares, budget, target_entropy, max_repeats)
    quota = stored(weights_at(shares, F.lit(exponent)).select(
        "source", "weight", "tokens", F.floor(F.round(F.col("weight"), 9) * budget).cast("long").alias("quota")).select(
        "source", "weight", F.floor(F.col("quota") / F.col("tokens")).cast("long").alias("passes"),
        (F.col("quota") % F.col("tokens")).alias("left")), "mix-quota")
    first = stored(_cut(rows, quota.select("source", "left"), 0), "mix-cut")
    near = rows.join(_small(first), "source").where(_place(F.col("key"), 0) == F.col("cut.block"))
    near = stored(near.select("source", "key", "n_tokens", F.col("cut.left").alias("left")), "mix-near")
    second = stored(_cut(near.drop("left"), first.select("source", F.col("cut.left").alias("left")), 1), "mix-cut")
    last = near.drop("left").join(_small(second), "source").where(_place(F.col("key"), 1) == F.col("cut.block"))
    # Rows of one small block, folded by key: ordered, then the first whose tokens no longer fit all ends the pass.
    folded = last.groupBy("source", "key").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("copies"), F.first("cut.left").alias("left"))
    inner = Window.partitionBy("source").orderBy("key")
    fit = F.floor((F.col("left") - F.col("upto") + F.col("n_tokens")) * F.col("copies") / F.col("n_tokens"))
    ends = folded.withColumn("upto", F.sum("n_tokens").over(inner)).where("upto > left").groupBy("source").agg(
        F.min(F.struct("key", fit.cast("long").alias("fit"))).alias("end"))
    plan = stored(quota.select("source", "weight", "passes").join(ends, "source", "left").select(
        "source", "weight", "passes", F.coalesce("end.key", F.lit("")).alias("end"), F.coalesce("end.fit", F.lit(0)).alias("fit")), "mix-plan")
    wide = docs.select(F.struct("*").alias("whole"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0null")).alias("source"),
                       key, token_count(F.col(text_col)).alias("n_tokens"))
    planned = wide.join(_small(plan), "source", "left")
    # Equal rows in which a pass ends are few unless a text is repeated much; numbered in slices, so they need not meet.
    tied = stored(planned.where((F.col("key") == F.col("end")) & (F.col("fit") > 0)).withColumn("row", F.monotonically_increasing_id()), "mix-ties")
    slices = tied.groupBy("source", F.shiftright("row", 33).alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    before = slices.select("source", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    local = F.col("row") - F.shiftleft("slice", 33)  # rows of a task are numbered from 0 without gaps
    ranked = tied.withColumn("slice", F.shiftright("row", 33)).join(_small(before), ["source", "slice"])
    out = ["whole", "source", "key", "n_tokens", "weight"]
    once_more = ranked.select(*out, (F.col("passes") + (F.col("before") + local < F.col("fit")).cast("long")).alias("draws"))
    untied = planned.where(~F.coalesce((F.col("key") == F.col("end")) & (F.col("fit") > 0), F.lit(False)))
    draws = F.coalesce(F.col("passes") + F.when(F.col("key") < F.col("end"), 1).otherwise(0), F.lit(1)).cast("long")
    return untied.select(*out, draws.alias("draws")).unionByName(once_more)


def _small(plan: DataFrame) -> DataFrame:
    """Broadcast if its counted rows are few; else joined as any table, hot sources split by the skew join."""
    return F.broadcast(plan) if plan.count() <= SMALL else plan


def draws(docs: DataFrame, **limits) -> DataFrame:
    """One row per row of docs: doc_id, source, n_tokens, weight (six decimals), draws."""
    return mixed(docs, **limits).select("whole.doc_id", "whole.source", "n_tokens", F.round("weight", 6).alias("weight"), "draws")


def mix(docs: DataFrame, **limits) -> DataFrame:
    """The mix itself: every row of docs as often as it is drawn, with the columns of docs."""
    rows = mixed(docs, **limits).where("draws > 0")
    return rows.select("whole", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws")))).select("whole.*")


#: The same rounds, each with the entropy and largest repetition of all exponents tried, then the draws by running sums.
QUERY_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, chr(0) || 'null') AS s, md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+'))::BIGINT AS n FROM documents),
sums AS (SELECT s, sum(n)::BIGINT AS tokens FROM d GROUP BY s HAVING sum(n) > 0),
p AS (SELECT list(tokens::DOUBLE / total) AS shares, any_value(total) AS total, count(*) AS k FROM sums, (SELECT sum(tokens)::DOUBLE AS total FROM sums)),
rounds AS (
  SELECT 0 AS r, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, false AS never
  UNION ALL
  SELECT r + 1, greatest(low, coalesce(found, 1.0) - (high - low) / {SPLITS}), coalesce(found, 1.0), found IS NULL
  FROM (SELECT r, low, high, list_min(list_filter([low + i * (high - low) / {SPLITS} for i in range(0, {SPLITS + 1})], lambda a:
      ln(list_sum([pow(x, a) for x in shares])) - list_sum([pow(x, a) * ln(pow(x, a)) for x in shares]) / list_sum([pow(x, a) for x in shares])
        <= {TARGET_ENTROPY} * ln(k) + 1e-12
      AND list_max([pow(x, a) / x for x in shares]) / list_sum([pow(x, a) for x in shares]) <= {MAX_REPEATS})) AS found
    FROM rounds, p WHERE r < {ROUNDS} AND NOT never AND low <> high)),
best AS (SELECT CASE WHEN never THEN 1.0 ELSE round(high, 9) END AS a FROM rounds ORDER BY r DESC LIMIT 1),
raised AS (SELECT s, tokens, pow(tokens / total, a) AS x, total FROM sums, p, best),
quota AS (SELECT s, tokens, x / sum(x) OVER () AS weight, floor(round(x / sum(x) OVER (), 9) * total)::BIGINT AS q FROM raised),
upto AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY key ROWS UNBOUNDED PRECEDING) AS u FROM d)
SELECT doc_id, source, n AS n_tokens, round(weight, 6) AS weight, coalesce(q // tokens + (u <= q % tokens)::INT, 1)::BIGINT AS draws
FROM upto LEFT JOIN quota USING (s)
"""
