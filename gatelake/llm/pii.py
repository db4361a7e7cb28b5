"""Personal data by weak supervision.

Patterns propose spans: those of the base definition, and wider ones (numbers that fail a check, telephone numbers
without a plus, spelt-out addresses). Labelers vote on every proposal: a checksum or range labeler, gazetteers
(domains, card issuers, calling codes), context labelers (words before the span, signs beside it) and the base pattern
itself. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is and so how
likely each pattern is personal data; a logistic span classifier is trained on these soft labels. Base spans always
stay; a wider proposal is added where the classifier is sure and a context labeler agrees.

Only counts of patterns reach the driver: 4 kinds x 3 votes by 5 labelers, and as many feature patterns.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, stored

KINDS = ("email", "ip", "card", "phone")
SURE = 0.9
EM_ROUNDS, FIT_ROUNDS = 50, 200
CONTEXT = 40     # code points before a span that the context labeler reads
_BLOCK = 256

# The patterns give the same matches as their plain forms, with no backtracking into what they have read and no start
# inside a run that was tried from its beginning; so long runs take linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WIDE_PHONE = r"(?<![\w+.-])\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![\w-])"
WIDE_EMAIL = r"(?<![\w.])[A-Za-z0-9_%-]{1,64}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]{1,64}){1,8}+"
#: kind, pattern, SQL over text that is true wherever the pattern may match.
SOURCES = (
    (0, EMAIL, "contains(text, '@')"),
    (1, IP, "text rlike '[0-9][.][0-9]'"),
    (2, CARD, "text rlike '[0-9][ -]?[0-9]'"),
    (3, PHONE, "contains(text, '+')"),
    (0, WIDE_EMAIL, "contains(text, 'at]') or contains(text, 'at)')"),
    (3, WIDE_PHONE, "text rlike '[0-9][)]?[ ./-][0-9]{3}'"),
)
WIDE = 4  # SOURCES from here on are no base patterns

# Gazetteers and cue words: chosen lists, extend as needed.
DOMAINS = "com org net edu gov info biz io eu de fr es uk us ca ch at nl it pl se example".split()
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|35|6011|65|62)"
CALLING = r"^(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = (
    r"\b(e-?mail|mail|contact|write|kontakt|courriel|correo|escriba|contacto)\b",
    r"\b(ip|host|server|client|address|adresse|serveur|servidor|login|from)\b",
    r"\b(card|credit|visa|mastercard|amex|karte|kreditkarte|carte|tarjeta|payment)\b",
    r"\b(phone|tel|telephone|call|mobile|fax|cell|telefon|anruf|handy|téléphone|appel|teléfono|llame|móvil)\b",
)
AGAINST = r"\b(version|isbn|issn|order|invoice|serial|sha|md5|hash|commit|build|ref|rechnung|facture|factura)\b"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(total: Column, c: Column, i: Column) -> Column:
        doubled = c.cast("int") * (1 + i % 2)
        return total + doubled - F.when(doubled > 9, 9).otherwise(0)

    signs = F.split(F.reverse(digits), "")
    pairs = F.transform(signs, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), lambda a, x: add(a, x["c"], x["i"])) % 10 == 0


def valid(kind: int, match: Column) -> Column:
    """The check of the base definition on a match of its pattern."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return match.rlike(r"^(0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.|$)){4}$")
    digits = _digits(match)
    if kind == 2:
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: int, wide: bool, match: Column, before: Column, after: Column) -> list[Column]:
    """Votes 1, 0 or -1 of the base, check, gazetteer, context and neighbour labelers."""
    digits = _digits(match)
    base = F.lit(0) if wide else F.lit(1) if kind == 0 else _vote(valid(kind, match), ~valid(kind, match))
    if kind == 0:
        last = F.lower(F.regexp_extract(match, "([A-Za-z0-9-]+)$", 1))
        check, known = _vote(last.rlike("^[a-z]{2,}$"), ~last.rlike("[a-z]")), last.isin(DOMAINS)
        gazetteer = _vote(known, F.lit(False))
    elif kind == 1:
        check = _vote(valid(1, match), ~valid(1, match))
        gazetteer = _vote(F.lit(False), match.rlike(r"^0+\.|^255\."))
    elif kind == 2:
        right = F.length(digits).between(13, 19) & luhn(digits)
        check, gazetteer = _vote(right, ~right), _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS))
    else:
        right = F.length(digits).between(9, 15)
        check = _vote(right, ~right)
        gazetteer = F.lit(0) if wide else _vote(digits.rlike(CALLING), ~digits.rlike(CALLING))
    near = F.lower(F.right(before, F.lit(CONTEXT)))
    context = _vote(near.rlike(CUES[kind]), near.rlike(AGAINST))
    beside = _vote(F.lit(False), F.right(before, F.lit(1)).rlike(r"[\w#=]") | F.left(after, F.lit(1)).rlike(r"\w"))
    return [base, check, gazetteer, context, beside]


def features(match: Column, before: Column) -> Column:
    """Bits that the span classifier sees besides the kind: signs in the match, its length, cue words, line position."""
    near = F.lower(F.right(before, F.lit(CONTEXT)))
    seen = [match.rlike("[ ()/-]"), match.contains("."), F.length(match) > 12, F.length(match) > 18, near.rlike("|".join(CUES)),
            near.rlike(AGAINST), near.rlike(r"[:=]\s*$"), (before == "") | before.endswith("\n")]
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(seen)), F.lit(0))


N_FEATURES, N_LABELERS = 8, 5


def _starts(lengths: Column) -> Column:
    """Sums of all earlier elements, in blocks so that no array is copied once per element."""
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def summed(a: Column, blocks: Column) -> Column:
        return F.transform(a, lambda _, i: total(F.slice(blocks, F.lit(1), F.floor(i / _BLOCK).cast("int")))
                           + total(F.slice(a, (F.floor(i / _BLOCK) * _BLOCK + 1).cast("int"), i % _BLOCK)))

    return let(lengths, lambda a: let(F.transform(
        F.sequence(F.lit(0), F.floor(F.size(a) / _BLOCK).cast("int")), lambda b: total(F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)))),
        lambda blocks: summed(a, blocks)))


def _proposals(kind: int, pattern: str, may: str, wide: bool) -> Column:
    """Array of (kind, start, end, base, votes, features) for the matches of one pattern; offsets in code points."""
    text = F.col("text")
    quoted = F.lit(pattern)

    def spans(pieces: Column, matches: Column) -> Column:
        lengths = F.transform(matches, lambda m, i: (F.length(F.get(pieces, i)) + F.length(m)).cast("long"))
        at = _starts(lengths)
        return F.transform(F.arrays_zip(matches.alias("m"), at.alias("a")), lambda x, i: F.struct(
            x["m"].alias("m"), (x["a"] + F.length(F.get(pieces, i))).alias("start"), F.get(pieces, i).alias("before"), F.get(pieces, i + 1).alias("after")))

    def judged(x: Column) -> Column:
        base = F.lit(False) if wide else valid(kind, x["m"])
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), base.alias("base"),
                        F.array(*votes(kind, wide, x["m"], x["before"], x["after"])).alias("votes"), features(x["m"], x["before"]).alias("features"))

    found = let(F.split(text, pattern, -1), lambda p: let(F.regexp_extract_all(text, quoted, F.lit(0)), lambda m: spans(p, m)))
    if kind == 2:  # short digit runs are no proposals
        found = F.filter(found, lambda x: F.length(_digits(x["m"])).between(13, 19))
    none = F.expr("cast(array() as array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:array<int>,features:int>>)")
    return F.when(F.expr(may), F.transform(found, judged)).otherwise(none)


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) with all proposals of every whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("doc_id", F.concat(*[_proposals(k, p, may, i >= WIDE) for i, (k, p, may) in enumerate(SOURCES)]).alias("spans"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]]) -> dict[tuple[int, tuple[int, ...]], float]:
    """Expectation-maximisation: from (kind, votes, count) the probability of each vote pattern to be personal data.

    A labeler has, for each kind, a chance to vote 1, 0 or -1 on personal data and on other spans; votes are
    independent given the truth. Starts from the share of agreeing votes; counts are smoothed by one.
    """
    truth = {(k, v): min(0.95, max(0.05, 0.5 + 0.45 * sum(v) / max(1, sum(map(abs, v))))) for k, v, _ in patterns}
    for _ in range(EM_ROUNDS):
        seen: dict[tuple, float] = {}
        for k, v, n in patterns:
            for y, p in ((1, truth[k, v]), (0, 1 - truth[k, v])):
                seen[k, y] = seen.get((k, y), 1.0) + n * p
                for labeler, vote in enumerate(v):
                    seen[k, y, labeler, vote] = seen.get((k, y, labeler, vote), 1.0) + n * p
        for k, v, _ in patterns:
            odds = math.log(seen[k, 1]) - math.log(seen[k, 0])
            for labeler, vote in enumerate(v):
                odds += math.log(seen[k, 1, labeler, vote] / (seen[k, 1] + 2)) - math.log(seen[k, 0, labeler, vote] / (seen[k, 0] + 2))
            truth[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return truth


def fitted(rows: list[tuple[int, tuple[int, ...], int, int, float]]) -> list[float]:
    """Weights of a logistic classifier from (kind, votes, features, count, probability), by gradient steps.

    Inputs are the kind, the feature bits and the votes of all labelers but the base pattern.
    """
    cases = [([int(k == i) for i in range(4)] + [f >> i & 1 for i in range(N_FEATURES)] + list(v[1:]), n, p) for k, v, f, n, p in rows]
    weights = [0.0] * (4 + N_FEATURES + N_LABELERS - 1)
    total = sum(n for _, n, _ in cases) or 1
    for _ in range(FIT_ROUNDS):
        slope = [1e-3 * w for w in weights]
        for x, n, p in cases:
            miss = n / total * (1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x, strict=True)))) - p)
            for i, a in enumerate(x):
                slope[i] += miss * a
        weights = [w - 2.0 * s for w, s in zip(weights, slope, strict=True)]
    return weights


def trained(found: DataFrame) -> list[float]:
    """Classifier weights from all proposals; only counts by pattern leave the executors."""
    counts = found.select(F.inline("spans")).groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")).collect()
    by_votes: dict[tuple[int, tuple[int, ...]], int] = {}
    for r in counts:
        by_votes[r.kind, tuple(r.votes)] = by_votes.get((r.kind, tuple(r.votes)), 0) + r.n
    truth = reliabilities(sorted((k, v, n) for (k, v), n in by_votes.items()))
    return fitted(sorted((r.kind, tuple(r.votes), r.features, r.n, truth[r.kind, tuple(r.votes)]) for r in counts))


def score(span: Column, weights: list[float]) -> Column:
    inputs = [F.when(span["kind"] == i, 1).otherwise(0) for i in range(4)]
    inputs += [F.shiftright(span["features"], i).bitwiseAND(1) for i in range(N_FEATURES)]
    inputs += [F.get(span["votes"], F.lit(i)) for i in range(1, N_LABELERS)]
    odds = sum((F.lit(w) * x for w, x in zip(weights, inputs, strict=True)), F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and spans, an array of (kind, start, end, base) by kind, then start.

    A null text has no spans. Offsets are code points, end exclusive. A wide proposal that overlaps a base span is
    never added. Null and repeated ids stay as they are; an empty table gives no rows; other columns are not read.
    """
    found = stored(proposals(docs, id_col, text_col), "proposals")
    weights = trained(found)

    def chosen(spans: Column) -> Column:
        base = F.filter(spans, lambda x: x["base"])
        sure = F.filter(spans, lambda x: ~x["base"] & (F.get(x["votes"], F.lit(3)) > 0) & (score(x, weights) >= SURE))
        more = let(base, lambda b: F.filter(sure, lambda x: ~F.exists(b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))))
        return F.array_sort(F.transform(F.concat(base, more), lambda x: F.struct(
            x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"))))

    return found.select("doc_id", let(F.col("spans"), chosen).alias("spans"))


def private_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans as kind:start:end, joined by commas."""
    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of_kind(k: int):
        return lambda x: x["kind"] == k

    rows = find_private(docs, id_col, text_col).select("doc_id", "spans", F.filter("spans", lambda x: x["base"]).alias("base"))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
