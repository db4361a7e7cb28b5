"""Checksum candidates inside a match: whole value first, then contiguous token runs."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import CANDIDATE_MAX_LEN, CANDIDATE_MIN_LEN, DAYS_IN_MONTH
from ..functions import checksums
from ..functions.checksums import compact_sql, digits_sql
from ..functions.patterns import SPACE, count_groups
from ..functions.text import applied, once, quoted

# --- fixed value: a date with an optional hour ----------------------------------------------
DATE = rf"([0-9]{{4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}})(?:[T{SPACE}-]+([0-9]{{1,2}}))?"

_NONE = "cast(array() as array<string>)"


def is_date_sql(value: str) -> str:
    """All digits of the value form one real calendar date with an optional hour."""
    days = "array(" + ", ".join(str(29 if m == 1 else d) for m, d in enumerate(DAYS_IN_MONTH)) + ")"
    whole, _, month, day, hour = (f"regexp_extract({value}, {quoted(DATE)}, {i})" for i in range(5))
    real = (f"try_cast({day} as int) between 1 and get({days}, try_cast({month} as int) - 1) "
            f"and ({hour} = '' or try_cast({hour} as int) <= 23)")
    return f"({whole} <> '' and {digits_sql(whole)} = {digits_sql(value)} and coalesce({real}, false))"


def token_runs_sql(value: str) -> str:
    """Runs of tokens joined by one space, in (start, length) order, that could hold an identifier.

    A token adds a character to the identifier unless it is hyphens alone, which bounds the tokens of a run.
    """
    tokens = (f"if(length({digits_sql(value)}) >= 2, filter(split({value}, {quoted(f'[{SPACE}]+')}), tok -> tok <> ''), {_NONE})")
    most = f"{CANDIDATE_MAX_LEN} + size(filter(toks, t -> replace(t, '-', '') = ''))"
    runs = (f"if(size(toks) >= 2, flatten(transform(sequence(1, size(toks)), s -> "
            f"transform(sequence(1, least({most}, size(toks) - s + 1)), n -> array_join(slice(toks, s, n), ' ')))), {_NONE})")
    return (f"filter(flatten(transform(array({tokens}), toks -> {runs})), run -> "
            f"length({compact_sql('run')}) between {CANDIDATE_MIN_LEN} and {CANDIDATE_MAX_LEN} and length({digits_sql('run')}) >= 2)")


def first_passing_sql(validators, value: str, cut: str) -> str:
    """The first candidate that validates; dates cut short by a time are skipped.

    The same candidates in the same order as the value and its ``token_runs_sql``, but no run is built to be tested:
    from each token on, one pass carries the digits and the compact form over the token ends and stops at a hit. What
    only reads digits is not asked again while further tokens bring none. ``value`` and ``cut`` are bound outside, so
    the names bound in here end in an underscore.
    """
    run = "array_join(slice(all_.t, from_, next_.n), ' ')"
    by_digits, others = checksums.valid_parts_sql(validators, "next_.d", "next_.c", run)
    none, state = "cast(null as string)", "named_struct('n', {n}, 'c', {c}, 'd', {d}, 'bad', {bad}, 'hit', {hit})"
    fits = f"length(next_.c) between {CANDIDATE_MIN_LEN} and {CANDIDATE_MAX_LEN} and length(next_.d) >= 2"
    judged = f"named_struct('n', next_.n, 'c', next_.c, 'd', next_.d, 'good', {fits} and next_.d <> now_.bad and {by_digits}, 'other', {fits} and {others})"
    hit = f"if((next_.good or next_.other) and not ({cut} and {is_date_sql(run)}), {run}, {none})"
    after = state.format(n="next_.n", c="next_.c", d="next_.d", bad=f"if({fits} and not next_.good, next_.d, now_.bad)", hit=hit)
    longer = "named_struct('n', now_.n + 1, 'c', concat(now_.c, token_.c), 'd', concat(now_.d, token_.d))"
    step = (f"if(now_.hit is not null or length(now_.c) > {CANDIDATE_MAX_LEN}, now_, "
            f"get(transform(transform(array({longer}), next_ -> {judged}), next_ -> {after}), 0))")
    begin = state.format(n="0", c="''", d="''", bad="''", hit=none)
    most = f"{CANDIDATE_MAX_LEN} + size(filter(all_, token_ -> token_.c = ''))"
    here = f"aggregate(slice(all_, from_, {most}), {begin}, (now_, token_) -> {step}, now_ -> now_.hit)"
    tokens = (f"transform(filter(split({value}, {quoted(f'[{SPACE}]+')}), token_ -> token_ <> ''), "
              f"token_ -> named_struct('t', token_, 'c', {compact_sql('token_')}, 'd', {digits_sql('token_')}))")
    runs = (f"get(transform(array({tokens}), all_ -> if(size(all_) >= 2, aggregate(sequence(1, size(all_)), {none}, "
            f"(hit_, from_) -> if(hit_ is not null, hit_, {here})), {none})), 0)")
    # No run has more digits than the value, and a run has two at least.
    enough = f"length({digits_sql(value)}) >= {max(2, checksums.least_digits(validators))}"
    whole = f"{checksums.any_valid_sql(validators, value)} and not ({cut} and {is_date_sql(value)})"
    return f"if({whole}, {value}, if({enough}, {runs}, {none}))"


def matches_sql(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {quoted(pattern)}, 0)"


def matches_with_cut_sql(text: str, pattern: str) -> str:
    """Matches with whether a ``:digit`` follows each: ARRAY<STRUCT<value, ord, cut>>.

    The look-ahead captures what follows without moving the match, and its group comes
    after the pattern's own groups, so back-references keep their numbers.
    """
    followed = f"regexp_extract_all({text}, {quoted(f'(?:{pattern})(?=(:[0-9])?)')}, {count_groups(pattern) + 1})"
    cuts = f"if({text} rlike ':[0-9]', {followed}, {_NONE})"
    return (f"transform(arrays_zip({matches_sql(text, pattern)}, {cuts}), (z, i) -> named_struct("
            "'value', z.`0`, 'ord', bigint(i), 'cut', coalesce(z.`1`, '') <> ''))")


def token_runs(value: Column) -> Column:
    return applied(value, "v", token_runs_sql("v"))


def candidates(value: Column) -> Column:
    """Everything offered to the validators, in the order tried."""
    return F.array_distinct(F.concat(F.array(value), token_runs(value)))


def first_passing(validators, value: Column, cut: Column | None = None) -> Column:
    pair = F.struct(value.alias("value"), (F.lit(False) if cut is None else cut).alias("cut"))
    return applied(pair, "p", first_passing_sql(validators, "p.value", "p.cut"))


def is_date(value: Column) -> Column:
    return once(value, "v", is_date_sql("v"))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def matches_with_cut(text: Column, pattern: str) -> Column:
    return applied(text, "t", matches_with_cut_sql("t", pattern))
