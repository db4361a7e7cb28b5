"""Masking and text shaping; the raw value never survives into the output."""
from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import UNSAFE_IN_PATH, UNSAFE_IN_RULE_ID, URL_SCHEME
from .patterns import SPACE, js_trim, trimmed_sql
from .text import quoted, replaced

ELLIPSIS = "…"
TLD = r"\.([^.]+)\z"


def clip(value: Column, limit: int, mark: str = ELLIPSIS, keep: int | None = None) -> Column:
    """At most ``limit`` characters; a longer text keeps ``keep`` (default ``limit``) and a mark."""
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit if keep is None else keep),
                                                    F.lit(mark))).otherwise(value)


def mask_generic(value: Column) -> Column:
    shown = js_trim(value)
    return F.when(F.length(shown) > 1, F.concat(F.substring(shown, 1, 1), F.lit("***"))).otherwise("***")


def mask_email(value: Column) -> Column:
    at = F.locate("@", value)
    tld = F.regexp_extract(F.substr(value, at + 1), TLD, 1)
    masked = F.concat(F.substring(value, 1, 1), F.lit("***@***"),
                      F.when(tld != "", F.concat(F.lit("."), tld)).otherwise(""))
    return F.when((at > 1) & (at < F.length(value)), masked).otherwise(mask_generic(value))


def _flat(value: Column) -> Column:
    return js_trim(F.regexp_replace(F.regexp_replace(value, r"[\r\n\t]+", " "), r"[|`]", " "))


def _bounded(flat: Column) -> Column:
    return F.when(F.coalesce(flat, F.lit("")) == "", "***").otherwise(flat)


def safe_label(value: Column) -> Column:
    """One line with no table or code-span delimiters, never empty."""
    return _bounded(_flat(value))


def literal_label(text: str) -> str:
    """``safe_label`` of a rule's own text, settled before the query is built."""
    flat = re.sub(r"[|`]", " ", re.sub(r"[\r\n\t]+", " ", text)).strip()
    return flat or "***"


def literal_path(path: str) -> str:
    """``safe_path`` of a rule's own glob."""
    kept = "".join(c if unicodedata.category(c)[0] in "LN" or c in "._/@+-" else "_" for c in path)
    return f"`{kept}`"


def literal_rule_id(rule_id: str) -> str:
    """``safe_rule_id`` of a rule's own id."""
    return re.sub(UNSAFE_IN_RULE_ID, "_", rule_id)


def location(file: Column, line: Column | None = None) -> Column:
    base = safe_label(file)
    if line is None:
        return base
    return F.when(line.isNull(), base).otherwise(F.concat(base, F.lit(":"), line.cast("string")))


def hide(text: Column, raw: Column) -> Column:
    """Star every occurrence of the trimmed raw value."""
    needle = js_trim(raw)
    return F.when(needle != "", F.replace(text, needle, F.lit("***"))).otherwise(text)


def evidence(label: Column, raw: Column, file: Column, line: Column | None = None) -> Column:
    return hide(F.concat(safe_label(label), F.lit(" @ "), location(file, line)), raw)


def _flat_sql(value: str) -> str:
    return trimmed_sql(replaced(replaced(value, r"[\r\n\t]+", " "), r"[|`]", " "))


def _bounded_sql(flat: str) -> str:
    return f"if(coalesce({flat}, '') = '', '***', {flat})"


def with_evidence(hits: DataFrame, fixed_file: str | None = None) -> DataFrame:
    """Replace (mask, value, is_token) by the masked evidence string.

    Built column by column, so no intermediate is evaluated twice.
    """
    kept = [c for c in hits.columns if c not in ("value", "mask", "is_token", "line_no")]
    tld = f"nullif(regexp_extract(substr(value, instr(value, '@') + 1), {quoted(TLD)}, 1), '')"
    mail = f"concat(substr(value, 1, 1), '***@***', coalesce(concat('.', {tld}), ''))"
    masked = (f"case when instr(value, '@') between 2 and length(value) - 1 then {mail} "
              f"when length({trimmed_sql('value')}) > 1 then concat(substr({trimmed_sql('value')}, 1, 1), '***') else '***' end")
    label = ("case when is_token then concat(mask, ':', value) "
             f"when contains(value, '@') and contains(value, '.') then concat(mask, ' (', {masked}, ')') else mask end")
    label = "mask" if fixed_file is not None else label
    file = quoted(fixed_file) if fixed_file else _flat_sql("file")
    hits = hits.selectExpr(*kept, "line_no", f"{_flat_sql(label)} as _label", f"{trimmed_sql('value')} as _needle", f"{file} as _file")
    hits = hits.selectExpr(*kept, "_needle", f"concat({_bounded_sql('_label')}, ' @ ', {_bounded_sql('_file')}, "
                           "coalesce(concat(':', string(line_no)), '')) as _text")
    return hits.selectExpr(*kept, "if(_needle <> '', replace(_text, _needle, '***'), _text) as evidence")


def group_digits(value: Column) -> Column:
    """Split runs of eight or more digits after the first `` @ `` into fours."""
    cut = F.locate(" @ ", value)
    grouped = F.regexp_replace(F.substr(value, cut + 3),
                               r"(?:(?<![0-9])(?=[0-9]{8})|(?<=[0-9])\G)([0-9]{4})(?=[0-9])", "$1·")
    return F.when(cut > 0, F.concat(F.substr(value, F.lit(1), cut + 2), grouped)).otherwise(value)


def safe_path(path: Column) -> Column:
    """A path as a code span with nothing markdown gives meaning to."""
    return F.concat(F.lit("`"), F.regexp_replace(path, UNSAFE_IN_PATH, "_"), F.lit("`"))


def safe_rule_id(rule_id: Column) -> Column:
    return F.regexp_replace(rule_id, UNSAFE_IN_RULE_ID, "_")


def markdown_cell(value: Column) -> Column:
    flat = F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")
    escaped = F.replace(F.replace(flat, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return js_trim(escaped)


def code_span(value: Column) -> Column:
    flat = js_trim(F.regexp_replace(F.regexp_replace(value, r"[`\r\n]+", " "), f"[{SPACE}]+", " "))
    shown = F.replace(flat, F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("`"), F.when(shown == "", " ").otherwise(shown), F.lit("`"))


def scrub_urls(message: Column) -> Column:
    """Drop credentials from URLs."""
    pattern = rf"{URL_SCHEME}[^{SPACE}/@'\"]+@"
    return F.regexp_replace(message, pattern, "$1")


def relative_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\A(?:\./+|/+)+", "")


def clamp_text(value: Column, chars: int | None = None) -> Column:
    """The first ``chars`` characters where the caller names a limit."""
    return value if chars is None else F.substring(value, 1, chars)


def clamp_list(values: Column, items: int | None = None, chars: int | None = None) -> Column:
    kept = values if items is None else F.slice(values, 1, items)
    return kept if chars is None else F.transform(kept, lambda v: clamp_text(v, chars))
