"""Checksum identifiers, and the registry of validator names.

Each validator is a SQL condition on a value; the functions below offer them as Columns.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import (BBAN_MOD97, BBAN_RIB, BBAN_SUMS, CARD_LENGTHS, CARD_NO_LUHN, CARD_RANGES, DAYS_IN_MONTH, ES_ACCOUNT_WEIGHTS,
                         ES_BANK_WEIGHTS, IBAN_BBAN, RIB_DIGITS, RIB_LETTERS, SVNR_WEIGHTS)
from .patterns import SPACE
from .text import all_of, any_of, applied, found, once, quoted, replaced


def digits_sql(value: str) -> str:
    return replaced(value, "[^0-9]")


def compact_sql(value: str) -> str:
    """Without the separators identifiers are grouped by."""
    return replaced(value, f"[{SPACE}-]")


def _bban_regex(structure: str) -> str:
    classes = {"n": "[0-9]", "a": "[A-Z]", "c": "[A-Z0-9]"}
    out, count = [], ""
    for ch in structure:
        if ch.isdigit():
            count += ch
        else:
            out.append(f"{classes[ch]}{{{count}}}")
            count = ""
    return "".join(out)


IBAN_REGEX = r"\A(?:" + "|".join(f"{cc}[0-9]{{2}}{_bban_regex(s)}" for cc, s in IBAN_BBAN.items()) + r")\z"

# The issuer table as one constant, longest prefix first (ties: table order).
_ISSUERS = "array(" + ", ".join(
    f"named_struct('network', '{network}', 'digits', {len(low)}, 'low', '{low}', 'high', '{high}', "
    f"'lengths', array({', '.join(map(str, CARD_LENGTHS[network]))}), 'no_luhn', {str(network in CARD_NO_LUHN).lower()})"
    for network, low, high in sorted(CARD_RANGES, key=lambda r: -len(r[1]))) + ")"
_DAYS = "array(" + ", ".join(map(str, DAYS_IN_MONTH)) + ")"


def _issuer(digits: str) -> str:
    """The longest matching issuer range of a digit string, as an array of at most one row."""
    return f"slice(filter({_ISSUERS}, issuer -> substr({digits}, 1, issuer.digits) between issuer.low and issuer.high), 1, 1)"


def _over_digits(value: str, test) -> str:
    """A test on the digits of a value."""
    return f"exists(array({digits_sql(value)}), digits -> {test('digits')})"


def _weighted(bban: str, first: int, weights) -> str:
    """Weighted sum of the digits from a place on."""
    terms = f"transform(array({', '.join(map(str, weights))}), (weight, i) -> int(substr({bban}, {first} + i, 1)) * weight)"
    return f"aggregate({terms}, 0, (total, term) -> total + term)"


def _modulo_11_10(digits: str) -> str:
    """ISO 7064 mod 11,10 over a number and its check digit."""
    step = "if((int(d) + product) % 10 = 0, 10, (int(d) + product) % 10) * 2 % 11"
    product = f"aggregate(filter(split(left({digits}, length({digits}) - 1), ''), d -> d <> ''), 10, (product, d) -> {step})"
    return f"(11 - {product}) % 10 = int(right({digits}, 1))"


def _spanish(bban: str, first: int, weights, check: int) -> str:
    rest = f"11 - {_weighted(bban, first, weights)} % 11"
    return f"exists(array({rest}), rest -> if(rest >= 10, 11 - rest, rest) = int(substr({bban}, {check}, 1)))"


def _national_sql(country: str, bban: str) -> str:
    """Check digits inside the account number, for the countries that define them; others pass."""
    tests = {cc: all_of(f"{_weighted(bban, first, weights)} % {m} = 0" for first, weights, m in sums) for cc, sums in BBAN_SUMS.items()}
    numeric = f"coalesce(try_cast({bban} as decimal(38,0)) % 97 = 1, false)"
    tests |= {cc: numeric for cc in BBAN_MOD97}
    tests |= {cc: f"cast(translate({bban}, {quoted(RIB_LETTERS)}, {quoted(RIB_DIGITS)}) as decimal(38,0)) % 97 = 0" for cc in BBAN_RIB}
    tests |= {
        "BE": f"(cast(left({bban}, 10) as bigint) - 1) % 97 + 1 = int(right({bban}, 2))",
        "ES": all_of([_spanish(bban, 1, ES_BANK_WEIGHTS, 9), _spanish(bban, 11, ES_ACCOUNT_WEIGHTS, 10)]),
        "FI": f"luhn_check({bban})",
        "HR": all_of([_modulo_11_10(f"left({bban}, 7)"), _modulo_11_10(f"right({bban}, 10)")]),
    }
    return f"case {country} {' '.join(f'when {quoted(cc)} then {test}' for cc, test in tests.items())} else true end"


def _iban_compact(value: str) -> str:
    remainder = ("aggregate(split(concat(substr(norm, 5), substr(norm, 1, 4)), ''), 0, (acc, ch) -> if(ch = '', acc, "
                 "(acc * if(ch between '0' and '9', 10, 100) + int(conv(ch, 36, 10))) % 97))")
    national = f"exists(array(substr(norm, 5)), bban -> {_national_sql('left(norm, 2)', 'bban')})"
    return f"exists(array(upper({value})), norm -> {found('norm', IBAN_REGEX)} and {remainder} = 1 and {national})"


def iban_sql(value: str) -> str:
    """Registry country, length and BBAN structure, ISO 7064 mod 97, and check digits inside the account number."""
    return _iban_compact(compact_sql(value))


def _card_digits(digits: str) -> str:
    return (f"(length({digits}) between 12 and 19 and exists({_issuer(digits)}, best -> "
            f"array_contains(best.lengths, length({digits})) and (best.no_luhn or luhn_check({digits}))))")


def credit_card_sql(value: str) -> str:
    """12-19 digits, a known issuer with that length, and Luhn (not asked of UnionPay)."""
    return _over_digits(value, _card_digits)


def _svnr_digits(digits: str) -> str:
    total = " + ".join(f"int(substr({digits}, {i + 1}, 1)) * {w}" for i, w in enumerate(SVNR_WEIGHTS) if w)
    day, month, year = (f"int(substr({digits}, {p}, 2))" for p in (5, 7, 9))
    real = (f"{month} between 1 and 12 and {day} >= 1 and ({day} <= get({_DAYS}, {month} - 1) "
            f"or ({month} = 2 and {day} = 29 and {year} % 4 = 0))")
    return f"(length({digits}) = 10 and coalesce(({total}) % 11 = int(substr({digits}, 4, 1)) and {real}, false))"


def svnr_sql(value: str) -> str:
    """Austrian social insurance number: weighted mod 11 and a real DDMMYY.

    Two-digit years are read in both centuries, so only a year divisible by four has a leap day.
    """
    return _over_digits(value, _svnr_digits)


def _steuer_digits(digits: str) -> str:
    step = "if((int(d) + product) % 10 = 0, 10, (int(d) + product) % 10) * 2 % 11"
    product = f"aggregate(filter(split(substr({digits}, 1, 10), ''), d -> d <> ''), 10, (product, d) -> {step})"
    return (f"(length({digits}) = 11 and not startswith({digits}, '0') "
            f"and coalesce((11 - {product}) % 10 = int(substr({digits}, 11, 1)), false))")


def steuer_id_sql(value: str) -> str:
    """German tax id: 11 digits, no leading zero, ISO 7064 mod 11,10."""
    return _over_digits(value, _steuer_digits)


# Validators that read only the digits of a value, or only its letters and digits.
_ON_DIGITS = {"credit_card": _card_digits, "svnr": _svnr_digits, "steuer_id": _steuer_digits}
_ON_COMPACT = {"iban": _iban_compact}
# Name -> (condition, least number of digits, pattern); a text that contains a valid
# identifier has the digits and matches the pattern.
_REGISTRY: dict = {
    "iban": (iban_sql, 2, f"[A-Za-z][{SPACE}-]*[A-Za-z][{SPACE}-]*[0-9][{SPACE}-]*[0-9]"),
    "credit_card": (credit_card_sql, 12, None),
    "svnr": (svnr_sql, 10, None),
    "steuer_id": (steuer_id_sql, 11, None),
}


def register_validator(name: str, condition, min_digits: int = 0, necessary: str | None = None) -> None:
    """Add a named validator.

    ``condition`` maps a SQL value to a SQL condition, e.g. ``lambda v: f"luhn_check({v})"``;
    ``min_digits`` and ``necessary`` (a pattern) hold for every text that contains a hit.
    """
    _REGISTRY[name] = (condition, min_digits, necessary)
    _ON_DIGITS.pop(name, None)
    _ON_COMPACT.pop(name, None)


def known(names) -> list[str]:
    return [n for n in names or () if n in _REGISTRY]


def any_valid_sql(names, value: str) -> str:
    """One of the named validators passes; unknown names are ignored."""
    return any_of(_REGISTRY[n][0](value) for n in known(names))


def valid_parts_sql(names, digits: str, compacted: str, value: str) -> tuple[str, str]:
    """any_valid_sql in two conditions: over the digits of the value alone, and over its compact form and itself."""
    names = known(names)
    others = [_ON_COMPACT[n](compacted) if n in _ON_COMPACT else _REGISTRY[n][0](value) for n in names if n not in _ON_DIGITS]
    return any_of(_ON_DIGITS[n](digits) for n in names if n in _ON_DIGITS), any_of(others)


def least_digits(names) -> int:
    """No named validator passes on fewer digits."""
    return min((_REGISTRY[n][1] for n in known(names)), default=0)


def could_be_valid_sql(names, text: str, digit_count: str) -> str:
    """False only where no named validator can pass on the text or any part of it."""
    rows = [_REGISTRY[n][1:] for n in known(names)]
    plain = [digits for digits, pattern in rows if pattern is None]
    tests = [f"{digit_count} >= {min(plain)}"] if plain else []
    tests += [f"({digit_count} >= {digits} and {found(text, pattern)})" for digits, pattern in rows if pattern]
    return any_of(tests)


def is_valid(name: str, value: Column) -> Column:
    return once(value, "v", _REGISTRY[name][0]("v"))


def first_valid(names, value: Column) -> Column:
    """Name of the first validator, in rule order, that passes."""
    hits = [F.when(is_valid(n, value), F.lit(n)) for n in known(names)]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def iban(value: Column) -> Column:
    return is_valid("iban", value)


def credit_card(value: Column) -> Column:
    return is_valid("credit_card", value)


def svnr(value: Column) -> Column:
    return is_valid("svnr", value)


def steuer_id(value: Column) -> Column:
    return is_valid("steuer_id", value)


def card_network(digits: Column) -> Column:
    """The network of the longest matching issuer range."""
    return applied(digits, "d", f"get(transform({_issuer('d')}, best -> best.network), 0)")


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def compact(value: Column) -> Column:
    return F.regexp_replace(value, f"[{SPACE}-]", "")
