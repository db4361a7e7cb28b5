"""Rule patterns: JavaScript regular expressions rewritten for the JVM's dialect.

Rules are authored for a JavaScript engine.  The two dialects agree on most of the
language; ``to_java`` rewrites the constructs whose meaning differs and returns ``None``
for what the rule's own engine would refuse, so a refused pattern is reported by the
audit and never reaches a task.
"""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .text import quoted

# --- fixed values ---------------------------------------------------------------------------
FLAGS = "gimsuyd"
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# The same characters as a text, which trimming reads only from the ends of a value.
SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
LINE_END = r"\n\r\x{2028}-\x{2029}"

# The JVM looks a character up in its own ``\w``, but walks through the ranges of a class.
_WORD, _WORD_FOLDED = r"\w", "[0-9A-Za-z_]"
_BOUNDARY = "(?:(?<=W)(?!W)|(?<!W)(?=W))"
_NOT_BOUNDARY = "(?:(?<=W)(?=W)|(?<!W)(?!W))"
# A boundary next to a known word character needs only one look-around.
_WORD_AHEAD = re.compile(r"[0-9A-Za-z_]|\\[dw]|\[(?:[0-9A-Za-z_]-[0-9A-Za-z_]|[0-9A-Za-z_])+\]|\((?:\?:)?\w+(?:\|\w+)*\)", re.ASCII)
_REPEATED = r"(?:\+|\{[1-9]\d*(?:,\d*)?\})?"
_WORD_BEHIND = re.compile(
    r"(?:(?<!\\)[0-9A-Za-z_]|\\[dw]|(?<!\\)\[(?:[0-9A-Za-z_]-[0-9A-Za-z_]|[0-9A-Za-z_])+\]"
    r"|(?<!\\)\((?:\?:)?\w+(?:\|\w+)*\))" + _REPEATED + r"\Z", re.ASCII)
# Escapes that end in word characters without standing for one of these.
_CODED_BEHIND = re.compile(r"\\(?:x[0-9A-Fa-f]*|u[0-9A-Fa-f]*|u\{[0-9A-Fa-f]*\}|c[A-Za-z]|k<[\w$]*>|\d+|[pP]\{[^}]*\})" + _REPEATED + r"\Z", re.ASCII)
_PREFIX = re.compile(r"\(\?([a-z]+)\)")
_QUANTIFIER = re.compile(r"\{\d+(?:,\d*)?\}")
_GROUP = re.compile(r"\(\?(?::|=|!|<=|<!|<([A-Za-z_$][A-Za-z0-9_$]*)>)")
_NAMED = re.compile(r"<([A-Za-z_$][A-Za-z0-9_$]*)>")
_SET_ESCAPES = "dDwWsS"
_CLASS = re.compile(r"\[\^?(?:\\.|[^\]\\])*\]")
_REPEAT = re.compile(r"(?:[*+?]|\{(\d+)(?:,\d*)?\})\??")
_KEPT_ESCAPES = set("dDwW0tnrfcxuk123456789")
# Length of the grams lines are indexed by, and how many alternative texts of one pattern are of use.
GRAM, MOST_TEXTS, MOST_ARMS = 3, 64, 4


def _boundary(before: str, after: str, word: str = _WORD) -> str:
    ahead = _WORD_AHEAD.match(after)
    if ahead and not re.match(r"[*?]|\{0", after[ahead.end():]):
        # Looking at the next character first fails most positions at once.
        token = ahead.group(0)
        if token.startswith("("):
            token = "[" + "".join(sorted({w[0] for w in re.findall(r"\w+", token, re.ASCII)})) + "]"
        return rf"(?={token})(?<!{word})"
    return rf"(?!{word})" if _WORD_BEHIND.search(before) and not _CODED_BEHIND.search(before) else _BOUNDARY.replace("W", word)


def _java_name(name: str) -> str:
    """A group name of letters and digits; others are spelled in hexadecimal."""
    return name if name.isalnum() else "x" + name.encode().hex()


def split_flags(pattern: str) -> tuple[str, str] | None:
    """(flags, body) of a pattern with an optional leading ``(?flags)``; None if unusable."""
    m = _PREFIX.match(pattern)
    if not m:
        return "", pattern
    body = pattern[m.end():]
    if not body or any(f not in FLAGS for f in m.group(1)):
        return None
    return m.group(1), body


def to_java(pattern: str | None, extra: str = "", sticky: bool = True) -> str | None:
    """The JVM form of a rule pattern, or None when the rule's engine would refuse it."""
    if not pattern:
        return None
    parts = split_flags(pattern)
    if parts is None:
        return None
    flags, body = set(parts[0]) | set(extra), parts[1]
    out, i, n, in_class = [], 0, len(body), False
    unicode_names = "u" in flags
    # Where case is folded beyond ASCII, a class also takes what folds to its letters.
    word = _WORD_FOLDED if "i" in flags and not body.isascii() else _WORD
    while i < n:
        ch = body[i]
        if ch == "\\":
            if i + 1 >= n:
                return None
            nxt = body[i + 1]
            i += 2
            set_escape = nxt in _SET_ESCAPES
            if in_class and set_escape and body[i:i + 1] == "-" and body[i + 1:i + 2] not in ("", "]"):
                # No range starts or ends with a set, so the hyphen beside it is a hyphen.
                body = body[:i] + "\\" + body[i:]
                n += 1
            if nxt == "k" and (m := _NAMED.match(body, i)):
                out.append(rf"\k<{_java_name(m.group(1))}>")
                i = m.end()
            elif nxt == "s":
                out.append(SPACE if in_class else f"[{SPACE}]")
            elif nxt == "S":
                out.append(f"[^{SPACE}]")
            elif nxt in "bB" and not in_class:
                out.append(_boundary(body[:i - 2], body[i:], word) if nxt == "b" else _NOT_BOUNDARY.replace("W", word))
            elif nxt == "b":
                out.append(r"\x08")
            elif nxt == "v":
                out.append(r"\x0B")
            elif nxt == "0":
                out.append(r"\x00")
            elif nxt in "pP" and unicode_names:
                out.append("\\" + nxt)
                end = body.find("}", i)
                if end < 0:
                    return None
                out.append(body[i:end + 1])
                i = end + 1
            elif nxt in _KEPT_ESCAPES or not nxt.isalpha():
                out.append("\\" + nxt)
            else:
                out.append(nxt)
        elif in_class:
            i += 1
            if ch == "]":
                in_class = False
                out.append(ch)
            elif ch == "[" or (ch == "&" and body[i:i + 1] == "&") or (
                    ch == "-" and body[i:i + 1] == "\\" and body[i + 1:i + 2] and body[i + 1] in _SET_ESCAPES):
                out.append("\\" + ch)
            else:
                out.append(ch)
        elif body.startswith("[^]", i):
            out.append(r"[\x00-\x{10FFFF}]")
            i += 3
        elif body.startswith("[]", i):
            out.append("(?!)")
            i += 2
        elif ch == "[":
            in_class = True
            negated = body.startswith("[^", i)
            out.append("[^" if negated else "[")
            i += 2 if negated else 1
        elif ch == ".":
            out.append("(?s:.)" if "s" in flags else f"[^{LINE_END}]")
            i += 1
        elif ch == "$":
            out.append(rf"(?:(?=[{LINE_END}])|\z)" if "m" in flags else r"\z")
            i += 1
        elif ch == "^":
            out.append(rf"(?:(?<=[{LINE_END}])|\A)" if "m" in flags else r"\A")
            i += 1
        elif ch == "{" and not _QUANTIFIER.match(body, i):
            out.append(r"\{")
            i += 1
        elif ch == "(" and body.startswith("(?", i):
            m = _GROUP.match(body, i)
            if not m:
                return None
            out.append(f"(?<{_java_name(m.group(1))}>" if m.group(1) else m.group(0))
            i = m.end()
        elif ch in "*+?" or ch == "{":
            q = _QUANTIFIER.match(body, i).group(0) if ch == "{" else ch
            i += len(q)
            out.append(q)
            if body[i:i + 1] == "+":
                return None
        else:
            out.append(ch)
            i += 1
    java = "".join(out)
    if "i" in flags:
        java = ("(?i)" if body.isascii() else "(?iu)") + java
    if "y" in flags and sticky:
        java = rf"\G(?:{java})"
    return java


def requirements(pattern: str | None) -> tuple[str | None, int]:
    """A text every match must contain (or None), and how many ASCII digits it must hold.

    Testing for these first spares most lines the regular expression.  Only what stands
    outside groups and alternations counts; letters do not under the ``i`` flag.
    """
    parts = split_flags(pattern) if pattern else None
    if parts is None:
        return None, 0
    flags, body = parts
    runs, run, digits, depth, i = [], "", 0, 0, 0
    while i < len(body):
        ch, step, literal, is_digit = body[i], 1, None, False
        if ch == "\\":
            step = 2
            escaped = body[i + 1:i + 2]
            if not escaped.isalnum():
                literal = escaped
            elif escaped not in "dDwWsSbB":
                return None, 0
            is_digit = escaped == "d"
        elif ch == "[":
            end = _CLASS.match(body, i)
            if not end:
                return None, 0
            step = end.end() - i
            is_digit = end.group(0) == "[0-9]"
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and depth == 0:
            return None, 0
        elif ch not in ".^$*+?{|":
            literal = ch
            is_digit = ch in "0123456789"
        i += step
        repeat = _REPEAT.match(body, i)
        least = 1 if not repeat else {"*": 0, "?": 0, "+": 1}.get(repeat.group(0)[0], int(repeat.group(1) or 0))
        i = repeat.end() if repeat else i
        if depth == 0 and is_digit:
            digits += least
        usable = literal and depth == 0 and least and not (
            "i" in flags and (literal.isalpha() or not literal.isascii()))
        run += literal if usable else ""
        if repeat or not usable:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len) or None, digits


def required_texts(pattern: str | None) -> tuple:
    """Lower-case ASCII texts of which every match holds at least one, whatever the case; empty where nothing is known.

    Unlike ``requirements`` this looks into groups and alternations. Of the texts that stand one after the other in a
    pattern the longest serve; texts of fewer than ``GRAM`` characters do not.
    """
    parts = split_flags(pattern) if pattern else None
    if parts is None or ("i" in parts[0] and not parts[1].isascii()):
        return ()
    texts, end = _alternatives(parts[1], 0)
    return tuple(sorted(texts)) if texts and end == len(parts[1]) and len(texts) <= MOST_TEXTS else ()


def _better(a: set, b: set) -> set:
    """Of two sets of texts the one whose shortest is longer, then the smaller."""
    return max(a, b, key=lambda texts: (min(map(len, texts)), -len(texts)) if texts else (0, 0))


def _alternatives(body: str, i: int) -> tuple[set, int]:
    """Required texts from ``i`` to the end of the enclosing group: one set for all branches, empty if one has none."""
    every, known = set(), True
    while True:
        best, i = _branch(body, i)
        known = known and bool(best)
        every |= best
        if body[i:i + 1] != "|":
            return (every if known else set()), i
        i += 1


def _branch(body: str, i: int) -> tuple[set, int]:
    best, run = set(), ""
    while i < len(body) and body[i] not in "|)":
        literal, inner, start = "", set(), i
        if body[i] == "\\":
            escaped = body[i + 1:i + 2]
            if escaped.isalnum() and escaped not in "dDwWsSbB":
                return set(), len(body) + 1
            literal, i = "" if escaped.isalnum() else escaped, i + 2
        elif body[i] == "[":
            end = _CLASS.match(body, i)
            if not end:
                return set(), len(body) + 1
            i = end.end()
        elif body[i] == "(":
            opened = _GROUP.match(body, i)
            inner, i = _alternatives(body, opened.end() if opened else i + 1)
            if body[i:i + 1] != ")":
                return set(), len(body) + 1
            i += 1
            if re.match(r"\(\?<?[=!]", body[start:]):
                inner = set()
        else:
            literal, i = "" if body[i] in ".^$*+?{}]" else body[i], i + 1
        repeat = _REPEAT.match(body, i)
        least = 1 if not repeat else {"*": 0, "?": 0, "+": 1}.get(repeat.group(0)[0], int(repeat.group(1) or 0))
        i = repeat.end() if repeat else i
        usable = literal.isascii() and bool(literal) and least > 0
        run += literal.lower() if usable else ""
        if inner and least:
            best = _better(best, inner)
        if not usable or repeat:
            best, run = _better(best, {run} if len(run) >= GRAM else set()), ""
    return _better(best, {run} if len(run) >= GRAM else set()), i


def gram_pattern(grams) -> str:
    """JVM pattern whose first group, taken at every place, is the longest of the given texts that stands there.

    One trie for all of them. Where many characters may follow, classes halve the choice before single ones are tried.
    """
    trie: dict = {}
    for gram in sorted(grams):
        node = trie
        for ch in gram:
            node = node.setdefault(ch, {})
        node[""] = {}

    def chosen(arms) -> str:
        if len(arms) <= MOST_ARMS:
            return arms[0][1] if len(arms) == 1 else f"(?:{'|'.join(text for _, text in arms)})"
        size = max(MOST_ARMS, -(-len(arms) // MOST_ARMS))
        parts = [arms[i:i + size] for i in range(0, len(arms), size)]
        return f"(?:{'|'.join(f'(?=[{"".join(c for c, _ in part)}]){chosen(part)}' for part in parts)})"

    def branches(node) -> str:
        arms = [(f"\\x{{{ord(ch):X}}}", f"\\x{{{ord(ch):X}}}{branches(below)}") for ch, below in node.items() if ch]
        return "" if not arms else f"(?:{chosen(arms)})?" if "" in node else chosen(arms)

    return f"(?=({branches(trie)}))"


def count_groups(java_pattern: str) -> int:
    """Capturing groups of a JVM pattern."""
    n, i, in_class = 0, 0, False
    while i < len(java_pattern):
        ch = java_pattern[i]
        if ch == "\\":
            i += 1
        elif ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        elif ch == "(" and not in_class:
            rest = java_pattern[i + 1:i + 4]
            if not rest.startswith("?") or (rest.startswith("?<") and rest[2:3] not in ("=", "!")):
                n += 1
        i += 1
    return n


@F.pandas_udf(StringType())
def java_pattern(patterns: pd.Series) -> pd.Series:
    """Column form of ``to_java``, for auditing a rules table of any size."""
    return patterns.map(lambda p: to_java(p) if isinstance(p, str) else None)


def compiles(java: Column) -> Column:
    """True where the JVM accepts the pattern; a refused pattern never fails the task."""
    probe = F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), java)
    return java.isNotNull() & probe.isNotNull()


def usable(pattern: Column) -> Column:
    """Whether a rule pattern column would run."""
    return compiles(java_pattern(pattern))


def trimmed_sql(value: str) -> str:
    """``js_trim`` as SQL text."""
    return f"trim(both {quoted(SPACES)} from {value})"


def js_trim(value: Column) -> Column:
    return F.trim(value, F.lit(SPACES))
