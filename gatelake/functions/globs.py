"""Path globs: substring match, optional ``^`` / ``$`` anchors, ``**``, ``*`` and ``?``."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..constants import ALWAYS_EXCLUDED, MAX_GLOB_WILDCARDS
from .text import all_of, found

_TOKEN = re.compile(r"\*\*|\*|\?|[^*?]+")
_WILD = {"**": ".*", "*": "[^/]*", "?": "."}
_META = re.compile(r"([\\.+^$|(){}\[\]])")
# One expression, as each path is tested once.
_EXCLUDED = "|".join(ALWAYS_EXCLUDED)


def _body(glob: str) -> str:
    return glob.removeprefix("^").removesuffix("$")


def refusal(glob: str) -> str | None:
    """Why a glob is refused: too many wildcards, or it selects every path."""
    body = _body(glob)
    if len(re.findall(r"[*?]", body.replace("**", "*"))) > MAX_GLOB_WILDCARDS:
        return "complex"
    return None if re.search(r"[^*?/]", body) else "blanket"


def to_regex(glob: str) -> str | None:
    """JVM regex of an accepted glob; None for a refused one, which matches nothing."""
    if refusal(glob):
        return None
    inner = "".join(_WILD.get(t) or _META.sub(r"\\\1", t) for t in _TOKEN.findall(_body(glob)))
    return (r"\A" if glob.startswith("^") else "") + inner + (r"\z" if glob.endswith("$") else "")


def any_glob_regex(globs) -> str | None:
    """One alternation for a whole list, so a path is tested once per list."""
    parts = [r for r in (to_regex(g) for g in globs or ()) if r]
    return "|".join(f"(?:{p})" for p in parts) or None


def any_glob_sql(path: str, globs) -> str:
    regex = any_glob_regex(globs)
    return found(path, regex) if regex else "false"


def in_scope_sql(path: str, file_scope=None, exclude_paths=None, built_in: str | None = None) -> str:
    """Not excluded, and in the file scope; ``built_in`` is the shared exclusion where already evaluated."""
    tests = [f"not {built_in or found(path, _EXCLUDED)}"]
    if exclude_paths:
        tests.append(f"not {any_glob_sql(path, exclude_paths)}")
    if file_scope:
        tests.append(any_glob_sql(path, file_scope))
    return all_of(tests)


def settled(path: Column, scopes) -> Column:
    """Which of the (file scope, excluded paths) pairs cover a path, beside the built-in exclusion: ARRAY<BOOLEAN>."""
    return F.array(*[in_scope(path, *scope) for scope in scopes]).cast("array<boolean>")


def any_glob(path: Column, globs) -> Column:
    regex = any_glob_regex(globs)
    return path.rlike(regex) if regex else F.lit(False)


def is_built_in_exclusion(path: Column) -> Column:
    return path.rlike(_EXCLUDED)


def in_scope(path: Column, file_scope=None, exclude_paths=None) -> Column:
    ok = ~is_built_in_exclusion(path)
    if exclude_paths:
        ok = ok & ~any_glob(path, exclude_paths)
    return ok & any_glob(path, file_scope) if file_scope else ok


def refusal_column(glob: Column) -> Column:
    """``refusal`` over a column, for auditing a rules table."""
    body = F.regexp_replace(F.regexp_replace(glob, r"\A\^", ""), r"\$\z", "")
    wildcards = F.length(F.regexp_replace(F.replace(body, F.lit("**"), F.lit("*")), r"[^*?]", ""))
    return (F.when(wildcards > MAX_GLOB_WILDCARDS, F.lit("complex"))
            .when(~body.rlike(r"[^*?/]"), F.lit("blanket")))
