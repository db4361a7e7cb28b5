"""Rules as data: turn a small ruleset document into literal expressions' ingredients.

Rules become literal patterns because Spark compiles a literal regex once per task but a
pattern column once per row.  Only the ruleset (never data) passes through the driver.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession, functions as F

from ..constants import CANDIDATE_PATTERN, SEVERITY
from ..functions import globs, patterns
from ..functions.text import all_of, found


@dataclass(frozen=True)
class Rule:
    """One rule, resolved; patterns are JVM regexes and ``None`` means absent."""
    ord: int
    id: str
    action: str
    kind: str
    tier: int | None = None
    articles: list | None = None
    gdpr_article: list | None = None
    mask: str = ""
    sides: tuple = ("added", "removed")
    pattern: str | None = None
    hint: str | None = None
    texts: tuple = ()
    min_digits: int = 0
    checksum: bool = False
    validators: tuple = ()
    context: str | None = None
    exclude: str | None = None
    require: str | None = None
    file_scope: tuple = ()
    exclude_paths: tuple = ()
    synthetic: bool = False
    tokens: tuple = ()
    minus: str | None = None
    plus: str | None = None
    same_hunk_only: bool = False
    lowering: tuple = ()
    lowering_unreadable: bool = False
    unusable: tuple = ()
    gate_refused: bool = False
    failed: bool = False
    baseline: bool = False

    @property
    def severity(self) -> int:
        return SEVERITY.get(self.action, 3)

    @property
    def gated(self) -> bool:
        return self.exclude is not None or self.require is not None

    @property
    def globs(self) -> tuple:
        return self.file_scope + self.exclude_paths

    def scope_sql(self, path: str = "file", built_in: str = "excluded") -> str:
        return globs.in_scope_sql(path, self.file_scope, self.exclude_paths, built_in)

    @property
    def scope(self) -> tuple:
        """What the path decides, beside the built-in exclusion."""
        return self.file_scope, self.exclude_paths

    def gate_sql(self, text: str) -> str:
        """Neither suppressed nor short of its precondition."""
        tests = [f"not {found(text, self.exclude)}"] if self.exclude else []
        return all_of(tests + ([found(text, self.require)] if self.require else []))


@dataclass(frozen=True)
class Ruleset:
    framework: str
    version: int
    hash: str
    rules: tuple
    allowlist: dict = field(default_factory=dict)
    fw_ord: int = 0
    context_rejected: bool = False
    context: dict | None = None
    context_hash: str | None = None

    def of_kind(self, *kinds):
        return [r for r in self.rules if r.kind in kinds]

    def refused_globs(self, why: str) -> list[str]:
        seen = dict.fromkeys(g for r in self.rules for g in r.globs if globs.refusal(g) == why)
        return list(seen)


_PATTERN_FIELDS = ("pattern", "exclude_pattern", "require_pattern", "require_context")


def _detect(raw) -> dict:
    """The detection part of a rule as written, or an empty one."""
    detect = raw.get("detect") if isinstance(raw, dict) else None
    return detect if isinstance(detect, dict) else {}


def _strings(value) -> tuple:
    """The strings of a list; anything else has none."""
    return tuple(v for v in value if isinstance(v, str)) if isinstance(value, list) else ()


def _declared(detect: dict) -> dict:
    paired = detect["paired"] if isinstance(detect.get("paired"), dict) else {}
    named = {f: detect.get(f) for f in _PATTERN_FIELDS}
    named |= {"paired.minus": paired.get("minus"), "paired.plus": paired.get("plus")}
    return {name: p for name, p in named.items() if isinstance(p, str) and p}


def _accepted(spark: SparkSession, candidates) -> set[str]:
    """The JVM patterns that compile, asked in one small query."""
    rows = [(p,) for p in sorted(candidates)]
    if not rows:
        return set()
    probe = spark.createDataFrame(rows, "p string").where(patterns.compiles(F.col("p")))
    return {r.p for r in probe.collect()}


def _lowering(spec) -> tuple[tuple, bool]:
    """((conditions, action), ...) of an ``applies_when``, and whether it was unreadable."""
    if spec is None:
        return (), False

    def fine(entry):
        when = entry.get("when") if isinstance(entry, dict) else None
        return (isinstance(when, dict) and when and all(isinstance(v, bool) for v in when.values())
                and entry.get("action") in ("review", "advise"))

    if not isinstance(spec, list) or not all(fine(e) for e in spec):
        return (), True
    return tuple((tuple(sorted(e["when"].items())), e["action"]) for e in spec), False


def _kind(detect: dict) -> str:
    if detect.get("target") == "pr_description":
        return "description"
    if detect.get("method") == "signature":
        return "signature"
    return "paired" if detect.get("paired") else "line"


def _malformed(raw) -> bool:
    """Whether a rule lacks what every rule needs, or has it in a type that no part of the engine can read."""
    detect = _detect(raw)
    texts = [detect.get(f) for f in (*_PATTERN_FIELDS, "mask", "signature")]
    texts += list(detect["paired"].values()) if isinstance(detect.get("paired"), dict) else []
    return (not detect or not isinstance(raw.get("id"), str) or raw.get("action") not in SEVERITY
            or not isinstance(detect.get("paired") or {}, dict) or any(not isinstance(t, str | None) for t in texts))


def _rule(ord_: int, raw, signatures: dict, accepted: set[str]) -> Rule:
    """One rule; one that cannot be read is kept by name, runs nothing and floors the verdict."""
    detect = _detect(raw)
    if _malformed(raw):
        name = raw.get("id") if isinstance(raw, dict) else None
        return Rule(ord_, name if isinstance(name, str) else "unknown", "advise", "none", failed=True)

    def java(pattern, extra="", sticky=True):
        p = patterns.to_java(pattern, extra, sticky)
        return p if p in accepted else None

    kind, paired = _kind(detect), detect.get("paired") or {}
    validators = _strings(detect.get("validator"))
    refused = raw.get("tier") == 1 and bool(detect.get("exclude_pattern") or detect.get("require_pattern"))
    pattern = java(detect.get("pattern"))
    if pattern is None and validators and kind == "line":
        pattern = CANDIDATE_PATTERN
    hint, digits = patterns.requirements(detect.get("pattern")) if java(detect.get("pattern")) else (None, 0)
    key = detect.get("signature")
    tokens = signatures.get(key, [key]) if key else []
    lowering, unreadable = _lowering(detect.get("applies_when"))
    return Rule(
        ord=ord_, id=raw["id"], action=raw.get("action"), kind=kind, tier=raw.get("tier"),
        articles=raw.get("articles"), gdpr_article=raw.get("gdpr_article"), mask=detect.get("mask") or "",
        sides={"added": ("added",), "removed": ("removed",)}.get(detect.get("diff_side"), ("added", "removed")),
        pattern=pattern, hint=hint, texts=_texts(detect, kind, tokens, java), min_digits=digits, checksum=detect.get("method") == "checksum", validators=validators,
        context=java(detect.get("require_context"), "i", False),
        exclude=None if refused else java(detect.get("exclude_pattern"), "", False),
        require=None if refused else java(detect.get("require_pattern"), "", False),
        file_scope=_strings(detect.get("file_scope")), exclude_paths=_strings(detect.get("exclude_paths")),
        synthetic=detect.get("allowlist") == "synthetic", tokens=tuple(t for t in tokens if t),
        minus=java(paired.get("minus"), "", False), plus=java(paired.get("plus"), "", False),
        same_hunk_only=paired.get("window") == "same_hunk",
        lowering=lowering, lowering_unreadable=unreadable,
        unusable=tuple(n for n, p in _declared(detect).items() if java(p) is None),
        gate_refused=refused, baseline=raw.get("baseline") is True)


def _texts(detect: dict, kind: str, tokens, java) -> tuple:
    """Texts of which every hit needs one: listed tokens as they are, or what the pattern requires."""
    if kind == "signature":
        listed = {t.lower() for t in tokens if t}
        return tuple(sorted(listed)) if all(t.isascii() and len(t) >= patterns.GRAM for t in listed) else ()
    return patterns.required_texts(detect.get("pattern")) if java(detect.get("pattern")) else ()


def scopes(rulesets: list[Ruleset]) -> list[tuple]:
    """The distinct scopes of all rules, for ``globs.settled``."""
    return list(dict.fromkeys(r.scope for fw in rulesets for r in fw.rules if any(r.scope)))


def compile_rulesets(spark: SparkSession, documents: list[dict]) -> list[Ruleset]:
    """Resolve ruleset dicts (one per framework, in order)."""
    wanted = set()
    for doc in documents:
        for raw in doc.get("rules") or ():
            for p in _declared(_detect(raw)).values():
                for extra, sticky in (("", True), ("", False), ("i", False)):
                    wanted.add(patterns.to_java(p, extra, sticky))
    accepted = _accepted(spark, wanted - {None})
    return [
        Ruleset(doc["framework"], doc.get("ruleset_version"), doc.get("ruleset_hash"),
                tuple(_rule(i, raw, doc.get("signatures") or {}, accepted)
                      for i, raw in enumerate(doc.get("rules") or ())),
                doc.get("allowlist") or {}, n, bool(doc.get("context_rejected")),
                doc["context"] if isinstance(doc.get("context"), dict) else None, doc.get("context_hash"))
        for n, doc in enumerate(documents)
    ]
