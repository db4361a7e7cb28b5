"""Ruleset documents (JSON) to a rulesets table; every rejected document becomes a row with its reason."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import DEFAULT_FRAMEWORK, FRAMEWORKS, INVENTORY_RULE_IDS
from ..functions import globs, patterns
from ..schemas import ALLOWLIST, RULE, SIGNATURES

_EMPTY_ALLOWLIST = '{"emails": [], "names": [], "domains": [], "ip_ranges": [], "ibans": []}'
_EMPTY_SIGNATURES = '{"telemetry-sdks": [], "pii-datastore-credentials": [], "processor-jurisdiction": []}'


def _field(base: str, name: str, kind: str = "variant") -> Column:
    return F.expr(f"try_variant_get({base}, '$.{name}', '{kind}')")


def _type(base: str, name: str | None = None) -> Column:
    """VARIANT type name: OBJECT<..>, ARRAY<..>, STRING, BOOLEAN, a number type, or null when absent."""
    value = base if name is None else f"try_variant_get({base}, '$.{name}', 'variant')"
    return F.expr(f"schema_of_variant({value})")


def _is(kind: Column, prefix: str) -> Column:
    return F.coalesce(kind.startswith(prefix), F.lit(False))


def _is_number(kind: Column) -> Column:
    return F.coalesce(kind.rlike(r"\A(BIGINT|DECIMAL.*|DOUBLE|FLOAT)\z"), F.lit(False))


def read_documents(docs: DataFrame, key="doc_id", body="json") -> DataFrame:
    """One row per ruleset entry, in order, with the first reason its document is unusable."""
    v = docs.select(key, F.try_parse_json(body).alias("v"))
    schema_two = _is_number(_type("v", "schema")) & (_field("v", "schema", "double") == 2)
    rulesets = F.when(_is(_type("v", "rulesets"), "ARRAY"), _field("v", "rulesets", "array<variant>"))
    v = v.select(key, "v", F.coalesce(schema_two, F.lit(False)).alias("schema2"), rulesets.alias("rulesets"))
    doc_error = (F.when(F.col("v").isNull(), "not-json").when(~_is(_type("v"), "OBJECT"), "not-object")
                 .when(F.col("schema2") & F.col("rulesets").isNull(), "no-rulesets"))
    entries = F.when(F.col("schema2"), F.col("rulesets")).otherwise(F.array("v"))
    rows = v.select(key, "v", "schema2", doc_error.alias("doc_error"), F.posexplode_outer(entries).alias("entry_ord", "e"))
    framework = F.when(F.col("schema2"), F.when(_type("e", "framework") == "STRING", _field("e", "framework", "string"))) \
        .otherwise(F.lit(DEFAULT_FRAMEWORK))
    known = F.coalesce(framework.isin(*FRAMEWORKS), F.lit(False))
    entry_error = (F.when(F.col("e").isNotNull() & ~_is(_type("e"), "OBJECT") & ~_is(_type("e"), "ARRAY"), "bad-entry")
                   .when(known & ~_is_number(_type("e", "ruleset_version")), "missing-version")
                   .when(known & ~F.coalesce(_type("e", "ruleset_hash") == "STRING", F.lit(False)), "missing-hash")
                   .when(known & ~_is(_type("e", "rules"), "ARRAY"), "missing-rules"))
    return rows.select(key, "v", "schema2", "entry_ord", "e", framework.alias("framework"), known.alias("known"),
                       F.coalesce("doc_error", entry_error).alias("error"))


def document_errors(docs: DataFrame, key="doc_id", body="json") -> DataFrame:
    """(doc, error) of the documents that cannot be used; the first bad entry names the reason."""
    entries = read_documents(docs, key, body)
    first = F.min(F.when(F.col("error").isNotNull(), F.struct(F.coalesce("entry_ord", F.lit(-1)).alias("o"), "error")))
    per_doc = entries.groupBy(key).agg(first["error"].alias("error"), F.max("known").alias("any_known"))
    return per_doc.select(key, F.coalesce("error", F.when(~F.col("any_known"), F.lit("no-known-framework"))).alias("error")) \
        .where(F.col("error").isNotNull())


def load_rulesets(docs: DataFrame, key="doc_id", body="json") -> DataFrame:
    """The usable rulesets: one row per (document, framework entry), defaults filled in."""
    entries = read_documents(docs, key, body)
    usable = entries.join(document_errors(docs, key, body).select(key), key, "left_anti").where("known")
    has_context = F.coalesce(_type("e", "context") != "VOID", F.lit(False))
    has_hash = F.coalesce(_type("e", "context_hash") != "VOID", F.lit(False))
    context_hash = F.when(_type("e", "context_hash") == "STRING", _field("e", "context_hash", "string"))
    good = _is(_type("e", "context"), "OBJECT") & F.coalesce(context_hash.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))
    # Only schema-2 entries carry a registry context or withheld rules.
    new, has_any = F.col("schema2"), has_context | has_hash

    def part(name, kind, empty):
        given = F.coalesce(_type("e", name) != "VOID", F.lit(False))
        return F.from_json(F.when(given, F.to_json(_field("e", name))).otherwise(empty), kind)

    return usable.select(
        key, "entry_ord", F.when(new, "schema2").otherwise("legacy").alias("shape"), "framework",
        _field("e", "ruleset_version", "bigint").alias("ruleset_version"),
        _field("e", "ruleset_hash", "string").alias("ruleset_hash"),
        _field("e", "rules", "array<variant>").alias("rules"),
        part("allowlist", ALLOWLIST, _EMPTY_ALLOWLIST).alias("allowlist"),
        part("signatures", SIGNATURES, _EMPTY_SIGNATURES).alias("signatures"),
        F.when(new & good, _field("e", "context")).alias("context"),
        F.when(new & good, context_hash).alias("context_hash"),
        (new & has_any & ~good).alias("context_rejected"),
        F.when(new & _is(_type("e", "dropped_rules"), "ARRAY"), _field("e", "dropped_rules", "array<variant>"))
        .otherwise(F.expr("cast(array() as array<variant>)")).alias("dropped_rules"))


def unavailable(docs: DataFrame, key="doc_id", body="json") -> DataFrame:
    """Frameworks a document says it could not serve, checked and cleaned."""
    raw = docs.select(key, F.try_parse_json(body).alias("v"))
    items = F.when(_is(_type("v", "unavailable"), "ARRAY"), _field("v", "unavailable", "array<variant>"))
    rows = raw.select(key, F.posexplode(items).alias("pos", "u"))
    name = F.when(_type("u", "framework") == "STRING", _field("u", "framework", "string"))
    reason = F.when(_type("u", "reason") == "STRING", _field("u", "reason", "string"))
    return rows.select(key, "pos", name.alias("name"), reason.alias("reason")) \
        .where(F.length("name").between(1, 64) & F.col("reason").rlike(r"\A[a-z_]{1,40}\z")) \
        .select(key, "pos", F.regexp_replace("name", r"[^A-Za-z0-9 ._-]", "").alias("framework"), "reason")


def explode_rules(rulesets: DataFrame, key="doc_id") -> DataFrame:
    """One row per rule, with its position and a fixed schema."""
    rules = rulesets.select(key, "framework", F.posexplode("rules").alias("rule_ord", "raw"))
    return rules.select(key, "framework", "rule_ord", F.from_json(F.to_json("raw"), RULE).alias("rule"))


def audit_rules(rules: DataFrame, *keys: str) -> DataFrame:
    """Fields that do not compile, refused gates and refused globs of a rules table of any size."""
    d = "rule.detect."
    fields = {"pattern": d + "pattern", "exclude_pattern": d + "exclude_pattern", "require_pattern": d + "require_pattern",
              "require_context": d + "require_context", "paired.minus": d + "paired.minus", "paired.plus": d + "paired.plus"}
    bad = F.array_compact(F.array(*[
        F.when((F.length(F.col(c)) > 0) & ~patterns.usable(F.col(c)), F.lit(name)) for name, c in fields.items()]))
    empty = F.array().cast("array<string>")
    paths = F.concat(F.coalesce(d + "file_scope", empty), F.coalesce(d + "exclude_paths", empty))
    gated = (F.coalesce(F.length(d + "exclude_pattern"), F.lit(0)) > 0) | (F.coalesce(F.length(d + "require_pattern"), F.lit(0)) > 0)
    return rules.select(
        *keys, F.col("rule.id").alias("rule_id"), bad.alias("unusable_fields"),
        (F.coalesce(F.col("rule.tier") == 1, F.lit(False)) & gated).alias("gate_refused"),
        F.filter(paths, lambda g: globs.refusal_column(g) == "blanket").alias("blanket_globs"),
        F.filter(paths, lambda g: globs.refusal_column(g) == "complex").alias("complex_globs"))


def inventory_rules(rules: DataFrame, ids=INVENTORY_RULE_IDS) -> DataFrame:
    """Rules an inventory runs: flagged, and on the closed list."""
    return rules.where((F.col("rule.baseline") == F.lit(True)) & F.col("rule.id").isin(*ids))


def to_documents(rulesets: DataFrame) -> list[dict]:
    """The rulesets of one scan as dicts, for ``compile_rulesets``.

    One document's rulesets hold each framework once; more mean that several documents were passed, which are as many
    as the data has.
    """
    small = rulesets.select("framework", "ruleset_version", "ruleset_hash", F.to_json("rules").alias("rules"),
                            F.to_json("allowlist").alias("allowlist"), "signatures", F.to_json("context").alias("context"),
                            "context_hash", "context_rejected", "entry_ord")
    if small.groupBy("framework").count().where("count > 1").limit(1).count():
        raise ValueError("a scan compiles one set of rulesets; select one document first")
    out = [r.asDict() for r in small.orderBy("entry_ord").collect()]
    for doc in out:
        for name in ("rules", "allowlist", "context"):
            doc[name] = json.loads(doc[name]) if doc[name] else None
    return out
