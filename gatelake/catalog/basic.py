"""Queries over text, paths, identifiers and masks."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CANDIDATE_PATTERN as CANDIDATE_SQL, CARD_LENGTHS, CARD_NO_LUHN, CARD_RANGES, LONG_LINE_CHARS
from ..functions import allowlist, checksums, globs, masking
from ..operators import candidates as cand, detect
from ..operators.diff import diff_lines, diff_stats, pair_counts, side_lines
from ..operators.pairs import pair_summary
from ..sources.changes import cap_diffs, checked_metadata
from ..sources.tree import tree_lines
from . import sql, views
from .registry import query
from .rulesets import EMAIL, IPV4

IP_SQL = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"


@query("changes_capped", f"""
WITH {sql.CHANGES}
SELECT change_id, length(diff) > 2000 AS truncated, md5(left(diff, 2000)) AS digest, length(left(diff, 2000)) AS kept
FROM changes""")
def changes_capped(spark, sf):
    return cap_diffs(views.changes(spark, sf), 2000).select(
        "change_id", "truncated", F.md5("diff").alias("digest"), F.length("diff").cast("bigint").alias("kept"))


@query("document_lines", f"WITH {sql.DOC_LINES} SELECT change_id, file, line_no, md5(text) AS digest FROM lines")
def document_lines(spark, sf):
    return views.doc_lines(spark, sf).select("change_id", "file", "line_no", F.md5("text").alias("digest"))


@query("diff_lines", f"""
WITH {sql.PARSED}
SELECT change_id, pos, file, hunk_index, side, line_no, md5(text) AS digest FROM diff_lines""")
def diff_lines_query(spark, sf):
    return diff_lines(views.changes(spark, sf)).select(
        "change_id", F.col("pos").cast("bigint").alias("pos"), "file", "hunk_index", "side", "line_no",
        F.md5("text").alias("digest"))


@query("diff_lines_by_side", f"""
WITH {sql.PARSED}
SELECT change_id, side, row_number() OVER (PARTITION BY change_id ORDER BY side, pos) AS place, file, line_no
FROM diff_lines WHERE side <> 'context'""")
def diff_lines_by_side(spark, sf):
    from pyspark.sql import Window
    place = F.row_number().over(Window.partitionBy("change_id").orderBy("side_ord", "pos"))
    return side_lines(diff_lines(views.changes(spark, sf))).select(
        "change_id", "side", place.cast("bigint").alias("place"), "file", "line_no")


@query("diff_stats", f"""
WITH {sql.PARSED}
SELECT change_id, file, count_if(side = 'added')::BIGINT AS added, count_if(side = 'removed')::BIGINT AS removed,
       count_if(side = 'context')::BIGINT AS context, count(DISTINCT hunk_index) AS hunks
FROM diff_lines GROUP BY ALL""")
def diff_stats_query(spark, sf):
    return diff_stats(diff_lines(views.changes(spark, sf)))


@query("minus_plus_pairs", f"""
WITH {sql.PARSED}
SELECT p.change_id, p.file, p.hunk_index, p.pos, p.line_no, count_if(m.hunk_index = p.hunk_index)::BIGINT AS same_hunk,
       count(*) AS same_file, min(CASE WHEN m.hunk_index = p.hunk_index THEN m.pos END) AS first_in_hunk,
       min(m.pos) AS first_in_file
FROM diff_lines p JOIN diff_lines m ON m.change_id = p.change_id AND m.file = p.file AND m.side = 'removed'
WHERE p.side = 'added' GROUP BY ALL""")
def minus_plus_pairs(spark, sf):
    rows = pair_summary(diff_lines(views.changes(spark, sf)))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("pos", "first_in_hunk", "first_in_file")})


@query("pair_ceiling", f"""
WITH {sql.PARSED},
hunks AS (SELECT change_id, file, hunk_index, count_if(side = 'removed') AS m, count_if(side = 'added') AS p
          FROM diff_lines GROUP BY ALL),
files AS (SELECT change_id, file, sum(m * p) AS h, sum(m) * sum(p) AS f FROM hunks GROUP BY ALL)
SELECT change_id, sum(h)::BIGINT AS same_hunk_pairs, sum(f)::BIGINT AS same_file_pairs, sum(f) >= 200 AS over_ceiling
FROM files GROUP BY ALL""")
def pair_ceiling(spark, sf):
    return pair_counts(diff_lines(views.changes(spark, sf))).withColumn("over_ceiling", F.col("same_file_pairs") >= 200)


SITE_PATH = "regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '')"
SCOPES = {"fr": ["^fr/"], "digits": ["en/?", "/*5$"], "nested": ["**/1", "de/*$"], "odd": ["*", "*a*b*c*d*e"]}


@query("paths_by_glob", f"""
WITH p AS (SELECT page_id, {SITE_PATH} AS path FROM pages)
SELECT page_id, path, 'fr' AS scope FROM p WHERE regexp_matches(path, '^fr/')
UNION ALL SELECT page_id, path, 'digits' FROM p WHERE regexp_matches(path, 'en/.') OR regexp_matches(path, '/[^/]*5$')
UNION ALL SELECT page_id, path, 'nested' FROM p WHERE regexp_matches(path, '.*/1') OR regexp_matches(path, 'de/[^/]*$')""")
def paths_by_glob(spark, sf):
    paths = views.table(spark, sf, "pages").select("page_id", F.expr(SITE_PATH.replace("'^https", "r'^https")).alias("path"))
    named = F.array_compact(F.array(*[F.when(globs.any_glob(F.col("path"), g), F.lit(n)) for n, g in SCOPES.items()]))
    return paths.select("page_id", "path", F.explode(named).alias("scope"))


@query("paths_in_scope", """
WITH p AS (SELECT p_partkey, (['src', 'dist', 'web/build', 'a/vendor', 'node_modules', 'lib'])[p_partkey % 6 + 1] || '/' ||
             replace(p_name, ' ', (['/', '.min.', '-'])[p_partkey % 3 + 1]) ||
             (['.js', '.ts', '/package-lock.json', '/yarn.lock'])[p_partkey % 4 + 1] AS path FROM part)
SELECT p_partkey, path FROM p
WHERE NOT regexp_matches(path, '(^|/)package-lock[.]json$|(^|/)yarn[.]lock$|(^|/)dist/|(^|/)build/|(^|/)vendor/|[.]min[.][^/]*$|(^|/)node_modules/')
  AND (regexp_matches(path, '^src/') OR regexp_matches(path, 'lib/[^/]*[.]ts')) AND NOT regexp_matches(path, 'widget')""")
def paths_in_scope(spark, sf):
    path = F.expr("""concat(get(array('src', 'dist', 'web/build', 'a/vendor', 'node_modules', 'lib'), int(p_partkey % 6)), '/',
        replace(p_name, ' ', get(array('/', '.min.', '-'), int(p_partkey % 3))),
        get(array('.js', '.ts', '/package-lock.json', '/yarn.lock'), int(p_partkey % 4)))""")
    rows = views.table(spark, sf, "part").select("p_partkey", path.alias("path"))
    return rows.where(globs.in_scope(F.col("path"), ["^src/", "lib/*.ts"], ["widget"]))


GLOB = """concat(get(array('', '^', '^'), int(p_partkey % 3)), get(array('*', '**', '?', '**/', '*a*', ''), int(p_partkey % 6)),
 if(p_partkey % 5 = 0, '', substr(p_name, 1, int(p_partkey % 7))), repeat('*/', int(p_partkey % 5)), get(array('', '$'), int(p_partkey % 2)))"""


@query("glob_audit", """
WITH g AS (SELECT p_partkey, (['', '^', '^'])[p_partkey % 3 + 1] || (['*', '**', '?', '**/', '*a*', ''])[p_partkey % 6 + 1] ||
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE left(p_name, p_partkey % 7) END || repeat('*/', p_partkey % 5) ||
    (['', '$'])[p_partkey % 2 + 1] AS path_glob FROM part),
b AS (SELECT *, regexp_replace(regexp_replace(path_glob, '^\\^', ''), '\\$$', '') AS body FROM g)
SELECT p_partkey, path_glob, CASE WHEN len(regexp_replace(replace(body, '**', '*'), '[^*?]', '', 'g')) > 4 THEN 'complex'
  WHEN NOT regexp_matches(body, '[^*?/]') THEN 'blanket' ELSE 'ok' END AS refusal FROM b""")
def glob_audit(spark, sf):
    rows = views.table(spark, sf, "part").select("p_partkey", F.expr(GLOB).alias("path_glob"))
    return rows.withColumn("refusal", F.coalesce(globs.refusal_column(F.col("path_glob")), F.lit("ok")))


@query("oversized_lines", """
WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS t FROM pages)
SELECT page_id, count_if(length(t) > 8192)::BIGINT AS long_lines, max(length(t)) AS longest,
       sum(length(t))::BIGINT AS scanned_chars FROM l GROUP BY page_id""")
def oversized_lines(spark, sf):
    lines = views.pages_lines(spark, sf)
    return lines.groupBy(F.col("change_id").alias("page_id")).agg(
        F.count_if(F.length("text") > LONG_LINE_CHARS).alias("long_lines"),
        F.max(F.length("text")).cast("bigint").alias("longest"),
        F.sum(F.length(F.col("text"))).alias("scanned_chars"))


@query("pattern_matches", f"""
WITH {sql.DOC_LINES},
m AS (SELECT change_id, line_no, 'email' AS rule_id, regexp_extract_all(text, '{EMAIL}') AS vs FROM lines
      UNION ALL SELECT change_id, line_no, 'ipv4', regexp_extract_all(text, '{IP_SQL}') FROM lines)
SELECT change_id, line_no, rule_id, generate_subscripts(vs, 1) - 1 AS match_ord, md5(unnest(vs)) AS digest FROM m""")
def pattern_matches(spark, sf):
    lines = views.doc_lines(spark, sf)
    from ..functions.patterns import requirements, to_java
    found = F.array(*[F.struct(F.lit(n).alias("rule_id"), F.when(
        F.contains("text", F.lit(requirements(p)[0])), cand.matches(F.col("text"), to_java(p))).alias("vs"))
        for n, p in (("email", EMAIL), ("ipv4", IPV4))])
    rows = lines.select("change_id", "line_no", F.inline(found))
    return rows.where(F.size("vs") > 0).select("change_id", "line_no", "rule_id", F.posexplode("vs").alias("o", "v")).select(
        "change_id", "line_no", "rule_id", F.col("o").cast("bigint").alias("match_ord"), F.md5("v").alias("digest"))


@query("checksum_candidates", rf"""
WITH {sql.DOC_LINES},
m AS (SELECT change_id, line_no, regexp_extract_all(text, '{CANDIDATE_SQL}') AS vs FROM lines),
c AS (SELECT change_id, line_no, generate_subscripts(vs, 1) - 1 AS match_ord, unnest(vs) AS v FROM m)
SELECT change_id, line_no, match_ord, md5(v) AS digest, len(regexp_replace(v, '[^0-9]', '', 'g')) AS digits
FROM c WHERE regexp_matches(v, '[0-9]')""")
def checksum_candidates(spark, sf):
    lines = views.doc_lines(spark, sf).select("change_id", "line_no", F.posexplode_outer(
        cand.matches(F.col("text"), CANDIDATE_SQL)).alias("o", "v"))
    return lines.where(F.col("v").rlike("[0-9]")).select(
        "change_id", "line_no", F.col("o").cast("bigint").alias("match_ord"), F.md5("v").alias("digest"),
        F.length(checksums.digits_only(F.col("v"))).cast("bigint").alias("digits"))


SUB_RUNS = r"""
toks AS (SELECT *, list_filter(regexp_split_to_array(v, '\s+'), lambda t: t <> '') AS ts FROM c),
starts AS (SELECT *, unnest(range(1, len(ts) + 1)) AS s FROM toks WHERE len(ts) >= 2 AND len(regexp_replace(v, '[^0-9]', '', 'g')) >= 2),
runs AS (SELECT *, unnest(range(1, least(34 + len(list_filter(ts, lambda t: replace(t, '-', '') = '')), len(ts) - s + 1) + 1)) AS n FROM starts),
texts AS (SELECT *, array_to_string(ts[s:s + n - 1], ' ') AS run FROM runs),
subs AS (SELECT * FROM texts WHERE len(regexp_replace(run, '[\s-]', '', 'g')) BETWEEN 10 AND 34
         AND len(regexp_replace(run, '[^0-9]', '', 'g')) >= 2)
"""


@query("sub_candidates", rf"""
WITH {sql.DOC_LINES},
m AS (SELECT change_id, line_no, regexp_extract_all(text, '{CANDIDATE_SQL}') AS vs FROM lines),
c AS (SELECT change_id, line_no, generate_subscripts(vs, 1) - 1 AS match_ord, unnest(vs) AS v FROM m), {SUB_RUNS}
SELECT DISTINCT change_id, line_no, match_ord, md5(run) AS digest FROM subs""")
def sub_candidates(spark, sf):
    lines = views.doc_lines(spark, sf).select("change_id", "line_no", F.posexplode_outer(
        cand.matches(F.col("text"), CANDIDATE_SQL)).alias("o", "v"))
    lines = lines.where(F.col("v").rlike("[0-9].*[0-9]"))
    return lines.select("change_id", "line_no", F.col("o").cast("bigint").alias("match_ord"),
                        F.explode_outer(F.array_distinct(cand.token_runs(F.col("v")))).alias("run")).where(
        F.col("run").isNotNull()).select("change_id", "line_no", "match_ord", F.md5("run").alias("digest"))


STAMP = """concat('at ', date_format(o_orderdate, 'yyyy-MM-dd'), get(array('T', ' ', '-'), int(o_orderkey % 3)),
  lpad(string(o_orderkey % 30), 2, '0'), if(o_orderkey % 4 = 0, '', ':00:00Z'), ' end')"""


@query("timestamp_guard", r"""
WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || (['T', ' ', '-'])[o_orderkey % 3 + 1] || lpad((o_orderkey % 30)::VARCHAR, 2, '0') AS stamp,
                  o_orderkey % 4 <> 0 AS cut, o_orderkey % 30 <= 23 AS real_hour FROM orders)
SELECT o_orderkey, md5(CASE WHEN cut THEN 'at ' || stamp ELSE 'at ' || stamp || ' end' END) AS digest, cut,
       cut AND real_hour AS stamp_skipped FROM t""")
def timestamp_guard(spark, sf):
    rows = views.spread(spark, sf, "orders").select("o_orderkey", F.expr(STAMP).alias("text"))
    rows = rows.select("o_orderkey", F.explode(cand.matches_with_cut(F.col("text"), CANDIDATE_SQL)).alias("m"))
    return rows.select("o_orderkey", F.md5("m.value").alias("digest"), F.col("m.cut").alias("cut"),
                       (F.col("m.cut") & cand.is_date(F.regexp_replace("m.value", "^at ", ""))).alias("stamp_skipped"))


# Identifiers with computed check digits, right for most rows and spoiled for every fifth.
IBAN_TEXT = """concat('pay DE', lpad(string(98 - cast(concat(lpad(string(c_custkey * 7919 % 99999999), 8, '0'), lpad(string(c_custkey), 10, '0'), '131400') as decimal(38,0)) % 97 + if(c_custkey % 5 = 0, 1, 0)), 2, '0'),
  if(c_custkey % 2 = 0, ' ', ''), lpad(string(c_custkey * 7919 % 99999999), 8, '0'), if(c_custkey % 2 = 0, '-', ''), lpad(string(c_custkey), 10, '0'), ' now')"""


@query("iban_scan", r"""
WITH t AS (SELECT c_custkey, lpad((c_custkey * 7919 % 99999999)::VARCHAR, 8, '0') AS bank, lpad(c_custkey::VARCHAR, 10, '0') AS acct FROM customer),
k AS (SELECT *, lpad((98 - ((bank || acct || '131400')::HUGEINT % 97) + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END)::VARCHAR, 2, '0') AS chk FROM t),
i AS (SELECT *, 'DE' || chk || bank || acct AS iban FROM k)
SELECT c_custkey, (bank || acct || '1314' || chk)::HUGEINT % 97 = 1 AND len(iban) = 22 AS valid,
       CASE WHEN (bank || acct || '1314' || chk)::HUGEINT % 97 = 1 AND len(iban) = 22 THEN md5(iban) END AS digest FROM i""")
def iban_scan(spark, sf):
    rows = views.spread(spark, sf, "customer").select("c_custkey", F.expr(IBAN_TEXT).alias("text"))
    rows = rows.select("c_custkey", _first_valid("iban").alias("found"))
    return rows.select("c_custkey", F.col("found").isNotNull().alias("valid"), F.md5(checksums.compact(F.col("found"))).alias("digest"))


@query("card_scan", rf"""
WITH {sql.DOC_LINES},
m AS (SELECT change_id, file, line_no, regexp_extract_all(text, '{CANDIDATE_SQL}') AS vs FROM lines),
c AS (SELECT change_id, file, line_no, generate_subscripts(vs, 1) - 1 AS match_ord, unnest(vs) AS v FROM m), {SUB_RUNS},
every AS (SELECT change_id, file, line_no, match_ord, 0 AS s, 0 AS n, v AS run FROM c UNION ALL
          SELECT change_id, file, line_no, match_ord, s, n, run FROM subs),
digits AS (SELECT *, regexp_replace(run, '[^0-9]', '', 'g') AS d FROM every),
good AS (SELECT * FROM digits WHERE {sql.card_ok('d', CARD_RANGES, CARD_LENGTHS, CARD_NO_LUHN)}),
first AS (SELECT *, row_number() OVER (PARTITION BY change_id, line_no, match_ord ORDER BY s, n) AS k FROM good),
ev AS (SELECT DISTINCT change_id, 'card-number @ ' || file || ':' || line_no AS masked_evidence FROM first WHERE k = 1)
SELECT d.doc_id AS change_id, CASE WHEN count(masked_evidence) > 0 THEN 'fail' ELSE 'pass' END AS verdict,
       count(masked_evidence) AS n_findings, min(masked_evidence) AS first_evidence
FROM documents d LEFT JOIN ev ON ev.change_id = d.doc_id GROUP BY ALL""")
def card_scan(spark, sf):
    """Card numbers in every document: candidates, issuer and Luhn, masked evidence, a verdict per document."""
    from ..operators.findings import deduplicated
    from ..operators.rules import compile_rulesets
    from .rulesets import rule
    rulesets = compile_rulesets(spark, [{"framework": "Data Compliance", "rules": [
        rule("card", "block", 1, method="checksum", validator=["credit_card"], mask="card-number")]}])
    found = deduplicated(detect.line_hits(views.doc_lines(spark, sf), rulesets), rulesets)
    per_doc = found.groupBy("change_id").agg(F.count("*").alias("n"), F.min("evidence").alias("first_evidence"))
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("change_id"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return docs.join(per_doc, "change_id", "left").select(
        "change_id", F.when(n > 0, "fail").otherwise("pass").alias("verdict"), n.alias("n_findings"), "first_evidence")



def _first_valid(validator: str):
    """The first identifier in ``text`` that a validator accepts, among all matches and their token runs."""
    passing = f"transform({cand.matches_with_cut_sql('text', CANDIDATE_SQL)}, m -> {cand.first_passing_sql([validator], 'm.value', 'm.cut')})"
    return F.expr(f"get(filter({passing}, v -> v is not null), 0)")


@query("svnr_scan", r"""
WITH t AS (SELECT l_orderkey, l_linenumber, lpad((l_orderkey % 1000)::VARCHAR, 3, '0') AS run,
                  lpad((l_partkey % 32)::VARCHAR, 2, '0') || lpad((l_suppkey % 14)::VARCHAR, 2, '0') || lpad((l_orderkey % 100)::VARCHAR, 2, '0') AS dmy,
                  l_partkey % 32 AS dd, l_suppkey % 14 AS mm, l_orderkey % 100 AS yy FROM lineitem),
s AS (SELECT *, (substr(run,1,1)::INT*3 + substr(run,2,1)::INT*7 + substr(run,3,1)::INT*9 + substr(dmy,1,1)::INT*5 + substr(dmy,2,1)::INT*8
  + substr(dmy,3,1)::INT*4 + substr(dmy,4,1)::INT*2 + substr(dmy,5,1)::INT*1 + substr(dmy,6,1)::INT*6) % 11 AS r FROM t),
v AS (SELECT *, r % 10 AS chk, r <= 9 AND mm BETWEEN 1 AND 12 AND dd BETWEEN 1 AND
  CASE WHEN mm = 2 THEN CASE WHEN yy % 4 = 0 THEN 29 ELSE 28 END WHEN mm IN (4, 6, 9, 11) THEN 30 ELSE 31 END AS valid FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN valid THEN md5(run || chk || dmy) END AS digest, valid FROM v""")
def svnr_scan(spark, sf):
    rows = views.spread(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("""named_struct(
        'run', lpad(string(l_orderkey % 1000), 3, '0'), 'dmy', concat(lpad(string(l_partkey % 32), 2, '0'),
        lpad(string(l_suppkey % 14), 2, '0'), lpad(string(l_orderkey % 100), 2, '0')))""").alias("p"))
    total = sum((F.substring(F.concat("p.run", "p.dmy"), i + 1, 1).cast("int") * w
                 for i, w in enumerate((3, 7, 9, 5, 8, 4, 2, 1, 6))), F.lit(0))
    rows = rows.withColumn("value", F.concat("p.run", (total % 11 % 10).cast("string"), "p.dmy"))
    rows = rows.withColumn("text", F.concat(F.lit("insured, no. "), "value", F.lit(" as of now.")))
    rows = rows.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), _first_valid("svnr").alias("found"))
    return rows.select("l_orderkey", "l_linenumber", F.md5(checksums.digits_only(F.col("found"))).alias("digest"), F.col("found").isNotNull().alias("valid"))


@query("steuer_id_scan", r"""
WITH t AS (SELECT o_orderkey, (1000000000 + o_orderkey * 104729 % 8999999999)::VARCHAR AS ten FROM orders),
p AS (SELECT *, list_reduce(list_prepend(10, list_transform(string_split(ten, ''), lambda c: c::INT)), lambda acc, d:
   (CASE WHEN (d + acc) % 10 = 0 THEN 10 ELSE (d + acc) % 10 END * 2) % 11) AS prod FROM t)
SELECT o_orderkey, CASE WHEN NOT (o_orderkey % 6 = 0 AND (11 - prod) % 10 < 9) THEN md5(ten || ((11 - prod) % 10)) END AS digest,
       NOT (o_orderkey % 6 = 0 AND (11 - prod) % 10 < 9) AS valid FROM p""")
def steuer_id_scan(spark, sf):
    rows = views.spread(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") * 104729 % 8999999999 + 1000000000).cast("string").alias("ten"))
    # The one check digit that validates, found by offering all ten to the validator.
    digit = F.get(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: checksums.steuer_id(
        F.concat(F.col("ten"), d.cast("string")))), F.lit(0))
    rows = rows.withColumn("digit", digit)
    spoiled = F.when((F.col("o_orderkey") % 6 == 0) & (F.col("digit") < 9), F.col("digit") + 1).otherwise(F.col("digit"))
    rows = rows.select("o_orderkey", F.concat(F.lit("tax id "), "ten", spoiled.cast("string"), F.lit(" on file; ref 12")).alias("text"))
    rows = rows.select("o_orderkey", _first_valid("steuer_id").alias("found"))
    return rows.select("o_orderkey", F.md5(checksums.digits_only(F.col("found"))).alias("digest"), F.col("found").isNotNull().alias("valid"))


@query("synthetic_suppressed", f"""
WITH {sql.DOC_LINES},
m AS (SELECT change_id, line_no, unnest(regexp_extract_all(text, '{EMAIL}')) AS v FROM lines
      UNION ALL SELECT c_custkey, 0, lower(c_mktsegment) || (['@example.com', '@test.io', '.localhost', '@mail.net', '@sub.example.org'])[c_custkey % 5 + 1] FROM customer)
SELECT change_id, line_no, md5(v) AS digest, {sql._SYNTHETIC} AS synthetic FROM m""")
def synthetic_suppressed(spark, sf):
    mails = views.doc_lines(spark, sf).where(F.contains("text", F.lit("@"))).select(
        "change_id", "line_no", F.explode(cand.matches(F.col("text"), EMAIL)).alias("v"))
    made = views.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("change_id"), F.lit(0).cast("bigint").alias("line_no"), F.expr(
            "concat(lower(c_mktsegment), get(array('@example.com', '@test.io', '.localhost', '@mail.net', '@sub.example.org'), int(c_custkey % 5)))").alias("v"))
    rows = mails.unionByName(made)
    return rows.select("change_id", "line_no", F.md5("v").alias("digest"), allowlist.is_synthetic(F.col("v")).alias("synthetic"))


ALLOW_VALUE = """concat(get(array('Mail', 'IT', 'ops'), int(o_orderkey % 3)), string(o_custkey % 50), '@', lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '')), '.org')"""


@query("allowlist_anti", """
WITH v AS (SELECT o_orderkey, (['Mail', 'IT', 'ops'])[o_orderkey % 3 + 1] || (o_custkey % 50) || '@' || lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) || '.org' AS v FROM orders),
a AS (SELECT DISTINCT 'mail' || (c_custkey % 20) || '@low.org' AS e FROM customer), d AS (SELECT DISTINCT lower(n) || '.org' AS e FROM (VALUES ('HIGH'), ('URGENT')) x(n))
SELECT o_orderkey, md5(v) AS digest FROM v WHERE lower(v) NOT IN (SELECT e FROM a) AND split_part(lower(v), '@', 2) NOT IN (SELECT e FROM d)""")
def allowlist_anti(spark, sf):
    hits = views.spread(spark, sf, "orders").select("o_orderkey", F.expr(ALLOW_VALUE).alias("value"))
    mails = views.table(spark, sf, "customer").select(F.lit("emails").alias("kind"), F.expr(
        "concat('mail', string(c_custkey % 20), '@low.org')").alias("entry"))
    domains = views.table(spark, sf, "customer").select(F.lit("domains").alias("kind"), F.explode(F.array(
        F.lit("high.org"), F.lit("urgent.org"))).alias("entry"))
    entries = mails.unionByName(domains).distinct()
    return allowlist.without_listed(hits, entries).select("o_orderkey", F.md5("value").alias("digest"))


MAIL = """get(array(concat(lower(c_mktsegment), '.', string(c_custkey), '@', lower(c_mktsegment), '.co.', lower(substr(c_mktsegment, 1, 2))),
 concat('@', c_name), concat(c_name, '@'), c_name, concat(substr(c_name, 1, 1), '@host.'), '  '), int(c_custkey % 6))"""
MAIL_SQL = """([lower(c_mktsegment) || '.' || c_custkey || '@' || lower(c_mktsegment) || '.co.' || lower(left(c_mktsegment, 2)),
 '@' || c_name, c_name || '@', c_name, left(c_name, 1) || '@host.', '  '])[c_custkey % 6 + 1]"""


@query("mask_email", f"""
WITH v AS (SELECT c_custkey, {MAIL_SQL} AS v FROM customer), p AS (SELECT *, instr(v, '@') AS a FROM v)
SELECT c_custkey, CASE WHEN a > 1 AND a < len(v) THEN left(v, 1) || '***@***' ||
   CASE WHEN contains(v[a + 1:], '.') AND right(v, 1) <> '.' THEN '.' || list_last(string_split(v[a + 1:], '.')) ELSE '' END
  WHEN len(trim(v)) > 1 THEN left(trim(v), 1) || '***' ELSE '***' END AS masked FROM p""")
def mask_email(spark, sf):
    rows = views.table(spark, sf, "customer").select("c_custkey", F.expr(MAIL).alias("v"))
    return rows.select("c_custkey", masking.mask_email(F.col("v")).alias("masked"))


@query("mask_generic", """
WITH v AS (SELECT o_orderkey, repeat(' ', (o_orderkey % 3)::INT) || left(o_orderpriority, (o_orderkey % 5)::INT) || repeat(chr(9), (o_orderkey % 2)::INT) AS v FROM orders),
t AS (SELECT *, trim(v, ' ' || chr(9)) AS s FROM v)
SELECT o_orderkey, CASE WHEN len(s) > 1 THEN left(s, 1) || '***' ELSE '***' END AS masked FROM t""")
def mask_generic(spark, sf):
    rows = views.table(spark, sf, "orders").select("o_orderkey", F.expr(
        "concat(repeat(' ', int(o_orderkey % 3)), left(o_orderpriority, int(o_orderkey % 5)), repeat(chr(9), int(o_orderkey % 2)))").alias("v"))
    return rows.select("o_orderkey", masking.mask_generic(F.col("v")).alias("masked"))


@query("evidence", r"""
WITH v AS (SELECT page_id, 'page|' || (page_id % 3) || chr(10) || '`x`' AS label, url AS file, (['ref', '', 'zz', 'example'])[page_id % 4 + 1] AS raw,
                  CASE WHEN page_id % 5 = 0 THEN NULL ELSE page_id % 100 END AS line FROM pages),
s AS (SELECT *, trim(regexp_replace(regexp_replace(label, '[\r\n\t]+', ' ', 'g'), '[|`]', ' ', 'g')) AS l,
                trim(regexp_replace(regexp_replace(repeat(file || '/', 6), '[\r\n\t]+', ' ', 'g'), '[|`]', ' ', 'g')) AS f FROM v),
e AS (SELECT *, l || ' @ ' || f || coalesce(':' || line, '') AS t FROM s)
SELECT page_id, CASE WHEN raw <> '' THEN replace(t, raw, '***') ELSE t END AS evidence FROM e""")
def evidence(spark, sf):
    rows = views.table(spark, sf, "pages").select("page_id", "url", F.expr("""named_struct(
        'label', concat('page|', string(page_id % 3), chr(10), '`x`'), 'raw', get(array('ref', '', 'zz', 'example'), int(page_id % 4)),
        'line', if(page_id % 5 = 0, null, page_id % 100))""").alias("v"))
    return rows.select("page_id", masking.evidence(F.col("v.label"), F.col("v.raw"), F.repeat(F.concat("url", F.lit("/")), 6), F.col("v.line")).alias("evidence"))


@query("group_digits", r"""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_orderkey * 1000003 + l_partkey)::VARCHAR || repeat(l_suppkey::VARCHAR, l_linenumber % 4) AS run FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, '12345678 m @ db/' || CASE WHEN len(run) >= 8 THEN
  array_to_string(list_transform(range(0, ((len(run) + 3) // 4)::BIGINT), lambda i: substr(run, i * 4 + 1, 4)), '·') ELSE run END || '_x.sql' AS grouped
FROM v""")
def group_digits(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey",
        F.expr("concat(string(l_orderkey * 1000003 + l_partkey), repeat(string(l_suppkey), l_linenumber % 4))").alias("run"))
    text = F.concat(F.lit("12345678 m @ db/"), "run", F.lit("_x.sql"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", masking.group_digits(text).alias("grouped"))


@query("safe_labels", r"""
WITH v AS (SELECT doc_id, lang || '/' || text AS v FROM documents)
SELECT doc_id, '`' || regexp_replace(v, '[^\p{L}\p{N}._/@+-]', '_', 'g') || '`' AS path_label,
       regexp_replace(v, '[^A-Za-z0-9._:/@+-]', '_', 'g') AS rule_label FROM v""")
def safe_labels(spark, sf):
    rows = views.table(spark, sf, "documents").select("doc_id", F.concat("lang", F.lit("/"), "text").alias("v"))
    return rows.select("doc_id", masking.safe_path(F.col("v")).alias("path_label"), masking.safe_rule_id(F.col("v")).alias("rule_label"))


@query("markdown_cells", r"""
WITH v AS (SELECT page_id, 'a|b\|' || html AS v FROM pages),
c AS (SELECT page_id, trim(replace(replace(regexp_replace(v, '[\r\n]+', ' ', 'g'), '\', '\\'), '|', '\|')) AS cell,
             replace(trim(regexp_replace(regexp_replace(v, '[`\r\n]+', ' ', 'g'), '\s+', ' ', 'g')), '|', '\|') AS span FROM v)
SELECT page_id, cell, '`' || span || '`' AS span FROM c""")
def markdown_cells(spark, sf):
    rows = views.table(spark, sf, "pages").select("page_id", F.concat(F.lit("a|b\\|"), "html").alias("v"))
    return rows.select("page_id", masking.markdown_cell(F.col("v")).alias("cell"), masking.code_span(F.col("v")).alias("span"))


@query("scrub_urls", r"""
WITH v AS (SELECT page_id, 'fetch ' || replace(url, '://', '://user' || page_id || ':pw@') || ' failed; ' || repeat('retry ', (page_id % 120)::INT) AS v FROM pages),
c AS (SELECT page_id, regexp_replace(v, '(?i)(\b[a-z][a-z0-9+.-]*://)[^\s/@''"]+@', '\1', 'g') AS s FROM v)
SELECT page_id, s AS message FROM c""")
def scrub_urls(spark, sf):
    rows = views.table(spark, sf, "pages").select("page_id", F.expr(
        "concat('fetch ', replace(url, '://', concat('://user', page_id, ':pw@')), ' failed; ', repeat('retry ', int(page_id % 120)))").alias("v"))
    return rows.select("page_id", masking.scrub_urls(F.col("v")).alias("message"))


META = """
 if(o_orderkey % 11 = 0, 'false', 'true') ci_system, if(o_orderkey % 13 = 0, 'push', 'merge_request_event') pipeline_source,
 case when o_orderkey % 17 = 0 then '12x' when o_orderkey % 19 = 0 then '0' when o_orderkey % 23 = 0 then '2147483648' else concat(' ', o_orderkey + 1, ' ') end iid,
 case when o_orderkey % 3 = 0 then '' else concat('group/', lower(o_orderpriority)) end mr_project_path,
 case when o_orderkey % 6 = 0 then '' else concat('org/p', o_custkey) end project_path,
 if(o_orderkey % 29 = 0, '', sha1(string(o_orderkey))) commit_sha, if(o_orderkey % 4 = 0, sha1(string(o_custkey)), '') source_branch_sha,
 case when o_orderkey % 7 = 0 then 'HEAD~1' when o_orderkey % 31 = 0 then ' ' else upper(sha1(string(o_orderkey + 1))) end diff_base_sha"""
META_SQL = """
 CASE WHEN o_orderkey % 11 = 0 THEN 'false' ELSE 'true' END AS ci_system, CASE WHEN o_orderkey % 13 = 0 THEN 'push' ELSE 'merge_request_event' END AS pipeline_source,
 case when o_orderkey % 17 = 0 then '12x' when o_orderkey % 19 = 0 then '0' when o_orderkey % 23 = 0 then '2147483648' else ' ' || (o_orderkey + 1) || ' ' end iid,
 case when o_orderkey % 3 = 0 then '' else 'group/' || lower(o_orderpriority) end mr_project_path,
 case when o_orderkey % 6 = 0 then '' else 'org/p' || o_custkey end project_path,
 CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE sha1(o_orderkey::VARCHAR) END AS commit_sha, CASE WHEN o_orderkey % 4 = 0 THEN sha1(o_custkey::VARCHAR) ELSE '' END AS source_branch_sha,
 case when o_orderkey % 7 = 0 then 'HEAD~1' when o_orderkey % 31 = 0 then ' ' else upper(sha1((o_orderkey + 1)::VARCHAR)) end diff_base_sha"""


@query("change_metadata_errors", rf"""
WITH m AS (SELECT o_orderkey, {META_SQL} FROM orders),
r AS (SELECT *, coalesce(nullif(mr_project_path, ''), project_path) AS repo, coalesce(nullif(source_branch_sha, ''), commit_sha) AS head_sha FROM m)
SELECT o_orderkey, repo, head_sha, CASE WHEN ci_system <> 'true' THEN 'not-ci' WHEN pipeline_source <> 'merge_request_event' THEN 'not-merge-request'
  WHEN NOT regexp_full_match(trim(iid), '[0-9]+') OR try_cast(trim(iid) AS BIGINT) NOT BETWEEN 1 AND 2147483647 THEN 'bad-number'
  WHEN repo = '' THEN 'missing-repo' WHEN NOT regexp_full_match(repo, '[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)+') THEN 'bad-repo'
  WHEN head_sha = '' THEN 'missing-head' WHEN NOT regexp_full_match(head_sha, '[0-9a-fA-F]{{40}}|[0-9a-fA-F]{{64}}') THEN 'bad-head'
  WHEN trim(diff_base_sha) = '' THEN 'missing-base' WHEN NOT regexp_full_match(diff_base_sha, '[0-9a-fA-F]{{40}}|[0-9a-fA-F]{{64}}') THEN 'bad-base' ELSE 'ok' END AS reason FROM r""")
def change_metadata_errors(spark, sf):
    rows = views.table(spark, sf, "orders").selectExpr("o_orderkey", *[c.strip() for c in _split_columns(META)])
    rows = rows.withColumn("description_truncated", F.lit("false"))
    return checked_metadata(rows).select("o_orderkey", "repo", "head_sha", F.coalesce("reason", F.lit("ok")).alias("reason"))


def _split_columns(text: str) -> list[str]:
    """Top-level comma split of a select list."""
    out, depth, current = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(current)
            current = ""
        else:
            current += ch
    return [*out, current]


@query("tree_lines", r"""
WITH t AS (SELECT page_id, unnest(string_split(html, chr(10))) AS t, generate_subscripts(string_split(html, chr(10)), 1) - 1 AS pos FROM pages WHERE page_id % 10 <> 3)
SELECT 'site/' || page_id || '.html' AS path, pos, md5(t) AS digest FROM t""")
def tree_lines_query(spark, sf):
    tree = views.tree(spark, sf, lambda html: F.when(F.col("page_id") % 10 == 3, F.concat(F.lit(chr(0)), html)).otherwise(html))
    return tree_lines(tree).select(F.concat(F.lit("site/"), F.regexp_extract("path", r"([0-9]+)\.[a-z.]+$", 1), F.lit(".html")).alias("path"),
                                   F.col("pos").cast("bigint").alias("pos"), F.md5("text").alias("digest"))
