"""Plain-SQL restatements of the input views, shared by the oracle queries."""

DOC_LINES = """
lines AS (
  SELECT doc_id AS change_id, source || '/' || lang || '/' || doc_id || '.md' AS file,
         i - 1 AS pos, i AS line_no, l AS text, 'added' AS side, 0 AS side_ord
  FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS l,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
"""

_PATHS = "['src/app', 'docs/guide', 'lib/core', 'dist/out', 'src/x.min']"
_PATH = f"({_PATHS})[(doc_id + (i - 1) // 12) % 5 + 1] || ((i - 1) // 12) || '.ts'"

CHANGES = f"""
changes AS (
  SELECT doc_id AS change_id, 'org/' || source AS repo, 'github' AS provider, doc_id + 1 AS pr_number,
         sha1(doc_id::VARCHAR) AS commit_sha, parts[len(parts)] AS description,
         'diff --git a/README.md b/README.md' || chr(10) || 'index 1..2 100644' || chr(10) ||
         array_to_string(list_transform(parts, lambda l, i:
           CASE WHEN (i - 1) % 12 = 0 THEN
             'diff --git a/' || {_PATH} || ' b/' || {_PATH} || chr(10) ||
             '--- a/' || {_PATH} || chr(10) || '+++ b/' || {_PATH} || chr(10) ELSE '' END ||
           CASE WHEN (i - 1) % 4 = 0 THEN
             '@@ -' || (10 * (i - 1) + 1) || ',4 +' || (10 * (i - 1) + 3) || ',4 @@' || chr(10) ELSE '' END ||
           (['-', '+', '+', ' ', '-'])[(doc_id + i - 1) % 5 + 1] || l), chr(10)) AS diff
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))
"""

# The diff state machine as running windows, written independently of the Spark plan.
PARSED = CHANGES + """,
raw AS (
  SELECT change_id, unnest(string_split(diff, chr(10))) AS raw,
         generate_subscripts(string_split(diff, chr(10)), 1) - 1 AS pos FROM changes),
tagged AS (
  SELECT *, CASE WHEN regexp_matches(raw, '^diff --git a/.+? b/.+$') THEN 'G'
                 WHEN regexp_matches(raw, '^[+]{3} b/.+$') THEN 'N'
                 WHEN regexp_matches(raw, '^--- a/.+$') THEN 'O'
                 WHEN regexp_matches(raw, '^@@ -[0-9]+(,[0-9]+)? [+][0-9]+(,[0-9]+)? @@') THEN 'H'
                 WHEN regexp_matches(raw, '^(index |new file mode|deleted file mode|old mode|new mode|similarity index|rename from|rename to|Binary files|\\\\ No newline)') THEN 'M'
                 ELSE 'C' END AS k FROM raw),
sections AS (
  SELECT *, sum((k = 'G')::INT) OVER w AS sec,
         last_value(CASE WHEN k = 'G' THEN regexp_extract(raw, '^diff --git a/.+? b/(.+)$', 1)
                         WHEN k = 'N' THEN regexp_extract(raw, '^[+]{3} b/(.+)$', 1) END IGNORE NULLS) OVER w AS file
  FROM tagged WINDOW w AS (PARTITION BY change_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
hunked AS (
  SELECT *, sum((k = 'H')::INT) OVER (PARTITION BY change_id, sec ORDER BY pos ROWS UNBOUNDED PRECEDING) AS hunk
  FROM sections),
numbered AS (
  SELECT *, sum((k = 'C' AND left(raw, 1) <> '+')::INT) OVER h AS old_n,
         sum((k = 'C' AND left(raw, 1) <> '-')::INT) OVER h AS new_n,
         max(CASE WHEN k = 'H' THEN regexp_extract(raw, '^@@ -([0-9]+)', 1)::BIGINT END) OVER h AS old_start,
         max(CASE WHEN k = 'H' THEN regexp_extract(raw, '[+]([0-9]+)(,[0-9]+)? @@', 1)::BIGINT END) OVER h AS new_start
  FROM hunked WINDOW h AS (PARTITION BY change_id, sec, hunk ORDER BY pos ROWS UNBOUNDED PRECEDING)),
diff_lines AS (
  SELECT change_id, pos, file, hunk - 1 AS hunk_index,
         CASE left(raw, 1) WHEN '+' THEN 'added' WHEN '-' THEN 'removed' ELSE 'context' END AS side,
         CASE left(raw, 1) WHEN '-' THEN old_start + old_n - 1 ELSE new_start + new_n - 1 END AS line_no,
         CASE WHEN left(raw, 1) IN ('+', '-', ' ') THEN raw[2:] ELSE raw END AS text
  FROM numbered WHERE k = 'C' AND hunk > 0)
"""

_EXCLUDED = "regexp_matches(file, '(^|/)(package-lock[.]json$|yarn[.]lock$|dist/|build/|vendor/|node_modules/)|[.]min[.][^/]*$')"
_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
_SYNTHETIC = r"regexp_matches(lower(v), '@example\.(com|org|net)$|(^|@)example\.(com|org|net)$|^test@|@test\.|\bexample\.(com|org|net)\b|\blocalhost\b')"

LUHN = """list_sum(list_transform(string_split(reverse(v), ''), lambda d, i:
  CASE WHEN i % 2 = 0 THEN (d::INT * 2) // 10 + (d::INT * 2) % 10 ELSE d::INT END)) % 10 = 0"""


def card_network(v: str, ranges) -> str:
    """Issuer of a digit string by the longest matching prefix, as a CASE over the fixed table."""
    ranked = sorted(ranges, key=lambda r: -len(r[1]))
    arms = " ".join(f"WHEN left({v}, {len(lo)}) BETWEEN '{lo}' AND '{hi}' THEN '{n}'" for n, lo, hi in ranked)
    return f"CASE {arms} END"


def card_ok(v: str, ranges, lengths, no_luhn) -> str:
    """Issuer, length and Luhn of a digit string named ``v``."""
    arms = " ".join(f"WHEN '{n}' THEN len({v}) IN ({', '.join(map(str, s))})" for n, s in lengths.items())
    network = card_network(v, ranges)
    skip = ", ".join(f"'{n}'" for n in no_luhn)
    return (f"(len({v}) BETWEEN 12 AND 19 AND coalesce(CASE {network} {arms} END, false) "
            f"AND ({network} IN ({skip}) OR {LUHN.replace('reverse(v)', f'reverse({v})')}))")


CONTEXTS = """
ctx AS (SELECT doc_id AS change_id, quality = 1 AS quality, CASE WHEN doc_id % 7 <> 0 THEN toxic = 1 END AS toxic FROM labels)
"""

_MASKED_MAIL = "'e-mail (' || left(v, 1) || '***@***.' || list_last(string_split(v, '.')) || ')'"


def _values(fw, ro, rule_id, pattern, label, action, where="true", keep="true") -> str:
    """Hits of one line rule: every match of every line it applies to."""
    return f"""
  SELECT change_id, {fw} AS fw, {ro} AS ro, '{rule_id}' AS rule_id, so, pos, mo, {action} AS action, {label} AS label, v, file, line_no, side
  FROM (SELECT *, unnest(vs) AS v, generate_subscripts(vs, 1) AS mo FROM
        (SELECT *, regexp_extract_all(t, '{pattern}') AS vs FROM sl WHERE NOT ex AND ({where}))) WHERE {keep}"""


def _rules(card: str, sound: bool, context: bool) -> list[str]:
    ipv4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
    endpoint, imports = "'review'", "'block'"
    if context:
        endpoint = "CASE WHEN quality AND NOT toxic THEN 'advise' ELSE 'review' END"
        imports = "CASE WHEN toxic THEN 'review' WHEN quality THEN 'advise' ELSE 'block' END"
    out = [
        _values(0, 0, "card", r"\b[0-9]{13,19}\b", "'card-number'", "'block'", keep=card),
        _values(0, 3, "email", _EMAIL, _MASKED_MAIL, "'review'"),
        _values(0, 4, "email-real", _EMAIL, _MASKED_MAIL, "'review'", "side = 'added'",
                f"NOT {_SYNTHETIC} AND lower(v) <> 'un.1@mail1.example.com' AND split_part(lower(v), '@', -1) <> 'mail7.example.com'"),
        _values(0, 5, "ipv4", ipv4, "'ip-address'", "'review'", r"NOT regexp_matches(file, 'docs/|[^/]*\.lock$')"),
        _values(0, 6, "secret", r"(?i)token\s*=", "'secret'",
                "CASE WHEN regexp_matches(t, '(?i)idiot|und|the') THEN 'block' ELSE 'review' END",
                "regexp_matches(file, 'src[^/]*/.*|^lib/')"),
        """
  SELECT change_id, 0, 7, 'license', so, pos, 0, 'advise', 'license-text:' || v, v, file, line_no, side FROM
    (SELECT *, CASE WHEN contains(t, 'License') THEN 'License' WHEN contains(t, 'Copyright') THEN 'Copyright'
                    WHEN contains(t, 'MIT') THEN 'MIT' END AS v FROM sl WHERE NOT ex) WHERE v IS NOT NULL""",
        _values(0, 8, "gated-ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "'gated-ip'", "'review'",
                r"side = 'added' AND NOT regexp_matches(t, '(?i)\bder\b') AND regexp_matches(t, '[aeiou]{3}')"),
        _values(1, 0, "eaa-ci-ai-endpoint", r"(?i)\b(machine|model|mention|tion)\b", "'ai-endpoint'", endpoint),
        _values(1, 1, "eaa-ci-ai-import", "[0-9]{13,}", "'ai-import'", imports, "side = 'added'"),
        _values(1, 2, "odd-context", "token", "'odd'", "'review'", "side = 'added'"),
    ]
    if not sound:
        out.append(_values(0, 9, "tier1-gated", "[0-9]{16}", "'long-number'", "'block'", "side = 'added'"))
    return out


# Every pair, built: what the window plan must agree with.
_PAIRS = r"""
  SELECT m.change_id, 0, 10, 'swapped', 0, m.pos * 100000 + p.pos, 0,
         CASE WHEN m.hunk_index = p.hunk_index THEN 'block' ELSE 'review' END,
         'safeguard-removed' || CASE WHEN m.hunk_index = p.hunk_index THEN ' (same-hunk)' ELSE ' (cross-hunk)' END, m.text, p.file, p.line_no, 'added'
  FROM sl m JOIN sl p ON m.change_id = p.change_id AND m.file = p.file
  WHERE m.side = 'removed' AND p.side = 'added' AND NOT m.ex AND regexp_matches(m.t, '(?i)token') AND regexp_matches(p.t, '(?i)license|[0-9]{6}')
  UNION ALL
  SELECT m.change_id, 0, 11, 'swapped-hunk', 0, m.pos * 100000 + p.pos, 0, 'block', 'article-swapped (same-hunk)', m.text, p.file, p.line_no, 'added'
  FROM sl m JOIN sl p ON m.change_id = p.change_id AND m.file = p.file AND m.hunk_index = p.hunk_index
  WHERE m.side = 'removed' AND p.side = 'added' AND NOT m.ex AND regexp_matches(m.t, '\bthe\b') AND regexp_matches(p.t, '\bof\b.*\b(and|in)\b')
    AND (regexp_matches(m.t, '[0-9]') OR regexp_matches(p.t, '[0-9]'))"""

_DESCRIBED = r"""
  SELECT change_id, 0, 12, 'mentions', 0, 0, 0, 'review', 'mention', v, 'PR description', NULL, NULL
  FROM (SELECT change_id, unnest(regexp_extract_all(description, '(?i)\b(the|und|los)\b')) AS v FROM changes
        WHERE NOT regexp_matches(description, '(?i)tion\b'))"""


def scan(kind: str, card: str, sound: bool = True) -> str:
    """CTEs ``findings`` (and ``sl``, ``hits``) of the demo rules over ``docs`` or ``changes``."""
    if kind == "docs":
        base = DOC_LINES + f", sl AS (SELECT *, 0 AS hunk_index, text AS t, 0 AS so, {_EXCLUDED} AS ex FROM lines)"
        rules = _rules(card, sound, False)
    else:
        base = PARSED + "," + CONTEXTS + f""",
sl AS (SELECT d.*, quality, toxic, text AS t, (side = 'removed')::INT AS so, {_EXCLUDED} AS ex
       FROM diff_lines d LEFT JOIN ctx USING (change_id) WHERE side <> 'context')"""
        rules = [*_rules(card, sound, True), _PAIRS, _DESCRIBED]
    return base + f""",
hits AS ({" UNION ALL ".join(rules)}),
shown AS (SELECT *, label || ' @ ' || file || coalesce(':' || line_no, '') AS ev FROM hits),
masked AS (SELECT *, CASE WHEN trim(v) <> '' THEN replace(ev, trim(v), '***') ELSE ev END AS masked_evidence FROM shown),
firsts AS (SELECT *, row_number() OVER (PARTITION BY change_id, fw, rule_id, masked_evidence ORDER BY ro, so, pos, mo) AS k FROM masked),
findings AS (
  SELECT change_id, CASE fw WHEN 0 THEN 'Data Compliance' ELSE 'EU AI Act' END AS framework, fw,
         row_number() OVER (PARTITION BY change_id, fw ORDER BY ro, so, pos, mo) AS finding_ord, rule_id, action, masked_evidence,
         CASE WHEN file <> 'PR description' THEN file END AS file, CASE WHEN side <> 'removed' THEN line_no END AS line
  FROM firsts WHERE k = 1)
"""


VERDICTS = """
fws AS (SELECT * FROM (VALUES (0, 'Data Compliance', 7, 'demo-data-7'), (1, 'EU AI Act', 3, 'demo-ai-3')) f(fw, framework, ruleset_version, ruleset_hash)),
counts AS (SELECT change_id, fw, count_if(action = 'block') AS n_block, count_if(action = 'review') AS n_review, count_if(action = 'advise') AS n_advise
           FROM findings GROUP BY ALL),
verdicts AS (
  SELECT d.doc_id AS change_id, f.fw, f.framework, f.ruleset_version, f.ruleset_hash, coalesce(n_block, 0)::BIGINT AS n_block,
         coalesce(n_review, 0)::BIGINT AS n_review, coalesce(n_advise, 0)::BIGINT AS n_advise, d.text IS NULL AS incomplete,
         CASE WHEN n_block > 0 THEN 'fail' WHEN n_review > 0 OR d.text IS NULL THEN 'needs_review' ELSE 'pass' END AS verdict
  FROM documents d CROSS JOIN fws f LEFT JOIN counts c ON c.change_id = d.doc_id AND c.fw = f.fw)
"""
