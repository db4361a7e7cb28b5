import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gatelake.functions import allowlist, checksums, globs, masking, patterns
from gatelake.operators import candidates


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in df.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize("name,good,bad", [
    ("iban", ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "AT61-1904-3002-3457-3201", "LB3812-3-4ABCDEFGHIJKLMNOPQRST"],
     ["GB00WEST12345698765432", "not-an-iban", "DE8937040044053201300", ""]),
    ("credit_card", ["4111 1111 1111 1111", "378282246310005", "6011111111111117"],
     ["4111111111111112", "0000000000000000", "4111", "411111111111111"]),
    ("svnr", ["1237010180", "abc1237010180"], ["1234010180", "0000000000", "12370101800"]),
    ("steuer_id", ["86095742719"], ["86095742710", "02476291358", "8609574271"]),
])
def test_validators(spark, name, good, bad):
    assert column(spark, good + bad, lambda v: checksums.is_valid(name, v)) == [True] * len(good) + [False] * len(bad)


# Examples of the public registry.
NATIONAL = ["BE68539007547034", "BA391290079401028494", "CZ6508000000192000145399", "SK3112000000198742637541", "EE382200221020145685",
            "ES9121000418450200051332", "FI2112345600000785", "FR1420041010050500013M02606", "MC5811222000010123456789030",
            "HR1210010051863000160", "HU42117730161111101800000000", "NO9386011117947", "PL61109010140000071219812874",
            "PT50000201231234567890154", "RS35260005601001611379", "SI56263300012039086", "ME25505000012345678951", "MK07250120000058984"]


def _with_check(country, bban):
    digits = "".join(str(int(c, 36)) for c in bban + country + "00")
    return f"{country}{98 - int(digits) % 97:02}{bban}"


def test_national_check_digits(spark):
    """Registry examples pass; with a digit of the account changed and the outer check digits made to fit, they do not."""
    spoiled = []
    for iban in NATIONAL:
        country, bban = iban[:2], iban[4:]
        assert _with_check(country, bban) == iban
        # The Polish check digit covers the bank alone.
        at = 7 if country == "PL" else len(bban) - 1
        spoiled.append(_with_check(country, bban[:at] + str((int(bban[at]) + 1) % 10) + bban[at + 1:]))
    free = [_with_check("DE", "370400440532013001"), _with_check("GB", "WEST12345698765433"), _with_check("AT", "1904300234573202")]
    got = column(spark, [*NATIONAL, *spoiled, *free], checksums.iban)
    assert got == [True] * len(NATIONAL) + [False] * len(spoiled) + [True] * len(free)


def test_own_validator(spark):
    checksums.register_validator("even", lambda v: f"({v} rlike '[02468]$')")
    assert column(spark, ["12", "13"], lambda v: checksums.first_valid(["nope", "even"], v)) == ["even", None]


def test_masks(spark):
    assert column(spark, ["jane.doe@acme.co.uk", "@x", "a@", "a@b", "x@y."], masking.mask_email) == [
        "j***@***.uk", "@***", "a***", "a***@***", "x***@***"]
    assert column(spark, ["supersecret", " a ", ""], masking.mask_generic) == ["s***", "***", "***"]
    assert column(spark, ["fixtures/users.sql"], lambda v: masking.evidence(F.lit("IBAN-pattern"), F.lit("zz"), v, F.lit(88))) == [
        "IBAN-pattern @ fixtures/users.sql:88"]
    assert column(spark, ["a|b`c.ts"], lambda v: masking.evidence(F.lit("x"), F.lit(""), v)) == ["x @ a b c.ts"]
    assert column(spark, ["https://user:tok@host/p"], masking.scrub_urls) == ["https://host/p"]
    assert column(spark, [".//./a/b", "/x"], masking.relative_path) == ["a/b", "x"]
    assert column(spark, ["a\\|b\nc"], masking.markdown_cell) == ["a\\\\\\|b c"]


def test_digit_groups_match_a_plain_restatement(spark):
    rng = random.Random(5)
    texts = ["m @ supabase/migrations/20261003090000_x.sql", "12345678", "1234567890 @ 12345678901"]
    texts += ["".join(rng.choice("0123456789ab/ @") for _ in range(rng.randint(5, 60))) for _ in range(500)]

    def plain(text):
        head, sep, tail = text.partition(" @ ")
        return head + sep + re.sub(r"\d{8,}", lambda m: re.sub(r"(\d{4})(?=\d)", "\\1·", m.group()), tail) if sep else text

    assert column(spark, texts, masking.group_digits) == [plain(t) for t in texts]


def test_literal_helpers_agree_with_columns(spark):
    texts = ["a|b", "x" * 250, "  ", "rule (é) <b>", "日本/ä.ts", "a\tb\n"]
    assert column(spark, texts, masking.safe_label) == [masking.literal_label(t) for t in texts]
    assert column(spark, texts, masking.safe_path) == [masking.literal_path(t) for t in texts]
    assert column(spark, texts, masking.safe_rule_id) == [masking.literal_rule_id(t) for t in texts]


def test_patterns_that_are_refused():
    for bad in ["(?x)foo", "(?i)", "a++", "(?>a)", "(?i:x)", "", None, "x\\"]:
        assert patterns.to_java(bad) is None


@pytest.mark.parametrize("pattern,text,hits", [
    (r"\bfoo\b", "foo éfoo foo_ foo", 3), (r"a$", "a\n", 0), (r"x.y", "x\ry x y", 1), (r"(?s)x.y", "x\ny", 1),
    (r"(?m)^b$", "a\nb\nc", 1), (r"\s", "a b", 1), (r"[a[b]+", "[[ab", 1), (r"x{", "x{", 1), (r"(?gi)OK", "ok Ok", 2),
    (r"(?y)a", "aab a", 2), (r"[^]", "ab", 2), (r"[]", "ab", 0), (r"\b(the|und)\b", "the und other", 2), (r"a{1,2}\b", "aa a b", 2),
])
def test_dialect(spark, pattern, text, hits):
    found = column(spark, [text], lambda v: F.size(candidates.matches(v, patterns.to_java(pattern))))
    assert found == [hits]


def test_boundaries_are_equivalent(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1_ é.") for _ in range(12)) for _ in range(300)]
    for pattern in (r"\ba", r"a\b", r"\b[0-9]+\b", r"\b(a|b)\b", r"\b\w+\b"):
        java = patterns.to_java(pattern)
        got = column(spark, texts, lambda v: F.size(candidates.matches(v, java)))
        assert got == [len(re.findall(pattern, t, re.ASCII)) for t in texts]


def test_requirements_hold_for_every_match():
    cases = {r"(?i)token\s*=": ("=", 0), r"a|b": (None, 0), r"foo?bar": ("bar", 0), r"[0-9]+\.[0-9]{2}": (".", 3),
             r"api\.x\.com": ("api.x.com", 0), r"\b[0-9]{13,19}\b": (None, 13), r"(a|b)c": ("c", 0), r"\d*x": ("x", 0)}
    assert {p: patterns.requirements(p) for p in cases} == cases


_ATOMS = st.sampled_from(["a", "b", "c", "B", ".", "[ab]", r"\.", r"\b", r"\w", "(?=a)", "(?!c)"])
_PATTERNS = st.recursive(_ATOMS, lambda inner: st.one_of(
    st.lists(inner, min_size=1, max_size=5).map("".join), st.lists(inner, min_size=1, max_size=3).map(lambda p: f"(?:{'|'.join(p)})"),
    st.tuples(inner, st.sampled_from(["*", "?", "+", "{2}", "{0,2}"])).map(lambda p: f"(?:{p[0]}){p[1]}")), max_leaves=12)


@settings(max_examples=400, deadline=None)
@given(_PATTERNS, st.text("abcB. ", max_size=12), st.booleans())
def test_every_match_holds_a_required_text(pattern, text, fold):
    pattern = "(?i)" + pattern if fold else pattern
    texts = patterns.required_texts(pattern)
    assert all(len(t) >= patterns.GRAM for t in texts)
    if texts and re.search(pattern, text, re.ASCII):
        assert any(t in text.lower() for t in texts)


def test_required_texts():
    cases = {r"(?i)\btoken\w*=": ("token",), r"(?:abc|abcd)\b": ("abc", "abcd"), "abc|de": (), "(?:x|yyy)longer": ("longer",), r"a\x41bcd": (),
             "abc|": (), "(?=lookahead)abc": ("abc",), "(abc": (), "abc)": (), "(?i)äbcd": (), "äbcd": ("bcd",), "(?:abc)*d": (), "": (), None: ()}
    assert {p: patterns.required_texts(p) for p in cases} == cases


def test_gram_pattern_finds_every_gram(spark):
    grams, texts = ["abc", "bcd", "b.d", "(a|", "|xx"], ["abcd", "b.d bcd(a|xx", "", "ab.cd"]
    got = column(spark, texts, lambda v: F.array_sort(F.regexp_extract_all(v, F.lit(patterns.gram_pattern(grams)), F.lit(1))))
    assert got == [sorted(t[i:i + 3] for i in range(len(t)) if t[i:i + 3] in grams) for t in texts]


def test_globs():
    blanket = ["*", "**", "?", "***", "^*", "*$", "**$", "^**$", "^?", "^", "$", "^$"]
    assert {globs.refusal(g) for g in blanket} == {"blanket"}
    assert globs.refusal("*a*a*a*a*a*aX") == "complex"
    assert [globs.refusal(g) for g in ("**/**/*.ts", "**/__tests__/**/*.spec.ts", "docs/")] == [None] * 3


def test_scope(spark):
    paths = ["package.json", "a/package.json.bak", "docs/x.md", "sdkdocs/x.md", "dist/a.ts", "a/node_modules/b.ts", "x.min.js", "src/x.ts"]
    assert column(spark, paths, lambda v: globs.any_glob(v, ["package.json$"])) == [True] + [False] * 7
    assert column(spark, paths, lambda v: globs.in_scope(v, None, ["^docs/"])) == [
        True, True, False, True, False, False, False, True]


def test_allowlist(spark):
    lists = {"emails": ["A@B.io"], "domains": ["safe.org"], "ibans": ["DE89 3704 0044 0532 0130 00"], "names": ["Jane Doe"]}
    values = ["x@example.com", "test@corp.io", "http://localhost:1", "a@b.IO", "q@safe.org", "de89-3704-0044-0532-0130-00", "jane doe",
              "real@corp.io", "notexample.com"]
    assert column(spark, values, lambda v: allowlist.is_allowlisted(v, lists)) == [True] * 7 + [False] * 2


def plain_runs(value):
    tokens = value.split()
    if len(tokens) < 2 or sum(c.isdigit() for c in value) < 2:
        return []
    out = []
    for s in range(len(tokens)):
        for n in range(1, len(tokens) + 1):
            run = " ".join(tokens[s:s + n])
            bare = run.replace(" ", "").replace("-", "")
            if s + n <= len(tokens) and 10 <= len(bare) <= 34 and sum(c.isdigit() for c in bare) >= 2:
                out.append(run)
    return out


def test_token_runs_match_a_plain_restatement(spark):
    rng = random.Random(11)
    values = [" ".join("".join(rng.choice("ab19-") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 14))) for _ in range(200)]
    assert column(spark, values, candidates.token_runs) == [plain_runs(v) for v in values]


@pytest.mark.parametrize("names", [["svnr"], ["steuer_id"], ["credit_card"], ["iban"], ["svnr", "iban", "credit_card", "steuer_id"], ["unheard of"]])
def test_first_passing_is_the_first_candidate_that_validates(spark, names):
    rng = random.Random(5)
    parts = ["4111 1111 1111 1111", "4111111111111111", "1237010180", "1237-010180", "86095742719", "86 095 742 719", "DE12500105170648489890",
             "GB82 WEST 1234 5698 7654 32", "2024-01-31", "2024/02/28 11", "- -", "-", "no.", "x", "12", "7", "", "7010180"]
    rows = [(rng.choice([" ", "  ", "\u00a0"]).join(rng.choice(parts) for _ in range(rng.randint(1, 7))), rng.random() < .5) for _ in range(300)]
    df = spark.createDataFrame(rows, "v string, cut boolean")
    offered = F.filter(candidates.candidates(F.col("v")), lambda c: F.lit(False) if not checksums.known(names)
                       else F.exists(F.array(c), lambda x: checksums.first_valid(names, x).isNotNull()) & ~(F.col("cut") & candidates.is_date(c)))
    got = df.select(candidates.first_passing(names, F.col("v"), F.col("cut")).alias("got"), F.get(offered, F.lit(0)).alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_dates(spark):
    values = ["2024-02-29 23", "2023-02-29", "2024-13-01", "2024-02-30", "2024-02-29T24", "at 2024-02-29", "2024-02-29 1 2"]
    assert column(spark, values, candidates.is_date) == [True, True, False, False, False, True, False]


@pytest.mark.parametrize("pattern,text,found", [
    (r"\x20\b[b-z.]", "a b", True), (r"\x20\b[b-z.]", "a .", False), (r"\x41\b", "A b", True), (r"\x41\b", "Ab", False), (r"[\s-x]", "a-", True),
    (r"^[\s-,]+$", " -,", True), (r"^[a-\d]+$", "a-5", True), (r"^[\w-]+$", "a-b", True), (r"(?<my_id>[ab])\k<my_id>", "xbb", True),
    (r"(?<my_id>[ab])\k<my_id>", "ab", False), (r"(?<$x>a)(?<id>b)\k<id>", "abb", True),
])
def test_dialect_in_classes_and_names(spark, pattern, text, found):
    from gatelake.functions.patterns import to_java
    assert column(spark, [text], lambda v: v.rlike(to_java(pattern))) == [found]


def test_boundaries_dots_and_trimming_walk_no_ranges(spark):
    """What every line or hit is asked stays off long class unions, with the same result."""
    assert "A-Z" not in patterns.to_java(r"\bthe\b.*\b\W\B") and "A-Z" in patterns.to_java(r"(?i)ä\bthe")
    spaces = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and re.fullmatch(f"[{patterns.SPACE.replace('x{', 'u{')}]".replace("\\u{A0}", "\xa0").replace("\\u{", "\\u").replace("}", ""), chr(c)))
    assert sorted(spaces) == sorted(patterns.SPACES)
    texts = [spaces + "a" + spaces + "b" + spaces, spaces, "", "\u200bx\u200b", None, " x"]
    assert column(spark, texts, patterns.js_trim) == ["a" + spaces + "b", "", "", "\u200bx\u200b", None, "x"]
