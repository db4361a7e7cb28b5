"""Vocabularies, limits and tables that results depend on."""

# --- fixed values: limits -------------------------------------------------------------------
LONG_LINE_CHARS = 8192
MAX_GLOB_WILDCARDS = 4
INT32_MAX = 2_147_483_647
TREE_SNIFF_BYTES = 8192
INVENTORY_KEEP_RUNS = 10

# --- fixed values: checksum candidates --------------------------------------------------------
CANDIDATE_PATTERN = r"[A-Za-z0-9][A-Za-z0-9 \-]{7,}[A-Za-z0-9]"
CANDIDATE_MIN_LEN = 10
CANDIDATE_MAX_LEN = 34

# --- fixed values: vocabularies ---------------------------------------------------------------
DEFAULT_FRAMEWORK = "Data Compliance"
FRAMEWORKS = ("Data Compliance", "EU AI Act")
FRAMEWORK_TITLES = {"Data Compliance": "Data Compliance", "EU AI Act": "AI change control"}
FRAMEWORK_ARTICLE_LABELS = {"Data Compliance": "GDPR", "EU AI Act": "May be relevant to"}
FRAMEWORK_SLUGS = {"Data Compliance": "data-compliance", "EU AI Act": "ai-change-control"}
SUPPORTED_CAPS = ("context",)
CONTEXT_CAP = "context"
DEFAULT_PROVIDER = "github"
DESCRIPTION_PATH = "MERGE_REQUEST_DESCRIPTION"
DESCRIPTION_LOCATION = "PR description"

INVENTORY_RULE_IDS = (
    "eaa-ci-ai-sdk-manifest",
    "eaa-ci-ai-import",
    "eaa-ci-ai-endpoint",
    "eaa-ci-emotion-biometric",
)
EMOTION_RULE_ID = "eaa-ci-emotion-biometric"
EMOTION_KEY = "emotion-biometric"
SIGNATURE_KEYS = (
    "openai", "anthropic", "google-ai", "mistral", "cohere", "langchain", "llamaindex",
    "huggingface", "groq", "replicate", "ollama", "aws-bedrock", "azure-openai",
    "vercel-ai-sdk", "litellm", "other-ai", "emotion-biometric",
)
# Ordered: the first pattern found in the lower-cased match names its family.
SIGNATURE_FAMILIES = (
    ("vercel-ai-sdk", r"""@ai-sdk/|["'`]ai(?:/[a-z0-9._/-]*)?["'`]"""),
    ("langchain", r"langchain"),
    ("llamaindex", r"llama[-_]?index"),
    ("other-ai", r"springframework\.ai|spring-ai-|semantickernel"),
    ("azure-openai", r"azure[./]openai|azure\.ai\.openai|\.openai\.azure\.com"),
    ("aws-bedrock", r"bedrock-runtime"),
    ("anthropic", r"anthropic"),
    ("google-ai", r"google|vertexai"),
    ("huggingface", r"huggingface|transformers"),
    ("mistral", r"mistral"),
    ("cohere", r"cohere"),
    ("groq", r"groq"),
    ("replicate", r"replicate"),
    ("ollama", r"ollama"),
    ("litellm", r"litellm"),
    ("openai", r"openai"),
)
OTHER_FAMILY = "other-ai"

# --- fixed values: paths and allowlist ----------------------------------------------------------
# Lock files, build output, vendored and minified code.
ALWAYS_EXCLUDED = (
    r"(^|/)package-lock\.json\z",
    r"(^|/)yarn\.lock\z",
    r"(^|/)dist/",
    r"(^|/)build/",
    r"(^|/)vendor/",
    r"\.min\.[^/]*\z",
    r"(^|/)node_modules/",
)
# Tested on the trimmed, lower-cased value; ASCII word boundaries spelled out.
SYNTHETIC_VALUES = (
    r"@example\.(com|org|net)\z",
    r"(^|@)example\.(com|org|net)\z",
    r"^test@",
    r"@test\.",
    r"(?<![0-9a-z_])example\.(com|org|net)(?![0-9a-z_])",
    r"(?<![0-9a-z_])localhost(?![0-9a-z_])",
)

# --- fixed values: diff metadata prefixes ---------------------------------------------------------
DIFF_METADATA_PREFIXES = (
    "index ", "new file mode", "deleted file mode", "old mode", "new mode",
    "similarity index", "rename from", "rename to", "Binary files", "\\ No newline",
)

# --- fixed values: what is replaced where text is shown -------------------------------------------
UNSAFE_IN_PATH = r"[^\p{L}\p{N}._/@+-]"
UNSAFE_IN_RULE_ID = r"[^A-Za-z0-9._:/@+-]"
URL_SCHEME = r"(?i)((?<![0-9A-Za-z_])[a-z][a-z0-9+.-]*://)"

# --- fixed values: checksums ----------------------------------------------------------------------
SVNR_WEIGHTS = (3, 7, 9, 0, 5, 8, 4, 2, 1, 6)
DAYS_IN_MONTH = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)

# Public IBAN registry: country -> BBAN structure (n digits, a upper-case letters, c letters or digits).
IBAN_BBAN = {
    "AD": "8n12c", "AE": "19n", "AL": "8n16c", "AT": "16n", "AZ": "4a20c", "BA": "16n",
    "BE": "12n", "BG": "4a6n8c", "BH": "4a14c", "BI": "23n", "BR": "23n1a1c", "BY": "4c4n16c",
    "CH": "5n12c", "CR": "18n", "CY": "8n16c", "CZ": "20n", "DE": "18n", "DJ": "23n",
    "DK": "14n", "DO": "4c20n", "EE": "16n", "EG": "25n", "ES": "20n", "FI": "14n",
    "FK": "2a12n", "FO": "14n", "FR": "10n11c2n", "GB": "4a14n", "GE": "2a16n", "GI": "4a15c",
    "GL": "14n", "GR": "7n16c", "GT": "24c", "HR": "17n", "HU": "24n", "IE": "4a14n",
    "IL": "19n", "IQ": "4a15n", "IS": "22n", "IT": "1a10n12c", "JO": "4a4n18c", "KW": "4a22c",
    "KZ": "3n13c", "LB": "4n20c", "LC": "4a24c", "LI": "5n12c", "LT": "16n", "LU": "3n13c",
    "LV": "4a13c", "LY": "21n", "MC": "10n11c2n", "MD": "20c", "ME": "18n", "MK": "3n10c2n",
    "MN": "16n", "MR": "23n", "MT": "4a5n18c", "MU": "4a19n3a", "NI": "4a20n", "NL": "4a10n",
    "NO": "11n", "OM": "3n16c", "PK": "4a16c", "PL": "24n", "PS": "4a21c", "PT": "21n",
    "QA": "4a21c", "RO": "4a16c", "RS": "18n", "RU": "14n15c", "SA": "2n18c", "SC": "4a20n3a",
    "SD": "14n", "SE": "20n", "SI": "15n", "SK": "20n", "SM": "1a10n12c", "SO": "19n",
    "ST": "21n", "SV": "4a20n", "TL": "19n", "TN": "20n", "TR": "5n1n16c", "UA": "6n19c",
    "VA": "18n", "VG": "4a16n", "XK": "16n", "YE": "4a4n18c",
}

# Public issuer ranges: (network, low, high), both ends with the same number of digits.
CARD_RANGES = (
    ("visa", "4", "4"),
    ("mastercard", "51", "55"), ("mastercard", "2221", "2229"), ("mastercard", "223", "229"),
    ("mastercard", "23", "26"), ("mastercard", "270", "271"), ("mastercard", "2720", "2720"),
    ("american-express", "34", "34"), ("american-express", "37", "37"),
    ("diners-club", "300", "305"), ("diners-club", "36", "36"), ("diners-club", "38", "39"),
    ("discover", "6011", "6011"), ("discover", "644", "649"), ("discover", "65", "65"),
    ("jcb", "2131", "2131"), ("jcb", "1800", "1800"), ("jcb", "3528", "3589"),
    ("unionpay", "620", "620"), ("unionpay", "62100", "62182"), ("unionpay", "62184", "62187"),
    ("unionpay", "62185", "62197"), ("unionpay", "62200", "62205"), ("unionpay", "622010", "622999"),
    ("unionpay", "62207", "62209"), ("unionpay", "623", "626"), ("unionpay", "6270", "6270"),
    ("unionpay", "6272", "6272"), ("unionpay", "6276", "6276"), ("unionpay", "627700", "627779"),
    ("unionpay", "627781", "627799"), ("unionpay", "6282", "6289"), ("unionpay", "6291", "6292"),
    ("unionpay", "810", "810"), ("unionpay", "8110", "8171"),
    ("maestro", "493698", "493698"), ("maestro", "500000", "504174"), ("maestro", "504176", "506698"),
    ("maestro", "506779", "508999"), ("maestro", "56", "59"), ("maestro", "63", "63"),
    ("maestro", "67", "67"), ("maestro", "6", "6"),
    ("elo", "401178", "401179"), ("elo", "438935", "438935"), ("elo", "457631", "457632"),
    ("elo", "431274", "431274"), ("elo", "451416", "451416"), ("elo", "457393", "457393"),
    ("elo", "504175", "504175"), ("elo", "506699", "506778"), ("elo", "509000", "509999"),
    ("elo", "627780", "627780"), ("elo", "636297", "636297"), ("elo", "636368", "636368"),
    ("elo", "650031", "650033"), ("elo", "650035", "650051"), ("elo", "650405", "650439"),
    ("elo", "650485", "650538"), ("elo", "650541", "650598"), ("elo", "650700", "650718"),
    ("elo", "650720", "650727"), ("elo", "650901", "650978"), ("elo", "651652", "651679"),
    ("elo", "655000", "655019"), ("elo", "655021", "655058"),
    ("mir", "2200", "2204"),
    ("hiper", "637095", "637095"), ("hiper", "63737423", "63737423"), ("hiper", "63743358", "63743358"),
    ("hiper", "637568", "637568"), ("hiper", "637599", "637599"), ("hiper", "637609", "637609"),
    ("hiper", "637612", "637612"),
    ("hipercard", "606282", "606282"),
)
CARD_LENGTHS = {
    "visa": (16, 18, 19), "mastercard": (16,), "american-express": (15,),
    "diners-club": (14, 16, 19), "discover": (16, 19), "jcb": (16, 17, 18, 19),
    "unionpay": (14, 15, 16, 17, 18, 19), "maestro": (12, 13, 14, 15, 16, 17, 18, 19),
    "elo": (16,), "mir": (16, 17, 18, 19), "hiper": (16,), "hipercard": (16,),
}
CARD_NO_LUHN = ("unionpay",)

SEVERITY = {"block": 0, "review": 1, "advise": 2}

# --- fixed values: warning texts ------------------------------------------------------------------
FLOORED = "Verdict floored to needs_review."
WARNING_TEXT = {
    "unusable_pattern": 'Rule "{rule}" declares {fields} that could not be compiled; that part of the rule did not run. '
                        + FLOORED,
    "rule_failed": 'Rule "{rule}" failed to evaluate and was skipped. ' + FLOORED,
    "unreadable_applies_when": 'Rule "{rule}" declares an applies_when that cannot be read; '
                               "its findings keep their declared action.",
    "context_rejected": "The registry context of {framework} could not be used and was ignored; findings keep their declared action.",
    "tier1_gate": "Tier-1 rule(s) {rules} declare exclude_pattern/require_pattern; a tier-1 control cannot be gated, "
                  "so those fields were IGNORED. " + FLOORED,
    "blanket_glob": "{n} path glob(s) match EVERY path ({globs}) and were REFUSED: as an exclusion they would suppress "
                    "the whole rule, as a scope they would select nothing. " + FLOORED,
    "complex_glob": "{n} path glob(s) declare more than 4 wildcards ({globs}) and were REFUSED as a backtracking risk; "
                    "they matched nothing. " + FLOORED,
    "long_lines": "{n} file(s) contain lines longer than 8192 characters, the first is {file}; they were scanned whole.",
    "truncated_diff": "Diff exceeded the configured size cap and was truncated; verdict floored to needs_review.",
    "suppressed": 'Rule "{rule}" suppressed {n} candidate line(s) via its exclude_pattern/require_pattern gating.',
    "no_diff": "Diff unavailable: {reason}",
    "no_ruleset": "Ruleset unavailable: {reason}",
    "unserved": "{framework} was not served in this run ({reason}), so it was not scanned.",
    "unsupported_rules": "{n} rule(s) withheld because a capability they need is not supported here.",
    "withheld_rules": "{n} rule(s) withheld: no registry context could be attached (no valid repository).",
}

# --- fixed values: check digits inside national account numbers ------------------------------
# Country -> (first place after the country and check digits, weights, modulus); each weighted sum leaves no remainder.
BBAN_SUMS = {
    "CZ": [(5, [10, 5, 8, 4, 2, 1], 11), (11, [6, 3, 7, 9, 10, 5, 8, 4, 2, 1], 11)],
    "SK": [(5, [10, 5, 8, 4, 2, 1], 11), (11, [6, 3, 7, 9, 10, 5, 8, 4, 2, 1], 11)],
    "EE": [(3, [7, 1, 3, 7, 1, 3, 7, 1, 3, 7, 1, 3, 7, 1], 10)],
    "HU": [(1, [9, 7, 3, 1, 9, 7, 3, 1], 10), (9, [9, 7, 3, 1, 9, 7, 3, 1, 9, 7, 3, 1, 9, 7, 3, 1], 10)],
    "NO": [(1, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2, 1], 11)],
    "PL": [(1, [3, 9, 7, 1, 3, 9, 7, 1], 10)],
}
# Number modulo 97 is 1.
BBAN_MOD97 = ("BA", "ME", "MK", "PT", "RS", "SI")
# Number modulo 97 is 0, with letters read as the digits below them.
BBAN_RIB = ("FR", "MC")
RIB_LETTERS, RIB_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "12345678912345678923456789"
ES_BANK_WEIGHTS = [4, 8, 5, 10, 9, 7, 3, 6]
ES_ACCOUNT_WEIGHTS = [1, 2, 4, 8, 5, 10, 9, 7, 3, 6]
