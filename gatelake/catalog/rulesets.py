"""The demo rulesets the registered queries scan with (rules are data; none are built in)."""

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"


def rule(id_, action, tier, **detect):
    extra = {k: detect.pop(k) for k in ("articles", "gdpr_article", "baseline") if k in detect}
    detect = {"method": "pattern", "target": "diff", "diff_side": "added", "mask": id_, **detect}
    return {"id": id_, "name": id_, "action": action, "tier": tier, "detect": detect, **extra}


DATA_RULES = {
    "framework": "Data Compliance", "ruleset_version": 7, "ruleset_hash": "demo-data-7",
    "rules": [
        rule("card", "block", 1, method="checksum", pattern=r"\b[0-9]{13,19}\b", validator=["credit_card"], mask="card-number",
             diff_side="either", allowlist="synthetic", gdpr_article=["Art. 5", "Art. 32"]),
        rule("iban", "block", 1, method="checksum", validator=["iban"], mask="IBAN-pattern",
             allowlist="synthetic", gdpr_article=["Art. 32"]),
        rule("weak-id", "block", 1, method="checksum", validator=["svnr", "steuer_id"], mask="national-id",
             require_context=r"(?i)(svnr|steuer-?id|tax-?id)", gdpr_article=["Art. 87"]),
        rule("email", "review", 2, pattern=EMAIL, mask="e-mail", diff_side="either", gdpr_article=["Art. 4"]),
        rule("email-real", "review", 2, pattern=EMAIL, mask="e-mail", allowlist="synthetic"),
        rule("ipv4", "review", 2, pattern=IPV4, mask="ip-address", diff_side="either", gdpr_article=["Art. 4"],
             exclude_paths=["docs/", "*.lock$"]),
        rule("secret", "block", 1, pattern=r"(?i)token\s*=", mask="secret", diff_side="either",
             require_context=r"(?i)idiot|und|the", file_scope=["src*/**", "^lib/"]),
        rule("license", "advise", 3, method="signature", signature="license-words", mask="license-text",
             diff_side="either"),
        rule("gated-ip", "review", 2, pattern=r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", mask="gated-ip",
             exclude_pattern=r"(?i)\bder\b", require_pattern=r"[aeiou]{3}"),
        rule("tier1-gated", "block", 1, pattern=r"[0-9]{16}", mask="long-number", exclude_pattern="."),
        rule("swapped", "block", 2, diff_side="either", mask="safeguard-removed",
             paired={"minus": r"(?i)token", "plus": r"(?i)license|[0-9]{6}", "window": "same_file"}),
        rule("swapped-hunk", "block", 2, mask="article-swapped", require_pattern=r"[0-9]",
             paired={"minus": r"\bthe\b", "plus": r"\bof\b.*\b(and|in)\b", "window": "same_hunk"}),
        rule("mentions", "review", 2, target="pr_description", pattern=r"(?i)\b(the|und|los)\b", mask="mention",
             exclude_pattern=r"(?i)tion\b"),
    ],
    "allowlist": {"emails": ["un.1@mail1.example.com"], "names": [], "domains": ["mail7.example.com"], "ip_ranges": [],
                  "ibans": ["DE89 3704 0044 0532 0130 00"], "cards": []},
    "signatures": {"license-words": ["License", "Copyright", "MIT"]},
}

AI_RULES = {
    "framework": "EU AI Act", "ruleset_version": 3, "ruleset_hash": "demo-ai-3",
    "rules": [
        rule("eaa-ci-ai-endpoint", "review", 2, pattern=r"(?i)\b(machine|model|mention|tion)\b", mask="ai-endpoint",
             articles=["Art. 50"], diff_side="either",
             applies_when=[{"when": {"quality": True, "toxic": False}, "action": "advise"}]),
        rule("eaa-ci-ai-import", "block", 2, pattern=r"[0-9]{13,}", mask="ai-import", articles=["Art. 6", "Art. 9"],
             applies_when=[{"when": {"toxic": True}, "action": "review"}, {"when": {"quality": True}, "action": "advise"}]),
        rule("odd-context", "review", 3, pattern=r"token", mask="odd", articles=[], applies_when="always"),
        rule("bad-pattern", "review", 3, pattern="(?x)foo", mask="bad", articles=[]),
        rule("blanket-scope", "review", 3, pattern="the", mask="blanket", articles=[], file_scope=["*"]),
    ],
    "allowlist": {}, "signatures": {},
}

RULESETS = [DATA_RULES, AI_RULES]

# The same rules without those whose mistakes floor every verdict.
_FLAWED = ("tier1-gated", "bad-pattern", "blanket-scope")
SOUND_RULESETS = [{**d, "rules": [r for r in d["rules"] if r["id"] not in _FLAWED]} for d in RULESETS]

INVENTORY_RULES = [
    rule("eaa-ci-ai-sdk-manifest", "review", 2, pattern=r'"(@ai-sdk/)?(openai|anthropic|cohere|mistral)[a-z/-]*"',
         mask="manifest", baseline=True, articles=[], file_scope=["package.json$", "manifest-*.json$"]),
    rule("eaa-ci-ai-import", "review", 2, pattern=r"(?i)(import|from|require)\s*\(?[\"'][a-z@/._-]+[\"']", mask="import",
         baseline=True, articles=[], exclude_paths=["^docs/"], exclude_pattern=r"(?i)doctype"),
    rule("eaa-ci-ai-endpoint", "review", 2, pattern=r"[a-z]+\.openai\.(azure\.)?com|api\.[a-z]+\.(com|ai)|track\([0-9]+\)",
         mask="endpoint", baseline=True, articles=[], file_scope=[".html$", ".ts$"]),
    rule("eaa-ci-emotion-biometric", "review", 2, pattern=r"(?i)emotion|<b>", mask="emotion", baseline=True, articles=[]),
    rule("not-listed", "review", 2, pattern="the", mask="x", baseline=True, articles=[]),
    rule("eaa-ci-ai-import", "review", 2, pattern="the", mask="y", articles=[]),
]
