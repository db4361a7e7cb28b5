"""Fixed table schemas as DDL; nothing is inferred."""

CHANGES = ("change_id STRING, repo STRING, provider STRING, pr_number INT, commit_sha STRING, "
           "diff STRING, description STRING")

DETECT = ("method: STRING, target: STRING, diff_side: STRING, pattern: STRING, "
          "paired: STRUCT<minus: STRING, plus: STRING, window: STRING>, validator: ARRAY<STRING>, "
          "require_context: STRING, exclude_pattern: STRING, require_pattern: STRING, signature: STRING, "
          "file_scope: ARRAY<STRING>, exclude_paths: ARRAY<STRING>, allowlist: STRING, "
          "applies_when: VARIANT, mask: STRING")
RULE = ("id STRING, name STRING, gdpr_article ARRAY<STRING>, articles ARRAY<STRING>, relevance ARRAY<STRING>, "
        f"action STRING, tier INT, baseline BOOLEAN, detect STRUCT<{DETECT}>")
ALLOWLIST = ("emails ARRAY<STRING>, names ARRAY<STRING>, domains ARRAY<STRING>, ip_ranges ARRAY<STRING>, "
             "ibans ARRAY<STRING>, cards ARRAY<STRING>")
SIGNATURES = "MAP<STRING, ARRAY<STRING>>"
