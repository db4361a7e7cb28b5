"""Tables of changes: reading, capping and checking their metadata."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import INT32_MAX
from ..functions.patterns import js_trim
from ..schemas import CHANGES


def read_changes(spark: SparkSession, path: str, fmt: str = "parquet", diff_cap: int | None = None) -> DataFrame:
    """Changes from parquet or JSON with a fixed schema; whole unless a cap is named."""
    return cap_diffs(spark.read.schema(CHANGES).format(fmt).load(path), diff_cap)


def cap_diffs(changes: DataFrame, cap: int | None = None) -> DataFrame:
    """Cut diffs longer than a cap to a prefix and flag them; the flag floors the verdict. Without a cap none is cut."""
    if not cap:
        return changes.withColumn("truncated", F.lit(False))
    return changes.withColumns({
        "truncated": F.coalesce(F.length("diff") > cap, F.lit(False)),
        "diff": F.substring("diff", 1, cap)})


def _filled(*names: str) -> Column:
    return F.coalesce(*[F.nullif(js_trim(F.col(n)), F.lit("")) for n in names], F.lit(""))


def checked_metadata(rows: DataFrame) -> DataFrame:
    """Resolve repository, number and commits of merge-request rows; ``reason`` names the first failed check."""
    text = {c: js_trim(F.coalesce(F.col(c), F.lit(""))) for c in
            ("ci_system", "pipeline_source", "iid", "diff_base_sha")}
    repo, head, base = _filled("mr_project_path", "project_path"), _filled("source_branch_sha", "commit_sha"), \
        text["diff_base_sha"]
    number = F.when(text["iid"].rlike(r"\A[0-9]+\z"), text["iid"].try_cast("decimal(38,0)"))
    sha = r"(?i)\A(?:[0-9a-f]{40}|[0-9a-f]{64})\z"
    reason = (F.when(text["ci_system"] != "true", "not-ci")
              .when((text["pipeline_source"] != "merge_request_event") | (text["iid"] == ""), "not-merge-request")
              .when(~F.coalesce(number.between(1, INT32_MAX), F.lit(False)), "bad-number")
              .when(repo == "", "missing-repo")
              .when((F.length(repo) > 200) | ~repo.rlike(r"\A[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)+\z"), "bad-repo")
              .when(head == "", "missing-head")
              .when(~head.rlike(sha), "bad-head")
              .when(base == "", "missing-base")
              .when(~base.rlike(sha), "bad-base"))
    return rows.withColumns({
        "repo": repo, "number": F.when(number <= INT32_MAX, number.cast("bigint")), "head_sha": head,
        "base_sha": base, "reason": reason,
        "description_cut": F.coalesce(js_trim(F.col("description_truncated")) == "true", F.lit(False))})
