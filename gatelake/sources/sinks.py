"""Writing results: masked tables only."""
from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by=("framework",)) -> None:
    """Findings, verdicts or payload rows, partitioned by framework."""
    columns = [c for c in by if c in df.columns]
    df.write.format(fmt).mode(mode).partitionBy(*columns).save(path)


def write_issues(issues: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Code Quality issues as JSON lines."""
    issues.select("change_id", "description", "check_name", "fingerprint", "severity", "location").write.mode(mode).json(path)
