"""Scan a stream of changes: the batch scan per micro-batch."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.rules import Ruleset
from ..plans.scan import scan_changes
from ..sources.changes import cap_diffs

KEYS = ("change_id", "commit_sha")


def stream_scan(changes: DataFrame, rulesets: list[Ruleset], out: str, checkpoint: str, trigger: dict | None = None, diff_cap: int | None = None):
    """Start a query writing findings and verdicts under ``out``, a folder that all executors share.

    A change at a commit is one row, so each micro-batch sees it whole and no state is kept. A batch is read, freed of
    repeated changes and parsed once, its lines are scanned once; both tables are made from the stored hits and coverage. Output goes to a folder per batch id and is
    overwritten on a retry, which makes it exactly once; ``current`` reads a change that was sent again once.
    ``trigger`` holds the arguments of ``DataStreamWriter.trigger``; by default what is there is scanned.
    """
    def scan_batch(batch: DataFrame, batch_id: int) -> None:
        keyed = cap_diffs(batch, diff_cap).dropDuplicates(list(KEYS)).withColumn("scan_key", F.to_json(F.struct(*KEYS)))
        keyed.write.mode("overwrite").parquet(f"{out}/changes/batch={batch_id}")
        keyed = keyed.sparkSession.read.schema(keyed.schema).parquet(f"{out}/changes/batch={batch_id}")
        scan = scan_changes(keyed, rulesets, "scan_key", KEYS, f"{out}/lines/batch={batch_id}").stored(f"{out}/scans/batch={batch_id}")
        key = F.from_json("scan_key", "change_id string, commit_sha string")
        found = scan.findings.select(key.alias("k"), "*").select("k.*", *[c for c in scan.findings.columns if c != "scan_key"])
        found.write.mode("overwrite").parquet(f"{out}/findings/batch={batch_id}")
        scan.verdicts.drop("scan_key").write.mode("overwrite").parquet(f"{out}/verdicts/batch={batch_id}")

    return (changes.writeStream.foreachBatch(scan_batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def current(spark: SparkSession, out: str, table: str) -> DataFrame:
    """Rows of ``findings`` or ``verdicts``, of the latest batch for every change and commit."""
    scanned = spark.read.parquet(f"{out}/verdicts").groupBy(*KEYS).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/{table}").join(scanned, [*KEYS, "batch"], "left_semi")
