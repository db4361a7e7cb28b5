"""Any text column as a line table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.globs import is_built_in_exclusion, settled


def text_lines(df: DataFrame, key: str, text: str, path: Column, keep=(), scopes=()) -> DataFrame:
    """One row per line, all on the ``added`` side; no shuffle, so rows split freely.

    Whether the path is excluded from every rule is settled once per text, before it is split; so is whether it is in
    each of the ``scopes`` (see ``rules.scopes``), where these are given.
    """
    paths = ["excluded", "scopes"] if scopes else ["excluded"]
    rows = df.select(F.col(key).alias("change_id"), *keep, path.alias("file"), F.col(text).alias("text")).withColumn(
        "excluded", is_built_in_exclusion(F.col("file")))
    if scopes:
        rows = rows.withColumn("scopes", settled(F.col("file"), scopes))
    return rows.select("change_id", *keep, "file", *paths, F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "text")).where(
        F.col("pos").isNotNull()).select("change_id", *keep, "pos", *paths, F.lit("added").alias("side"), F.lit(0).alias("side_ord"), "file",
             (F.col("pos") + 1).cast("bigint").alias("line_no"), "text", F.lit(0).cast("bigint").alias("hunk_index"))
