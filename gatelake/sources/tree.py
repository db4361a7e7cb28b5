"""Trees of files as a (repo, commit, path, length, content) table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import TREE_SNIFF_BYTES


def list_tree(spark: SparkSession, root: str, repo: str = "", commit_sha: str = "") -> DataFrame:
    """Paths and sizes; ``content`` is pruned, so no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    relative = F.substr("path", F.locate(base, F.col("path")) + len(base))
    return files.select(F.lit(repo).alias("repo"), F.lit(commit_sha).alias("commit_sha"),
                        relative.alias("path"), F.col("length"), F.col("content"))


def read_tree(spark: SparkSession, root: str, repo: str = "", commit_sha: str = "",
              max_bytes: int | None = None) -> DataFrame:
    """All files with their content; above ``max_bytes``, where named, a file is listed with its length and no content.

    Such files stay rows, so an inventory can say that it did not read them.
    """
    files = list_tree(spark, root, repo, commit_sha)
    if max_bytes is None:
        return files
    large = list_tree(spark, root, repo, commit_sha).where(F.col("length") > max_bytes)
    return files.where(F.col("length") <= max_bytes).unionByName(large.withColumn("content", F.lit(None).cast("binary")))


def is_binary(content: Column) -> Column:
    return F.position(F.lit(bytes([0])), F.substring(content, 1, TREE_SNIFF_BYTES)) > 0


def decoded(content: Column) -> Column:
    """UTF-8 with replacement characters and without a byte order mark."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\A\x{FEFF}", "")


def tree_lines(tree: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Lines of the readable text files of a tree, up to a size where the caller names one."""
    small = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    readable = tree.where(small & ~is_binary(F.col("content")))
    return readable.select(
        "repo", "commit_sha", "path", F.posexplode_outer(F.split(decoded(F.col("content")), r"\r?\n", -1)).alias("pos", "text")).where(F.col("pos").isNotNull())
