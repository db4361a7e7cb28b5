"""Helpers of the corpus operators: input tables, scratch tables in the shared folder, binding of array columns."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SETTING = "spark.checkpoint.dir"
#: Used only by local sessions that set no checkpoint folder, as tests do.
LOCAL_FOLDER = "/tmp/checkpoints"
#: The characters that part words: space and \x09 to \x0D.
BREAKS = " \t\n\x0b\f\r"
BREAKS_RE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that all executors share.

    Scratch tables outlive the job that wrote them, as the DataFrames made from them are read later; the owner of
    ``spark.checkpoint.dir`` clears it.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} is not set; name a folder that all executors share")
        root = LOCAL_FOLDER
    return f"{root.rstrip('/')}/gatelake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: its lineage ends here."""
    path = path or scratch(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for stages whose work is larger than their bytes suggest."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of ids that may be broadcast; their number is counted first.
FEW_IDS = 200_000


def without(docs: DataFrame, dropped: DataFrame, *keys: str | Column, how: str = "left_anti") -> DataFrame:
    """docs without the rows whose keys are in the columns of dropped, a stored table; null is a value like any other.

    With how = "left_semi" only those rows are left. Few keys are broadcast, so no text is moved for them; more are
    joined by shuffling both sides.
    """
    gone = dropped.toDF(*[f"dropped_{i}" for i in range(len(keys))]).distinct()
    if dropped.count() <= FEW_IDS:
        gone = F.broadcast(gone)
    named = [(F.col(k) if isinstance(k, str) else k).alias(f"key_{i}") for i, k in enumerate(keys)]
    rows = docs.select(F.struct("*").alias("whole"), *named)
    same = [rows[f"key_{i}"].eqNullSafe(gone[f"dropped_{i}"]) for i in range(len(keys))]
    return rows.join(gone, same, how).select("whole.*")


def sampled(rows: DataFrame, group: str, most: int, groups: int) -> DataFrame:
    """At most ``most`` rows of each of the ``groups`` largest groups of rows(doc_id, group, text): those of lowest hash.

    Rows are told apart by id and text, so rows that share an id are drawn like any others, and rows equal in both count
    once. The sample does not depend on partitions. The number of different rows of a group gives a hash below which
    about three times ``most`` of them lie, so a group of any size sends only that many on to be ranked, without texts.
    The result has at most most * groups rows.
    """
    placed = rows.withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11))  # from 0 to 2 ** 53
    sizes = placed.groupBy(group).agg(F.approx_count_distinct("place", 0.02).alias("group_size"), F.count(F.lit(1)).alias("group_rows"))
    sizes = sizes.orderBy(F.col("group_rows").desc(), group).limit(groups)  # so many rows, and no more
    low = placed.select(group, "place").join(F.broadcast(sizes), group).where(F.col("place") / 2.0 ** 53 * F.col("group_size") < 3 * most).distinct()
    order = Window.partitionBy(group).orderBy("place")
    chosen = low.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select(group, "place")
    return placed.join(F.broadcast(chosen), [group, "place"]).dropDuplicates([group, "place"])


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also where body uses it inside further lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS_RE), lambda w: w != "")
