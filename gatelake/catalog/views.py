"""Input tables of the registered queries, derived row by row from the given tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.text import text_lines


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows are costly to check, spread over the cores where it was written as one small file.

    Such rows cost far more to check than to ship, but a table that already has enough
    splits is never shuffled.
    """
    df = table(spark, sf, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def doc_path() -> Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))


def documents(spark, sf) -> DataFrame:
    return spread(spark, sf, "documents")


def doc_lines(spark, sf, scopes=()) -> DataFrame:
    return text_lines(documents(spark, sf), "doc_id", "text", doc_path(), scopes=scopes)


# Paths of the derived diffs: in and out of every scope the demo rules use.
CHANGE_PATHS = "array('src/app', 'docs/guide', 'lib/core', 'dist/out', 'src/x.min')"
CHANGE_DIFF = f"""
concat('diff --git a/README.md b/README.md', chr(10), 'index 1..2 100644', chr(10),
 array_join(transform(split(text, chr(10), -1), (l, i) -> concat(
   if(i % 12 = 0, concat(
     'diff --git a/', get({CHANGE_PATHS}, int((doc_id + i div 12) % 5)), i div 12, '.ts b/', get({CHANGE_PATHS}, int((doc_id + i div 12) % 5)), i div 12, '.ts', chr(10),
     '--- a/', get({CHANGE_PATHS}, int((doc_id + i div 12) % 5)), i div 12, '.ts', chr(10),
     '+++ b/', get({CHANGE_PATHS}, int((doc_id + i div 12) % 5)), i div 12, '.ts', chr(10)), ''),
   if(i % 4 = 0, concat('@@ -', 10 * i + 1, ',4 +', 10 * i + 3, ',4 @@', chr(10)), ''),
   get(array('-', '+', '+', ' ', '-'), int((doc_id + i) % 5)), l)), chr(10)))
"""


def changes(spark, sf) -> DataFrame:
    return as_changes(documents(spark, sf))


def as_changes(docs: DataFrame) -> DataFrame:
    """One change per document: its whole text as the lines of a diff, its last line as description."""
    return docs.select(
        F.col("doc_id").alias("change_id"), F.concat(F.lit("org/"), "source").alias("repo"),
        F.lit("github").alias("provider"), (F.col("doc_id") + 1).alias("pr_number"),
        F.sha1(F.col("doc_id").cast("string")).alias("commit_sha"),
        F.expr(CHANGE_DIFF).alias("diff"), F.element_at(F.split("text", "\n", -1), -1).alias("description"))


def contexts(spark, sf) -> DataFrame:
    """Registry context per change from the labels: typed booleans, and for some rows text instead."""
    return table(spark, sf, "labels").select(F.col("doc_id").alias("change_id"), F.parse_json(F.concat(
        F.lit('{"quality": '), (F.col("quality") == 1).cast("string"), F.lit(', "toxic": '),
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('"'), (F.col("toxic") == 1).cast("string"), F.lit('"')))
        .otherwise((F.col("toxic") == 1).cast("string")), F.lit("}"))).alias("registry"))


def turns(spark, sf) -> DataFrame:
    """Every conversation turn as the description of a change."""
    t = spread(spark, sf, "conversations")
    return t.select(F.concat_ws("-", "conv_id", "turn").alias("change_id"), F.col("text").alias("description"))


def pages_lines(spark, sf) -> DataFrame:
    return text_lines(spread(spark, sf, "pages"), "page_id", "html", page_path())


def page_path() -> Column:
    """Spread pages over folders and kinds of file, some always excluded."""
    return F.expr("""concat(get(array('src/', 'docs/', 'web/', 'dist/', 'lib/'), int(page_id % 5)), page_id,
                     get(array('.html', '.ts', '.min.js', '.md'), int(page_id div 5 % 4)))""")


IMPORTS = """concat('import x from "', get(array('@ai-sdk/openai', 'langchain/openai', 'openai', 'cohere', 'llama-index'), int(page_id % 5)), '"',
 chr(10), 'call("https://', get(array('api.mistral.ai', 'x.openai.azure.com', 'api.anthropic.com', 'api.openai.com'), int(page_id % 4)), '");')"""


def tree(spark, sf, content=lambda html: html) -> DataFrame:
    """Pages as files of seven repositories, each with an import and an endpoint line added."""
    body = content(F.col("html"))
    return spread(spark, sf, "pages").select(
        F.expr("concat('org/site', page_id % 7)").alias("repo"), F.lit("c0ffee").alias("commit_sha"), page_path().alias("path"),
        body.cast("binary").alias("content")).withColumn("length", F.octet_length("content").cast("bigint"))


def source_tree(spark, sf) -> DataFrame:
    added = F.expr(IMPORTS)
    return tree(spark, sf, lambda html: F.when(
        F.col("page_id") % 11 == 4, F.concat(F.lit(chr(0)), html)).otherwise(F.concat(html, F.lit("\n"), added)))
