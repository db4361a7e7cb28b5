"""Connected components of a link table, by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _hooked(edges: DataFrame, key: str, other: str, lowest: DataFrame) -> DataFrame:
    """(other, low) for each edge, low being the lowest vertex next to key; lowest is stored, so a hot key can be split."""
    return edges.join(lowest, key).select(F.col(other).alias("a"), F.col("low").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of links(a, b); root is the lowest vertex of its component.

    Every round is written to the shared folder. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("vertex"), F.col("b").alias("root"))).distinct()
        seen = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "large-low")
        large = stored(_hooked(both.where("b > a"), "a", "b", low).distinct(), "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("low")), "small-low")
        small = _hooked(large, "a", "b", low).where("a <> b").unionByName(low.select("a", F.col("low").alias("b")))
        edges = stored(small.distinct(), "small")
