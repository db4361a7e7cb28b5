"""Exact de-duplication with two passes over a Bloom filter.

Pass one counts how often each filter slot is hit and keeps, as bitmaps, the slots hit more than once. Pass two tests
every row against these bitmaps: a row with a slot hit only once is certainly alone and passes straight through, and
only rows whose slots were all hit again are shuffled, to be told apart by their SHA-256.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: Slots of the filter; it is broadcast as bitmaps, so 2**26 bits are 8 MiB at most, whatever the input. A larger
#: corpus names more: 2**30 bits (128 MiB) leave about 2 % of 4e8 distinct texts to be shuffled for nothing. A filter
#: too small for its corpus only shuffles more rows; the result stays the same.
FILTER_BITS = 1 << 26
HASHES = 2
BITMAP_BITS = 32768  # of one value of bitmap_construct_agg


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def slot(digest: Column, k: int, bits: int) -> Column:
    """The k-th slot of a digest, from 1 to bits."""
    return F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits)) + 1


def repeated_slots(digests: DataFrame, bits: int) -> DataFrame:
    """Bitmaps (bucket, bits_set) of the slots that more than one row hits."""
    slots = digests.select(F.explode(F.array(*[slot(F.col("text_sha256"), k, bits) for k in range(HASHES)])).alias("slot"))
    # A row may hit one slot with both of its hashes; such a slot counts as repeated, which only shuffles one row more.
    twice = slots.groupBy("slot").count().where("count > 1")
    return twice.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits_set"))


def with_flag(rows: DataFrame, bitmaps: DataFrame, bits: int, flag: str = "maybe_repeated") -> DataFrame:
    """rows with a boolean: whether all slots of its text_sha256 are in the bitmaps, whose size bits bounds."""
    found = F.lit(True)
    for k in range(HASHES):
        at, bucket, held = slot(F.col("text_sha256"), k, bits), f"bucket_{k}", f"bits_set_{k}"
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(bucket), F.col("bits_set").alias(held)))
        rows = rows.join(side, F.floor((at - 1) / BITMAP_BITS) + 1 == F.col(bucket), "left")
        place = F.pmod(at - 1, F.lit(BITMAP_BITS))
        byte = F.conv(F.hex(F.substring(F.col(held), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1
        found = found & F.coalesce(bit, F.lit(False))
    return rows.withColumn(flag, found).drop(*[f"{c}_{k}" for k in range(HASHES) for c in ("bucket", "bits_set")])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id stays; a null id
    ranks below all others, and of rows equal in id and text exactly one is kept. keep_id is null only where all ids
    of a group are. An empty table gives no rows; other columns are not read.
    """
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("text_sha256"),
                              F.monotonically_increasing_id().alias("row")), "digests")
    bitmaps = stored(repeated_slots(rows, filter_bits), "bitmaps")
    marked = with_flag(rows, bitmaps, filter_bits)
    flagged = marked.where("maybe_repeated")
    # Stored, so that the join below shuffles both sides and a group with a third of all rows can be split there.
    groups = stored(flagged.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("keeper"),
                                                       F.count(F.lit(1)).alias("group_size")), "groups")
    settled = flagged.join(groups, "text_sha256").select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keeper.row")).alias("kept"), "text_sha256")
    alone = marked.where("not maybe_repeated").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(settled)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns; rows that are surely alone are not shuffled."""
    digests = stored(docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("text_sha256")), "digests")
    bitmaps = stored(repeated_slots(digests, filter_bits), "bitmaps")
    flagged = with_flag(digests, bitmaps, filter_bits).where("maybe_repeated")
    sizes = flagged.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    winners = stored(sizes.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "n")).alias("w")).select("text_sha256", "w.*"), "winners")
    rows = with_flag(docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("doc_id"),
                                 digest_of(F.col(text_col)).alias("text_sha256")), bitmaps, filter_bits)
    again = rows.where("maybe_repeated").alias("r").join(
        winners.alias("w"), (F.col("r.text_sha256") == F.col("w.text_sha256")) & F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")),
        "left_semi")
    # Only rows equal in id and text are left to fold, and only if there are any.
    once = again if winners.where("n > 1").isEmpty() else again.dropDuplicates(["text_sha256"])
    return rows.where("not maybe_repeated").select("whole.*").unionByName(once.select("whole.*"))


QUERY_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)
"""
