"""Token files: ids replaced by their frequency rank and written in a byte-aligned variable-length code.

A rank takes 1 to 4 bytes, little-endian; a control byte apart from them holds the sizes of four ranks, two bits each,
first rank lowest. A document is the row (doc_id, n_tokens, control, data); files are Parquet holding such rows in
ascending doc_id order, in one folder per range of ids. The rank table lies beside them, so a folder decodes alone.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import scratch, stored
from .tokens import byte_bpe_ids

VOCABULARY = 50_257
END_ID = 0
#: Tokens in one range of ids, and so in one file.
FILE_TOKENS = 16_000_000

#: By control byte: the sizes of its four ranks.
_SIZES = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4", copy=False)
    sizes = ((ranks > 0xFF).view(np.uint8) + (ranks > 0xFFFF).view(np.uint8) + (ranks > 0xFFFFFF).view(np.uint8))
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[:len(ranks)] = sizes
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    kept = np.arange(4, dtype=np.uint8) <= sizes[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks: sizes by table lookup from the control bytes, then each rank from as many bytes at its offset."""
    sizes = _SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(sizes, dtype=np.int64)
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    at = ends - sizes
    value = padded[at]
    for k in (1, 2, 3):
        if (more := sizes > k).any():
            value[more] |= padded[at[more] + k] << (8 * k)
    return value


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids of every whole text with END_ID, as little-endian 16-bit numbers."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.append(byte_bpe_ids(t.as_py()), END_ID).astype("<u2") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()),
                                              pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def rank_order(tokens: DataFrame) -> np.ndarray:
    """Ids by falling count over all documents, equal counts by id; the driver gets one row per id of the vocabulary."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_py(), "<u2"), minlength=VOCABULARY)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(VOCABULARY, np.int64)
    for row in counts:
        total[row.id] = row.n
    return np.argsort(-total, kind="stable")


def write_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> None:
    """Writes the token files of docs below path: documents, ranks and the ranges with their first token's position.

    Documents come in ascending order of their numeric ids, null ids first, equal ids in any order among themselves.
    Each range of ids is one task and one file, so a corpus of many trillion tokens names more tokens to a file.
    """
    spark = docs.sparkSession
    tokens = stored(tokenised(docs, id_col, text_col), "tokens")
    order = rank_order(tokens)
    ranks = np.empty(VOCABULARY, np.uint32)
    ranks[order] = np.arange(VOCABULARY, dtype=np.uint32)
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    cuts = -(-total // file_tokens)
    bounds = [] if cuts < 2 else sorted({x for x in tokens.agg(F.percentile_approx(
        "doc_id", [k / cuts for k in range(1, cuts)], 100_000)).first()[0] or [] if x is not None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [encode(ranks[np.frombuffer(x.as_py(), "<u2")]) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())],
                ["doc_id", "n_tokens", "control", "data"])

    schema = f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, n_tokens long, control binary, data binary"
    part = F.lit(0)
    if bounds:
        part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("doc_id")))
    coded = tokens.mapInArrow(run, schema).withColumn("part", part)
    coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id").write.partitionBy("part").option(
        "compression", "zstd").parquet(f"{path}/documents")
    spark.createDataFrame([(i, int(t)) for i, t in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    sizes = tokens.select(part.alias("part"), "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sizes.select("part", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first")).coalesce(1).write.parquet(f"{path}/parts")


def read_files(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the token files below path; ids as little-endian 32-bit numbers."""
    by_rank = np.zeros(VOCABULARY, np.uint32)
    for row in spark.read.parquet(f"{path}/ranks").collect():
        by_rank[row.rank] = row.id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [by_rank[decode(c.as_py(), d.as_py(), n.as_py())].astype("<u4").tobytes()
                   for n, c, d in zip(batch.column(1), batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "n_tokens", "part", "ids_crc32", "ids"])

    rows = spark.read.schema(f"doc_id {id_type}, n_tokens bigint, control binary, data binary, part int").parquet(f"{path}/documents")
    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long, part int, ids_crc32 long, ids binary")


def token_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the token files and reads them back: doc_id, start, n_tokens, ids_crc32 of every document.

    A null text counts as empty: its only token is END_ID. Equal ids keep rows each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "token-files")
    write_files(docs, path, id_col, text_col, file_tokens)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    read = stored(read_files(spark, path, kind).drop("ids"), "token-digests")
    # A range of ids has a bounded number of tokens, so its running sum is one bounded task.
    before = Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    first = spark.read.schema("part int, n_tokens long, first long").parquet(f"{path}/parts").select("part", "first")
    return read.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(F.broadcast(first), "part").select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
