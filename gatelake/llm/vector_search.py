"""Exact top-k search by inner product, with bounds from segment statistics at several resolutions.

Vectors are cut into 1, 4 and 16 segments, and of each segment the mean and the deviation are kept. For two vectors the
inner product of a segment is at most length * (mean * mean + deviation * deviation), so the sum over segments bounds the
score from above, which is the lower bound of the distance. Bounds are taken coarse to fine; only candidates whose
bounds reach the k-th best score known are scored exactly.

Equal vectors are one class that holds its few smallest ids, as no query needs more of them. Classes are dealt over
blocks by hash; a task holds one block and lets all query vectors pass it in batches, so memory is bounded by the block
and the batch. Every query starts with the k-th best score of a bounded sample, so blocks report little more than hits.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored, tasks

K = 5
SCALE = 256
SEGMENTS = (1, 4, 16)
CHUNK = 4096               # candidates whose bounds are taken at once,
BATCH = 256                # against so many queries
LEAST_BLOCK = 4096         # classes of a block while there are fewer blocks than tasks
LARGEST_BLOCK = 131_072    # and at most, whatever the input
SAMPLE = 2048              # classes that give the first k-th best scores
_LONG = np.iinfo(np.int64)


def matrix_of(column: pa.ListArray, width: int = 0) -> np.ndarray:
    """Rows of whole numbers, shorter ones padded with zeros, to a multiple of the finest segments."""
    sizes = column.value_lengths().to_numpy().astype(np.int64)
    width = max(width, int(sizes.max(initial=1)))
    width = -(-width // SEGMENTS[-1]) * SEGMENTS[-1]
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def statistics(rows: np.ndarray) -> list[np.ndarray]:
    """For each resolution a row of means, then deviations, times the root of the length: products of rows are bounds."""
    out = []
    for n in SEGMENTS:
        cut = rows.astype(np.float64).reshape(len(rows), n, -1)
        out.append(np.concatenate([cut.mean(axis=2), cut.std(axis=2)], axis=1) * np.sqrt(cut.shape[2]))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; by floats where every partial sum is a whole number that they hold, else by Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2 ** 53:
        kind = np.float32 if most < 2 ** 24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -_LONG.max, _LONG.max).astype(np.int64)


class Block:
    """The classes of a block: their vectors, statistics, numbers and smallest ids, longest vectors first."""

    def __init__(self, rows: np.ndarray, number: np.ndarray, first: np.ndarray) -> None:
        order = np.argsort(-np.linalg.norm(rows.astype(np.float64), axis=1), kind="stable")
        self.rows, self.number, self.first = rows[order], number[order], first[order]
        self.statistics = statistics(self.rows)

    def best(self, queries: np.ndarray, least: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) of the k best classes of each query that reach its least score, ties to the smaller id."""
        width = max(queries.shape[1], self.rows.shape[1])
        if width > self.rows.shape[1]:
            self.__init__(np.pad(self.rows, ((0, 0), (0, width - self.rows.shape[1]))), self.number, self.first)
        queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        asked = statistics(queries)
        least = least.astype(np.float64)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)
        for at in range(0, len(self.rows), CHUNK):
            wanted, held = np.arange(len(queries)), np.arange(at, min(at + CHUNK, len(self.rows)))
            for of_query, of_class in zip(asked, self.statistics, strict=True):
                bound = of_query[wanted] @ of_class[held].T
                reach = bound + 1e-9 * np.abs(bound) + 1e-6 >= least[wanted, None]
                wanted, held = wanted[reach.any(axis=1)], held[reach.any(axis=0)]
                if not len(wanted):
                    break
            else:
                scores = products(queries[wanted], self.rows[held])
                hits = scores >= least[wanted, None]
                for i in np.flatnonzero(hits.any(axis=1)).tolist():
                    q, here = int(wanted[i]), np.flatnonzero(hits[i])
                    place = np.concatenate([found[q][0], held[here]])
                    score = np.concatenate([found[q][1], scores[i][here]])
                    kept = np.lexsort((self.first[place], -score))[:k]
                    found[q] = (place[kept], score[kept])
                    if len(kept) == k:
                        least[q] = max(least[q], float(score[kept[-1]]) if abs(score[kept[-1]]) < 2 ** 53 else least[q])
        return found


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _sampled_least(queries: DataFrame, sample: Block | None, k: int) -> DataFrame:
    """queries (query, vector) with least: the k-th best score among the sample, if it has that many classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, -_LONG.max)
            for at in range(0, batch.num_rows if sample else 0, BATCH):
                rows = matrix_of(batch.column(1).slice(at, BATCH))
                for i, (_, score) in enumerate(sample.best(rows, np.full(len(rows), -np.inf), k)):
                    if len(score) == k:
                        out[at + i] = score[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], ["query", "vector", "least"])

    return queries.mapInArrow(run, "query long, vector array<long>, least long")


def _passed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, classes before queries; gives (query, class, score, first) of the best of the block."""
    now, parts, block = None, [], None
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if not part.num_rows:
                continue
            if blocks[a] != now:
                now, parts, block = blocks[a], [], None
            asking = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            split = int(np.argmax(asking)) if asking.any() else part.num_rows
            if split:
                parts.append(part.slice(0, split))
            if split == part.num_rows or not (parts or block):
                continue
            if block is None:
                joined = pa.Table.from_batches(parts).combine_chunks()
                vectors = joined.column("vector").chunk(0) if joined.num_rows else joined.column("vector").combine_chunks()
                block, parts = Block(matrix_of(vectors), joined.column("number").to_numpy(), joined.column("bound").to_numpy()), []
            part = part.slice(split)
            for at in range(0, part.num_rows, BATCH):
                some = part.slice(at, BATCH)
                number = some.column(2).to_numpy()
                found = block.best(matrix_of(some.column(4)), some.column(3).to_numpy(), k)
                place = np.concatenate([p for p, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(number, [len(p) for p, _ in found])), pa.array(block.number[place]),
                     pa.array(np.concatenate([s for _, s in found]), pa.int64()), pa.array(block.first[place])], ["query", "class", "score", "first"])


def nearest(vectors: DataFrame, every: int, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row whose id is divisible by `every`, itself left out.

    A component x becomes floor(scale * x), kept within 64 bits; the score is the inner product of whole numbers, kept
    within 64 bits too. Equal scores go to the smaller id, null ids last. Vectors that are null or hold a null or
    non-finite component take no part; shorter vectors count as padded with zeros, empty ones score 0. Rows are told
    apart even if they repeat: each of several rows of one id is a query, to which the others are candidates. A null id
    is no query. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = stored(raw.where(_usable(F.col("vector"))).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("vector", lambda x: F.floor(x * float(scale)).cast("long")).alias("vector")),
        "vectors")
    place = F.struct(F.col("vec_id").isNull().alias("last"), "vec_id", "row")
    order = Window.partitionBy("vector").orderBy(place)
    few = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)  # one more, as a query is none of its own
    classes = stored(few.groupBy("vector").agg(F.sort_array(F.collect_list(place)).alias("ids")).select(
        F.monotonically_increasing_id().alias("class"), "vector", "ids"), "vector-classes")
    asking = rows.where(F.col("vec_id") % every == 0)
    queries = stored(asking.select("vector").distinct().select(F.monotonically_increasing_id().alias("query"), "vector"), "query-vectors")

    n = classes.count()
    blocks = max(1, min(tasks(spark), -(-n // LEAST_BLOCK)), -(-n // LARGEST_BLOCK))
    sample = classes.orderBy(F.xxhash64("class")).limit(SAMPLE).select("class", F.coalesce(F.col("ids")[0].vec_id, F.lit(_LONG.max)).alias("first"), "vector").toArrow()
    held = Block(matrix_of(sample.column("vector").combine_chunks()), sample.column("class").to_numpy(), sample.column("first").to_numpy()) if n else None
    begun = stored(_sampled_least(queries, held, k + 1), "queries")
    dealt = classes.select(F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), F.col("class").alias("number"),
                           F.coalesce(F.col("ids")[0].vec_id, F.lit(_LONG.max)).alias("bound"), "vector")
    asks = begun.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), F.col("query").alias("number"),
                        F.col("least").alias("bound"), "vector")
    met = dealt.unionByName(asks).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks").mapInArrow(
        lambda it: _passed(it, k + 1), "query long, class long, score long, first long")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "first", "class")
    top = stored(met.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth"), "best-classes")
    each = top.join(classes.select("class", F.explode("ids").alias("id")), "class")  # at most k + 1 classes of k + 1 rows
    hits = each.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("below"), "id"))), 1, k + 1).alias("hits"))
    answers = stored(queries.join(hits, "query").select("vector", "hits"), "answers")
    own = asking.select(F.col("row"), F.col("vec_id").alias("query_id"), "vector").join(answers, "vector")
    left = F.slice(F.filter("hits", lambda h: h.id.row != F.col("row")), 1, k)
    return own.select("query_id", F.posexplode(left).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id.vec_id").alias("vec_id"), (-F.col("hit.below")).alias("score"))


#: The same by all scores of the queries.
QUERY_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.n <> b.n WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS place FROM pairs)
SELECT query_id, place::INT AS rank, vec_id, score FROM ranked WHERE place <= {K}
"""
