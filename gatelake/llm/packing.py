"""Hierarchical best-fit packing.

Each task packs its own items by best fit, largest first, a chunk at a time, and emits the bins that are nearly full. The
underfull bins go up a tree: tasks of the next level take them as items of their fill, best-fit them into common bins,
emit what is nearly full and pass the rest on. There are fewer tasks on each level, but never more than a chunk of bins
to each; the tree ends at one task, or where the bins that are left no longer fit together.

What is then left is taken apart for one last round: its items are counted by length, of which there are at most as many
as a bin has tokens, and best fit on counts places equal items together: so many sequences of one pattern. An item finds
its sequence from its rank among the items of its length. No bin is closed for want of memory, and what is held does not
grow with the number of items.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import stored, tasks
from .tokens import byte_bpe_ids

CAPACITY = 1024
END_ID = 2
SLACK = 4          # a bin with so few free tokens is nearly full
CHUNK = 65_536     # items packed at once
FAN_IN = 8         # tasks whose bins meet in one task of the next level
FEW_COUNTS = 200_000  # counts of (task, length) that may be broadcast
_ITEM = ("doc_id", "piece", "start", "length", "ids_crc32")


def pieces_of(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece; of a longer document the first piece takes what full pieces leave."""
    first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, len(ids), capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every whole text; each document ends with END_ID."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(byte_bpe_ids(text.as_py()), END_ID).astype("<u4")
                for k, (s, n) in enumerate(pieces_of(ids, capacity)):
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s:s + n].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], list(_ITEM))

    return rows.mapInArrow(cut, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(items: list[tuple[int, object]], capacity: int = CAPACITY) -> list[tuple[int, list]]:
    """(fill, items) of each bin that best fit makes of items (length, anything), largest first."""
    fills: list[int] = []
    members: list[list] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while some bin has room r
    for item in sorted(items, key=lambda x: -x[0]):
        length = item[0]
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            fills[at] += length
            members[at].append(item)
        else:
            room, at = capacity, len(fills)
            fills.append(length)
            members.append([item])
        left = room - length
        if left:
            by_room[left].append(at)
            rooms |= 1 << left
    return list(zip(fills, members, strict=True))


def fitted(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, largest first, of so many items of each length: (times, [(length, how many)]) for each pattern of a bin.

    Bins of one pattern take equal items together. A length cuts at most one group of bins, into three, and opens at
    most two, so there are at most four patterns a length, however many items there are.
    """
    by_room: dict[int, list[tuple[int, list]]] = {}
    rooms = 0  # bit r is set while some group has room r

    def put(times: int, room: int, held: list) -> None:
        nonlocal rooms
        if times:
            by_room.setdefault(room, []).append((times, held))
            rooms |= 1 << room

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                times, held = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, times, held = capacity, -(-left // (capacity // length)), []
            each = room // length  # best fit goes on filling the bin it has just put an item in
            full = min(times, left // each)
            put(full, room - each * length, [*held, (length, each)])
            left, times = left - full * each, times - full
            if left and times:
                put(1, room - left * length, [*held, (length, left)])
                left, times = 0, times - 1
            put(times, room, held)
    return [group for room in sorted(by_room) for group in by_room[room]]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (key, start, sequence, each, offset), by key: items of a length ranked from start on lie, each to a bin, in
    the sequences from sequence on, from offset on. key is length << 40, plus start.
    """
    rows, placed, sequence = [], Counter(), 0
    for times, held in patterns:
        offset = 0
        for length, each in held:
            rows.append(((length << 40) + placed[length], placed[length], sequence, each, offset))
            placed[length] += times * each
            offset += length * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


_ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _chunked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    waiting: list[tuple] = []
    for batch in batches:
        waiting += zip(*[c.to_pylist() for c in batch.columns], strict=True)
        while len(waiting) >= size:
            yield waiting[:size]
            waiting = waiting[size:]
    yield waiting


def merged_bins(bins: DataFrame, nodes: int, capacity: int = CAPACITY) -> list[DataFrame]:
    """The levels of the tree over bins (bin, fill), stored tables (bin, into, shift, fill, underfull) of merged bins.

    A bin is named after its first member. Of each level only the underfull bins go up to the next.
    """
    schema = "bin long, into long, shift long, fill long, underfull boolean"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunked(batches, CHUNK):
            rows = []
            for fill, held in best_fit([(fill, name) for name, fill in part], capacity):
                shift = 0
                for length, name in held:
                    rows.append((name, held[0][1], shift, fill, fill < capacity - SLACK))
                    shift += length
            yield _batch(rows, schema)

    levels: list[DataFrame] = []
    n = bins.count()
    while n > 1:
        fewer = max(1, -(-nodes // FAN_IN), -(-n // CHUNK))
        if fewer >= nodes:
            break
        nodes = fewer
        met = bins.select("bin", "fill", F.pmod(F.xxhash64("bin"), F.lit(nodes)).cast("int").alias("node")).repartitionById(nodes, F.col("node"))
        levels.append(stored(met.select("bin", "fill").mapInArrow(merge, schema), "merged-bins"))
        bins = levels[-1].where("underfull and bin = into").select("bin", "fill")
        n = bins.count()
    return levels


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Lengths are from 1 to capacity. Repeated rows are packed as often as they occur. An empty table gives no rows.
    """
    kind = items.schema["doc_id"].dataType
    if isinstance(kind, T.NullType):
        items, kind = items.withColumn("doc_id", F.col("doc_id").cast("long")), T.LongType()
    item = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    schema = f"{item}, bin long, offset long, fill long, underfull boolean"

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 33
        for part in _chunked(batches, CHUNK):
            rows = []
            for fill, held in best_fit([(row[3], row) for row in part], capacity):
                offset = 0
                for length, row in held:
                    rows.append((*row, name, offset, fill, fill < capacity - SLACK))
                    offset += length
                name += 1
            yield _batch(rows, schema)

    given = [*_ITEM, "sequence_id", "offset"]
    dealt = items.select(*_ITEM)
    local = stored(dealt.mapInArrow(leaves, schema), "packed")
    done = local.where("not underfull").select(*_ITEM, F.col("bin").alias("sequence_id"), "offset")
    left = local.where("underfull").select(*_ITEM, "bin", "offset", "fill")
    bins = stored(left.groupBy("bin").agg(F.first("fill").alias("fill")), "open-bins")
    for level in merged_bins(bins, tasks(items.sparkSession), capacity):
        moved = level.select("bin", "into", "shift", F.col("fill").alias("filled"), "underfull")
        left = stored(left.join(moved, "bin").select(
            *_ITEM, F.col("into").alias("bin"), (F.col("offset") + F.col("shift")).alias("offset"), F.col("filled").alias("fill"), "underfull"), "risen")
        done = done.unionByName(left.where("not underfull").select(*_ITEM, F.col("bin").alias("sequence_id"), "offset"))
        left = left.where("underfull").drop("underfull")
    return done.unionByName(_by_counts(left.select(*_ITEM), item, capacity).select(*given))


def _by_counts(over: DataFrame, item: str, capacity: int) -> DataFrame:
    """The last round: over, items of underfull bins, with sequence_id and offset from one best fit on counts."""
    schema = f"{item}, node long, nth long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, node = Counter(), TaskContext.get().partitionId()
        for batch in batches:
            nth = []
            for length in batch.column("length").to_pylist():
                nth.append(seen[length])
                seen[length] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([node] * len(nth), pa.int64()), pa.array(nth, pa.int64())],
                                             [*_ITEM, "node", "nth"])

    numbered = stored(over.mapInArrow(number, schema), "left-over")
    counts = stored(numbered.groupBy("node", "length").agg(F.count(F.lit(1)).alias("n")), "open-counts")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = slots(fitted(totals, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sequence, each, offset = plan.T
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(key, (length << 40) + rank, side="right") - 1
            among = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(_ITEM)], pa.array((1 << 60) + sequence[at] + among // each[at], pa.int64()),
                 pa.array(offset[at] + among % each[at] * length, pa.int64())], [*_ITEM, "sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    bases = stored(counts.select("node", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "open-bases")
    if bases.count() <= FEW_COUNTS:
        bases = F.broadcast(bases)
    ranked = numbered.join(bases, ["node", "length"]).select(*_ITEM, (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, f"{item}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and is a piece of the end id alone. Null ids are carried along, repeated rows are
    packed each, an empty table gives no rows, other columns are not read.
    """
    cut = stored(pieces(docs, id_col, text_col, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    # Spread by row, as ids may be equal or null, and as a local packing needs tens of thousands of mixed items.
    return pack(cut.repartition(tasks(docs.sparkSession), F.xxhash64("row")), capacity)
