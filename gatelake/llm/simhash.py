"""SimHash near-duplicates: fingerprints, shard BK-trees searched within the radius, components of the links.

Fingerprints at most 3 bits apart agree in one of four 16-bit blocks, so a shard holds the distinct fingerprints that
share one block value, and one BK-tree is built for each shard. A shard above SHARD_LIMIT is cut anew by the blocks of
its other 48 bits; what is still larger is cut into slices, and the tree of each slice is sent to every later slice.
A search reports a spanning forest of the links it finds, never all pairs of a dense group.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, tasks, without
from .components import components
from .exact_dedup import digest_of

RADIUS = 3
SHINGLE = 3
SHARD_LIMIT = 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # bits of each byte value


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the hashes of all shingles; a text without words has none set."""
    found = (text or "").encode().lower().split()  # on bytes both are ASCII only: A-Z, space and \x09 to \x0D
    if not found:
        return 0
    grams = [b" ".join(found)] if len(found) < shingle else map(b" ".join, zip(*[found[i:] for i in range(shingle)], strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], "<u8")
    octets = hashes.view("u1").reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 digests: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; with digests also text_sha256."""
    beside = [digest_of(F.col(text_col)).alias("text_sha256")] if digests else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *beside)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), *batch.columns[2:]],
                                             ["doc_id", "fp", *["text_sha256"] * digests])

    return rows.mapInArrow(compute, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long" + ", text_sha256 string" * digests)


class BKTree:
    """Each child hangs under the Hamming distance to its parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new, node = len(self.values), 0
        while node < new:
            children = self.children[node]
            node = children.setdefault((value ^ self.values[node]).bit_count(), new)
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Indexes of all values at most radius away; only edges from distance - radius to distance + radius are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            apart = (value ^ self.values[node]).bit_count()
            if apart <= radius:
                found.append(node)
            for edge, child in self.children[node].items():
                if -radius <= edge - apart <= radius:
                    todo.append(child)
        return found


def _block_keys(fp: Column, first: int, width: int, count: int) -> list[Column]:
    """Keys (block, value) of count blocks of width bits, from bit first on."""
    return [F.shiftrightunsigned(fp, first + i * width).bitwiseAND((1 << width) - 1) + F.lit(i << width) for i in range(count)]


def _sized(keyed: DataFrame) -> DataFrame:
    """keyed with n, the size of its shard, where that is above the limit; only those few are listed."""
    large = stored(keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_LIMIT), "large-shards")
    return keyed.join(large, "shard", "left")


def shards(classes: DataFrame) -> DataFrame:
    """(shard, tree, ask, fp, in_tree): each row puts a fingerprint into the tree of a slice or asks that tree with it.

    Every pair of fingerprints within the radius meets in a shard. Slices tree <= ask of a shard meet pairwise.
    """
    fp = F.col("fp")
    first = classes.select("fp", F.explode(F.array(*_block_keys(fp, 0, 16, 4))).alias("shard"))
    sized = _sized(first)
    # The 48 bits outside the shard's own block, in four blocks of 12.
    block, rest = F.shiftright(F.col("shard"), 16).cast("int"), None
    for b in range(4):
        low = fp.bitwiseAND((1 << (16 * b)) - 1)
        outside = low if b == 3 else F.shiftleft(F.shiftrightunsigned(fp, 16 * b + 16), 16 * b) + low
        rest = F.when(block == b, outside) if rest is None else rest.when(block == b, outside)
    second = sized.where("n is not null").select("fp", "shard", rest.alias("rest")).select("fp", F.explode(F.array(*[
        F.col("shard") * (1 << 14) + key + (1 << 40) for key in _block_keys(F.col("rest"), 0, 12, 4)])).alias("shard"))
    finer = _sized(second)
    slices = F.ceil(F.col("n") / SHARD_LIMIT).cast("int")
    mine = F.pmod(F.xxhash64("fp"), slices).cast("int")
    cut = finer.where("n is not null").select("shard", "fp", slices.alias("slices"), mine.alias("mine")).select(
        "shard", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("with"))
    whole = sized.where("n is null").select("shard", "fp").unionByName(finer.where("n is null").select("shard", "fp"))
    return whole.select("shard", F.lit(0).alias("tree"), F.lit(0).alias("ask"), "fp", F.lit(True).alias("in_tree")).unionByName(
        cut.select("shard", F.least("mine", "with").alias("tree"), F.greatest("mine", "with").alias("ask"), "fp",
                   (F.col("mine") <= F.col("with")).alias("in_tree")))


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, tree, ask, asked last); only one shard's slices are held."""
    key, tree, parent = None, BKTree(), {}
    a: list[int] = []
    b: list[int] = []

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for shard, t, q, fp, in_tree in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            value = fp & 0xFFFFFFFFFFFFFFFF
            if key != (shard, t, q):
                key, tree, parent = (shard, t, q), BKTree(), {}
            if t == q or not in_tree:
                for node in tree.within(value, radius):
                    x, y = root(value), root(tree.values[node])
                    if x != y:
                        parent[x] = y
                        a.append(fp)
                        b.append(tree.values[node])
            if in_tree:
                tree.add(value)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(np.array(b, np.uint64).view(np.int64), pa.int64())], ["a", "b"])
            a, b = [], []


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints: within each shard a spanning forest of all pairs within the radius."""
    if radius > RADIUS:
        raise ValueError("four blocks find pairs of at most three differing bits")
    rows = shards(classes).repartition(tasks(classes.sparkSession), "shard", "tree", "ask").sortWithinPartitions(
        "shard", "tree", "ask", F.col("in_tree").desc())
    return rows.mapInArrow(lambda it: _links(it, radius), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most radius bits; null ids are never the smallest, so
    it is null only where all ids of a component are. Null and empty texts have fingerprint zero, linked like any
    other. Repeated rows give repeated rows; an empty table gives none; other columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    names = lowest_of(classes, radius).select("fp", F.col("lowest").alias("component_id"))
    return prints.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def lowest_of(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, lowest), stored: the smallest `first` in the component of every fingerprint of classes(fp, first), a stored table."""
    found = stored(components(links(classes, radius)), "components")
    members = found.join(classes, found.vertex == classes.fp).select("fp", "root", "first")
    lowest = members.groupBy("root").agg(F.min("first").alias("lowest"))
    linked = stored(members.select("fp", "root").join(lowest, "root").select("fp", "lowest"), "linked")
    return stored(classes.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("lowest")), "names")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     radius: int = RADIUS) -> DataFrame:
    """One row of docs of each component: that with the smallest id, nulls last, then the smallest SHA-256 of the text.

    Rows are told apart by id and text, so null and repeated ids decide nothing for other texts; of rows equal in both,
    which are one document sent again, any one stays.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle, digests=True), "fingerprints")
    keys = stored(prints.groupBy("fp", "text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n")), "keys")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_sha256")
    names = lowest_of(stored(keys.groupBy("fp").agg(F.min(place).alias("first")), "classes"), radius)
    kept = F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("text_sha256") == F.col("lowest.text_sha256"))
    judged = keys.join(names, "fp").select("doc_id", "text_sha256", "n", kept.alias("kept"))
    key = [F.col(id_col), digest_of(F.col(text_col))]
    rows = without(docs, stored(judged.where("not kept").select("doc_id", "text_sha256"), "near-copies"), *key)
    again = stored(judged.where("kept and n > 1").select("doc_id", "text_sha256"), "repeated")
    if again.isEmpty():
        return rows
    # Only rows equal in id and text are folded, the others are not moved for it.
    folded = without(docs, again, *key, how="left_semi").select(F.struct("*").alias("whole"), *[k.alias(n) for k, n in zip(key, ("k0", "k1"))])
    return without(rows, again, *key).unionByName(folded.dropDuplicates(["k0", "k1"]).select("whole.*"))
