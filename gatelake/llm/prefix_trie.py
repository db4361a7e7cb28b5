"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

Turns are put in order by a range sort that may split a conversation over many tasks; a place in it and the hash of
what precedes are then sums of the slices before and a running sum within the slice. The hash of a prefix is the sum of
hashes of its turns, each with its depth, so it needs no pass from turn to turn. Equal prefixes are one node.

Subtree totals come from rounds of joins. Each round rakes the leaves into their parents and splices every other node
out of the unary chains, chosen by a hash, whose child then hangs under its parent. What is spliced is kept with
what it adds to its child's total; at the end those links are followed by doubling to give every node its total.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored, tasks

CENTURY = 100   # conversations that share the first turns of the lowest
SHARED = 6      # so many of them at most, less one
IDS_CHUNK = 4096
_MASK = (1 << 61) - 1


def ordered(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with place, from 1, in their conversation: by turn, null first, then role and text.

    The rows are dealt by ranges of that order, so that no conversation has to fit in a task.
    """
    key = ["conv_id", "turn", "role", "text", "row"]
    rows = turns.withColumn("row", F.monotonically_increasing_id())
    cut = rows.repartitionByRange(tasks(turns.sparkSession), *key).sortWithinPartitions(*key).select(
        "conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"))
    schema = "conv_id long, turn long, role string, text string, part int, local long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            out = []
            for conv in batch.column(0).to_pylist():
                count = count + 1 if conv == last else 1
                last = conv
                out.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "local"])

    local = stored(cut.mapInArrow(number, schema), "turns")
    before = _before(local.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")), "n")
    return local.join(before, ["conv_id", "part"], "left").select(
        "conv_id", "part", (F.col("local") + F.coalesce("n", F.lit(0))).alias("place"), "role", "text")


def _before(slices: DataFrame, *sums: str) -> DataFrame:
    """slices (conv_id, part, sums) with the sums of the earlier slices of the conversation, where it has any."""
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task at most
    return slices.select("conv_id", "part", *[F.sum(c).over(earlier).alias(c) for c in sums]).where(F.col(sums[0]).isNotNull())


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, ends): turns (conv_id, part, depth, role, text) of all rebuilt conversations, ends (conv_id, depth).

    Of conversation c the first crc32(c) % SHARED turns are those of the lowest conversation of its century.
    """
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed = stored(ordered(turns), "placed")
    convs = placed.groupBy("conv_id").agg(F.max("place").alias("size")).select(
        "conv_id", "size", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % CENTURY).alias("base"))
    firsts = placed.where((F.col("conv_id") % CENTURY == 0) & (F.col("place") < SHARED)).select(
        F.col("conv_id").alias("base"), F.col("place").alias("depth"), "role", "text")
    held = firsts.groupBy("base").agg(F.max("depth").alias("held"))  # at most SHARED - 1 turns
    plan = stored(convs.join(held, "base", "left").select(
        "conv_id", "size", "h", "base", F.least("h", F.coalesce("held", F.lit(0))).alias("shared")), "rebuild-plan")
    lead = plan.where("shared > 0").join(firsts, "base").where("depth <= shared").select("conv_id", F.lit(-1).alias("part"), "depth", "role", "text")
    own = placed.join(plan, "conv_id").where("place > h").select(
        "conv_id", "part", (F.col("place") - F.col("h") + F.col("shared")).alias("depth"), "role", "text")
    ends = plan.select("conv_id", (F.col("shared") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("depth"))
    return lead.unionByName(own), ends


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, a, b, pa, pb), stored: two 61-bit hashes of each prefix, and of the prefix before it."""
    def mark(salt: int) -> Column:
        return F.xxhash64(F.lit(salt), "depth", "role", "text").bitwiseAND(_MASK)

    marks = turns.select("conv_id", "part", "depth", F.length("text").cast("long").alias("chars"), mark(1).alias("a"), mark(2).alias("b"))
    dealt = marks.repartition(tasks(turns.sparkSession), "conv_id", "part").sortWithinPartitions("conv_id", "part", "depth")
    names = ["conv_id", "part", "depth", "chars", "a", "b", "la", "lb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.zeros(2, np.uint64)
        for batch in batches:
            conv, part = (batch.column(i).to_numpy() for i in (0, 1))
            new = np.ones(len(conv), bool)
            new[1:] = (conv[1:] != conv[:-1]) | (part[1:] != part[:-1])
            if len(conv):
                new[0] = last != (conv[0], part[0])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))  # -1: the slice goes on from the last batch
            out = []
            for k, name in enumerate(("a", "b")):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(batch.column(name).to_numpy().astype(np.uint64))])
                out.append((sums[1:] - np.where(begin >= 0, sums[begin], 0) + np.where(begin >= 0, np.uint64(0), kept[k])) & np.uint64(_MASK))
            if len(conv):
                last, kept = (conv[-1], part[-1]), np.array([out[0][-1], out[1][-1]])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x.astype(np.int64)) for x in out]], names)

    local = stored(dealt.mapInArrow(run, "conv_id long, part int, depth long, chars long, a long, b long, la long, lb long"), "prefix-slices")
    ends = local.groupBy("conv_id", "part").agg(F.max_by(F.struct("la", "lb"), "depth").alias("end")).select(
        "conv_id", "part", F.col("end.la").cast("decimal(38,0)").alias("la"), F.col("end.lb").cast("decimal(38,0)").alias("lb"))
    before = _before(ends, "la", "lb").select("conv_id", "part", *[(F.col(c) % F.lit(1 << 61).cast("decimal(38,0)")).cast("long").alias(f"before_{c}") for c in ("la", "lb")])

    def whole(c: str) -> Column:
        return (F.col(f"l{c}") + F.coalesce(f"before_l{c}", F.lit(0))).bitwiseAND(_MASK)

    rows = local.join(before, ["conv_id", "part"], "left").select("conv_id", "depth", "chars", "a", "b", whole("a").alias("wa"), whole("b").alias("wb"))
    return stored(rows.select("conv_id", "depth", "chars", F.struct("wa", "wb").alias("node"), F.struct(
        *[(F.col(f"w{c}") - F.col(c)).bitwiseAND(_MASK).alias(f"w{c}") for c in ("a", "b")]).alias("parent")), "prefixes")


def contracted(nodes: DataFrame) -> DataFrame:
    """(node, leaves, saved): totals over the subtree of every node of nodes (node, parent, leaves, saved), a stored tree.

    leaves and saved are what each node adds itself; the root's parent is null. A round removes all leaves and, of
    chains, about a quarter of the nodes, so the rounds grow with the logarithm of the tree, not with its depth.
    """
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    now = stored(nodes.join(kids, "node", "left").select("node", "parent", "leaves", "saved", F.coalesce("kids", F.lit(0)).alias("kids")), "tree")
    done, spliced, turn = [], [], 0
    while not now.isEmpty():
        turn += 1
        leaves = now.where("kids = 0")
        done.append(leaves.select("node", "leaves", "saved"))
        raked = leaves.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("gone"))
        left = stored(now.where("kids > 0").join(raked, "node", "left").select(
            "node", "parent", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")],
            (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids")), "raked")
        # A unary node goes if its coin shows 0 and that of its parent, unary too, shows 1: no two neighbours go at once.
        coin = F.xxhash64("node", F.lit(turn)) % 2 == 0
        unary = left.where((F.col("kids") == 1) & F.col("parent").isNotNull())
        above = unary.where(~coin).select(F.col("node").alias("parent"))
        out = stored(unary.where(coin).join(above, "parent", "left_semi"), "spliced")
        if out.isEmpty():
            now = left
            continue
        # The only child of a node that goes moves up, and the parent takes over what the node adds.
        up = out.select(F.col("node").alias("parent"), F.col("parent").alias("upper"))
        moved = left.join(out.select("node"), "node", "left_anti").join(up, "parent", "left").select(
            "node", F.coalesce("upper", "parent").alias("parent"), F.when(F.col("upper").isNotNull(), F.col("parent")).alias("skipped"), "leaves", "saved", "kids")
        adds = out.select(F.col("parent").alias("node"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
        now = stored(moved.join(adds, "node", "left").select("node", "parent", "skipped", *[
            (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")], "kids"), "tree")
        links = now.where("skipped is not null").select(F.col("skipped").alias("node"), F.col("node").alias("child"))
        spliced.append(out.select("node", "leaves", "saved").join(links, "node"))
        now = now.drop("skipped")
    if not done:
        return nodes.select("node", "leaves", "saved")
    total = _union(done)
    if not spliced:
        return total
    # child: where a link goes on. Doubling ends when all links lead to raked nodes, whose totals are known.
    links = stored(_union(spliced), "links")
    while True:
        step = links.select(F.col("node").alias("child"), F.col("child").alias("next"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
        jumped = stored(links.join(step, "child", "left").select(
            "node", F.coalesce("next", "child").alias("child"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")],
            F.col("next").isNotNull().alias("moved")), "links")
        links = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    known = total.select(F.col("node").alias("child"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    return total.unionByName(links.join(known, "child").select("node", *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in ("leaves", "saved")]))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ends (node, conv_id): SHA-256 of the ascending ids, comma-joined.

    A digest takes its bytes in order, so the ids of a node are first joined to chunks by many tasks, then one task
    passes over the few chunks without holding them.
    """
    rows = ends.select("node", "conv_id")
    kind = rows.schema["node"].dataType.simpleString()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            out = []
            for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != node or len(ids) == IDS_CHUNK:
                    if ids:
                        out.append((node, ids[0], ",".join(map(str, ids))))
                    node, ids = at, []
                ids.append(conv)
            yield as_batch(out)
        if ids:
            yield as_batch([(node, ids[0], ",".join(map(str, ids)))])

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.struct([("wa", pa.int64()), ("wb", pa.int64())])), pa.array(columns[1], pa.int64()),
                                           pa.array(columns[2], pa.large_string()).cast(pa.string())], ["node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if at != node:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = at, hashlib.sha256(ids.as_py().encode())
                else:
                    state.update(b"," + ids.as_py().encode())
            yield done(out)
        if state:
            yield done([(node, state.hexdigest())])

    def done(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 2
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.struct([("wa", pa.int64()), ("wb", pa.int64())])), pa.array(columns[1], pa.string())],
                                          ["node", "ends_sha256"])

    n = tasks(ends.sparkSession)
    cut = rows.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(chunks, f"node {kind}, first long, ids string")
    joined = stored(cut, "end-chunks")
    return joined.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(digest, f"node {kind}, ends_sha256 string")


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A null role or text is empty; turns equal in number come by role, then text, so repeated rows are turns each. Rows
    without a conversation id belong to none and are left out; a negative id is cut towards zero to its century. A
    conversation left without turns is a member of the root. An empty table has no root and gives no rows; other
    columns are not read.
    """
    turns, ends = rebuilt(conversations, conv_col, turn_col, role_col, text_col)
    ends = stored(ends, "trie-ends")
    rows = prefixes(turns)
    root = F.struct(F.lit(0).cast("long").alias("wa"), F.lit(0).cast("long").alias("wb"))
    inner = rows.groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("chars").alias("chars"),
                                              F.first("parent").alias("parent"))
    top = ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        root.alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"), F.lit(None).cast("struct<wa:long,wb:long>").alias("parent"))
    nodes = stored(inner.unionByName(top, allowMissingColumns=False), "nodes")
    kids = stored(nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    full = stored(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    totals = contracted(full.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("leaves"),
                                    ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")))
    last = ends.where("depth > 0").join(rows.select("conv_id", "depth", "node"), ["conv_id", "depth"]).select("node", "conv_id").unionByName(
        ends.where("depth = 0").select(root.alias("node"), "conv_id"))
    named = full.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")).join(kids.select(F.col("node").alias("parent")), "parent", "left_semi")
    return full.join(totals, "node").join(end_digests(last), "node", "left").join(named, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
