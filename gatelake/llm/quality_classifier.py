"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded: averaged learned vectors of its hashed words and a few
measures of its form, through a learned layer. Gated attention, learned from document labels
alone, weighs the passages; the weighted representation is scored. All parts are trained together by gradient steps.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import sampled
from .language_id import remainder

PASSAGE = 64              # words in a passage
BUCKETS = 4096            # hashed words
SAMPLE_PER_LABEL = 1200   # whole labelled documents of each class that are learned from,
SAMPLE_CHARS = 20_000     # none longer than this
EMBED, HIDDEN, GATE = 16, 16, 8
ROUNDS, RATE, DECAY = 120, 0.02, 1e-3
THRESHOLD = 0.7
REMEMBERED = 300_000      # word types a task remembers
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MEASURES = 8
SHARES = 10


def word_row(word: str) -> tuple[int, ...]:
    """Bucket of a word's letters and numbers that the measures of its passage are sums of."""
    letters = sum(map(str.isalpha, word))
    upper = sum(map(str.isupper, word))
    marks = len(word) - letters - sum(map(str.isdigit, word))
    bare = "".join(filter(str.isalnum, word)).lower()
    return (zlib.crc32(bare.encode()) % BUCKETS, len(word), letters, upper, marks, int(not letters), int(upper > 1 and upper == letters),
            int(marks > 1))


class Encoder:
    """Passages of texts as rows of word buckets and measures; remembers word types."""

    def __init__(self) -> None:
        self.memory: dict[str, int] = {}
        self.rows = np.empty((0, _MEASURES), np.int32)

    def words(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text the row of every word: bucket, then counts."""
        if len(self.memory) > REMEMBERED:
            self.__init__()
        new = list(set().union(*texts).difference(self.memory))
        if new:
            known = len(self.memory)
            self.memory.update(zip(new, range(known, known + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, np.array([word_row(w) for w in new], np.int32)])
        return [self.rows[np.fromiter(map(self.memory.__getitem__, t), np.int64, len(t))] for t in texts]


@dataclass
class Bags:
    """Words of all passages end to end; where passages begin, and how many each text has (one at least)."""
    buckets: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    measures: np.ndarray
    owner: np.ndarray
    n_texts: int


def passages_of(texts: list[str | None], encoder: Encoder) -> Bags:
    """The passages of whole texts, PASSAGE words each, the last one shorter.

    A text without words has one passage without words. The measures of a passage are shares: letters, capitals and
    signs of its characters; words without letters, in capitals, with several signs, seen before in the passage and
    equal to the one before; word length and fullness.
    """
    found = [_WORD.findall(t or "") for t in texts]
    rows = encoder.words(found)
    counts = np.array([max(1, -(-len(f) // PASSAGE)) for f in found])
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    sizes = np.clip(np.array([len(f) for f in found])[owner] - nth * PASSAGE, 0, PASSAGE)
    starts = np.cumsum(sizes) - sizes
    words = np.concatenate(rows) if rows else np.empty((0, _MEASURES), np.int32)
    # One row of zeros at the end, so that a passage without words can be summed like the others.
    padded = np.concatenate([words, np.zeros((1, _MEASURES), np.int32)])
    place = np.repeat(np.arange(len(owner)), sizes)
    sums = np.stack([np.bincount(place, words[:, k], len(owner)) for k in range(1, _MEASURES)], axis=1) if len(owner) else np.zeros((0, 7))
    repeats, runs = np.zeros(len(owner)), np.zeros(len(owner))
    if len(words):
        same = (words[1:, 0] == words[:-1, 0]) & (place[1:] == place[:-1])
        runs = np.bincount(place[1:][same], minlength=len(owner))
        key = np.unique(place * BUCKETS + words[:, 0])
        repeats = sizes - np.bincount(key // BUCKETS, minlength=len(owner))
    chars, n = np.maximum(sums[:, 0], 1), np.maximum(sizes, 1)
    measures = np.stack([sums[:, 1] / chars, sums[:, 2] / chars, sums[:, 3] / chars, sums[:, 4] / n, sums[:, 5] / n, sums[:, 6] / n,
                         repeats / n, runs / n, np.minimum(sums[:, 0] / n / 10, 3), np.minimum(sizes / PASSAGE, 1)], axis=1) if len(owner) else np.zeros((0, SHARES))
    return Bags(padded[:, 0], starts, sizes, measures, owner, len(texts))


@dataclass
class Model:
    """words: vector of each bucket; mix, bias: the layer that encodes a passage; V, U, w: gated attention; o, b: score."""
    parts: dict[str, np.ndarray]

    def run(self, bags: Bags) -> dict[str, np.ndarray]:
        p = self.parts
        vectors = p["words"][bags.buckets]
        vectors[-1] = 0  # the row that ends the last passage is no word
        total = np.add.reduceat(vectors, np.minimum(bags.starts, len(bags.buckets) - 1), axis=0)
        total = np.where(bags.sizes[:, None] > 0, total, 0)
        means = total / np.maximum(bags.sizes, 1)[:, None]
        x = np.concatenate([means, bags.measures], axis=1)
        h = np.tanh(x @ p["mix"] + p["bias"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        raw = (v * u) @ p["w"]
        top = np.full(bags.n_texts, -np.inf)
        np.maximum.at(top, bags.owner, raw)
        e = np.exp(raw - top[bags.owner])
        a = e / np.bincount(bags.owner, e, bags.n_texts)[bags.owner]
        z = np.stack([np.bincount(bags.owner, a * h[:, k], bags.n_texts) for k in range(h.shape[1])], axis=1)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["b"], -30, 30)))}

    def slopes(self, bags: Bags, truth: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the weighted log loss."""
        p, r = self.parts, self.run(bags)
        miss = (r["score"] - truth) * weight
        dz = miss[:, None] * p["o"]
        along = (dz[bags.owner] * r["h"]).sum(axis=1)
        draw = r["a"] * (along - np.bincount(bags.owner, r["a"] * along, bags.n_texts)[bags.owner])
        gate = r["v"] * r["u"]
        dv, du = draw[:, None] * p["w"] * r["u"] * (1 - r["v"] ** 2), draw[:, None] * p["w"] * r["v"] * r["u"] * (1 - r["u"])
        dh = r["a"][:, None] * dz[bags.owner] + dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - r["h"] ** 2)
        dmean = (dx @ p["mix"].T)[:, :EMBED] / np.maximum(bags.sizes, 1)[:, None]
        place = np.repeat(np.arange(len(bags.owner)), bags.sizes)
        words = bags.buckets[:-1]
        dwords = np.stack([np.bincount(words, dmean[place, k], BUCKETS) for k in range(EMBED)], axis=1)
        return {"words": dwords, "mix": r["x"].T @ dx, "bias": dx.sum(axis=0), "V": r["h"].T @ dv, "U": r["h"].T @ du,
                "w": gate.T @ draw, "o": r["z"].T @ miss, "b": np.array(miss.sum())}


def train(texts: list[str], truth: list[int], seed: int = 1) -> Model:
    """Learns all parts together by Adam over the whole sample; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    inputs = EMBED + SHARES
    shapes = {"words": (BUCKETS, EMBED), "mix": (inputs, HIDDEN), "bias": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE),
              "w": (GATE,), "o": (HIDDEN,), "b": ()}
    model = Model({k: rng.normal(0, 0.1 if k == "words" else 0.3, s) if k not in ("bias", "b") else np.zeros(s) for k, s in shapes.items()})
    y = np.array(truth, float)
    if not len(y):
        return model
    bags = passages_of(texts, Encoder())
    share = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = np.where(y == 1, 1 / max(1, share[1]), 1 / max(1, share[0])) / 2
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for step in range(1, ROUNDS + 1):
        for k, slope in model.slopes(bags, y, weight).items():
            slope = slope + DECAY * model.parts[k]
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope ** 2
            model.parts[k] = model.parts[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, folds: int, held: int, id_col: str, text_col: str, label_col: str) -> list[tuple[str, int]]:
    """(text, label) of at most SAMPLE_PER_LABEL whole documents of each class outside the held-out fold.

    The ids are those of lowest hash among the labelled ones; of ids with several labels the largest counts, and of ids
    with several texts the text of lowest hash. The driver gets one text for each chosen id at most.
    """
    label = F.col(label_col).cast("int")
    rows = labels.where(label.isin(0, 1) & F.col(id_col).isNotNull() & (remainder(F.col(id_col), folds) != held)).groupBy(
        F.col(id_col).alias("doc_id")).agg(F.max(label).alias("label"))
    chosen = sampled(rows.withColumn("text", F.lit("")), "label", SAMPLE_PER_LABEL, 2).select("doc_id", "label", "place")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    order = F.struct(F.xxhash64("text"), "text")
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("label", "place", "doc_id").agg(F.min_by("text", order).alias("text")).collect()
    return [(r.text, r.label) for r in sorted(found, key=lambda r: (r.label, r.place, r.doc_id))]


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = THRESHOLD, id_col: str = "doc_id",
            text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold).

    Learns only from labelled rows whose crc32 of the id, modulo folds, is not `held`; a score depends on the text
    alone. Null and empty texts are scored as one passage without words. Labels other than 0 and 1 are not learned
    from; without labels every score is that of the untrained model. An empty table gives no rows.
    """
    sample = training_sample(docs, labels, folds, held, id_col, text_col, label_col)
    model = train([t for t, _ in sample], [y for _, y in sample])
    rows = docs.select(F.col(id_col).alias("doc_id"), (remainder(F.col(id_col), folds) == held).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = model.run(passages_of(part.column(2).to_pylist(), encoder))["score"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
