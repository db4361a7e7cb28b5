"""Language of words and texts by a linear-chain conditional random field.

Each word has affix, character n-gram and lexicon features; transitions between the labels of neighbouring words are
learned with the feature weights, on sequences spliced from labelled documents so that the language changes within
them. Forward-backward gives every word its label probabilities; a text takes the label with the largest sum of them.

A long text is cut into blocks. The transfer matrix of each block joins them, so the probabilities are those of the
whole chain while no loop is longer than a block.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import sampled

UNKNOWN = "und"
FEATURES = 1 << 16
DOCS_PER_LANGUAGE = 300   # training sample: so many whole labelled documents of each language,
SAMPLE_CHARS = 20_000     # none longer than this,
LANGUAGES = 64            # and of so many languages, the most frequent ones
CERTAINTY = 0.3           # least mean over a kept text's words of the best label's probability
LEXICON = 2000            # most frequent words of each language in the sample
SEQUENCE, SPLICE = 120, (5, 40)
ROUNDS, RATE, DECAY = 60, 0.15, 1e-4
BLOCK = 1024              # words that one loop of forward-backward covers
BATCH = 500               # texts labelled together
REMEMBERED = 300_000      # word types whose scores a task keeps
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words of letters; a text without any letter has none."""
    found = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for w in ("".join(filter(str.isalpha, w)) for w in found) if w]


def features_of(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    """Hashed features: prefixes and suffixes, inner n-grams, membership in the lexicon of each language."""
    whole = f"^{word}$"
    names = [whole[:n] for n in (2, 3, 4)] + [whole[-n:] for n in (2, 3, 4)]
    names += [f"_{whole[i:i + n]}" for n in (2, 3) for i in range(len(whole) - n + 1)]
    names += [f"lexicon {k}" for k in lexicon.get(word, ())] or ["no lexicon"]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % FEATURES for n in names]


@dataclass
class Model:
    """weights: a row of scores by label for each feature; trans: score of (from, to); first: of the first label."""
    labels: list[str]
    lexicon: dict[str, tuple[int, ...]]
    weights: np.ndarray
    trans: np.ndarray
    first: np.ndarray
    memory: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memory", "scores")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, memory={}, scores=np.empty((0, len(state["labels"])), np.float32))

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of self.scores, which hold exp(score) by label, for the words of each text."""
        if len(self.memory) > REMEMBERED:
            self.__setstate__(self.__getstate__())
        new = list(set().union(*texts).difference(self.memory))
        if new:
            rows = emissions(self.weights, *indexed(new, self.lexicon))
            known = len(self.memory)
            self.memory.update(zip(new, range(known, known + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, np.exp(rows - rows.max(axis=1, keepdims=True)).astype(np.float32)])
        return [np.fromiter(map(self.memory.__getitem__, t), np.int64, len(t)) for t in texts]


def indexed(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words, where each word's begin)."""
    each = [features_of(w, lexicon) for w in words]
    starts = np.cumsum([0] + [len(f) for f in each[:-1]])
    return np.array([f for one in each for f in one], np.int64), starts


def emissions(weights: np.ndarray, feats: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[feats], starts, axis=0)


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Order of sequences by falling length, and for each step how many of them are that long."""
    order = np.argsort(-lengths, kind="stable")
    return order, np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max()) + 1), side="right").tolist()


def _run(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, inward: np.ndarray, outward: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Label probabilities of all words of the sequences, given what comes in from the left and from the right."""
    order, active = _steps(lengths)
    at, n = starts[order], lengths[order]
    out = np.empty_like(emit)
    state = inward[order]
    for t, k in enumerate(active):
        state = state[:k] * emit[at[:k] + t] if t == 0 else (state[:k] @ trans) * emit[at[:k] + t]
        state /= state.sum(axis=1, keepdims=True)
        out[at[:k] + t] = state
    back = outward[order].copy()
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        inner = n[:k] - 1 > t  # the others end here and keep what came in from the right
        if inner.any():
            rows = np.flatnonzero(inner)
            message = (back[rows] * emit[at[rows] + t + 1]) @ trans.T
            back[rows] = message / message.sum(axis=1, keepdims=True)
        out[at[:k] + t] *= back[:k]
    return out / out.sum(axis=1, keepdims=True)


def _transfers(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The matrix of each sequence from its first label's prior to its last label, up to a factor."""
    order, active = _steps(lengths)
    at, size = starts[order], trans.shape[0]
    matrix = np.broadcast_to(np.eye(size, dtype=emit.dtype), (len(starts), size, size)).copy()
    for t, k in enumerate(active):
        matrix[:k] = (matrix[:k] if t == 0 else matrix[:k] @ trans) * emit[at[:k] + t][:, None, :]
        matrix[:k] /= matrix[:k].max(axis=(1, 2), keepdims=True)
    out = np.empty_like(matrix)
    out[order] = matrix
    return out


def posteriors(emit: np.ndarray, lengths: np.ndarray, first: np.ndarray, trans: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Forward-backward over sequences laid end to end; all scores as exponentials. lengths are at least 1."""
    blocks = -(-lengths // block)
    owner = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begins = np.repeat(np.cumsum(lengths) - lengths, blocks) + nth * block
    sizes = np.minimum(block, lengths[owner] - nth * block)
    inward = np.broadcast_to(first, (len(owner), len(first))).astype(emit.dtype)
    outward = np.ones_like(inward)
    long = np.flatnonzero(blocks[owner] > 1)
    if len(long):
        matrix = np.empty((len(owner), len(first), len(first)), emit.dtype)
        matrix[long] = _transfers(emit, begins[long], sizes[long], trans)
        last = blocks[owner] - 1
        for k in range(1, int(blocks.max())):  # what enters a block from the left is the prior of its first label
            rows = long[nth[long] == k]
            state = (inward[rows - 1][:, None, :] @ matrix[rows - 1])[:, 0, :] @ trans
            inward[rows] = state / state.sum(axis=1, keepdims=True)
        for k in range(1, int(blocks.max())):  # and from the right, counted from the last block
            rows = long[last[long] - nth[long] == k]
            state = (matrix[rows + 1] @ outward[rows + 1][:, :, None])[:, :, 0] @ trans.T
            outward[rows] = state / state.sum(axis=1, keepdims=True)
    return _run(emit, begins, sizes, inward, outward, trans)


def _spliced(docs: list[tuple[int, list[str]]], seed: int = 1) -> list[tuple[list[str], list[int]]]:
    """Sequences of up to SEQUENCE words made of pieces of shuffled documents; every piece is used once."""
    rng = np.random.default_rng(seed)
    parts = []
    for label, found in docs:
        at = 0
        while at < len(found):
            n = int(rng.integers(*SPLICE))
            parts.append((label, found[at:at + n]))
            at += n
    sequences, now, tags = [], [], []
    for i in rng.permutation(len(parts)):
        label, part = parts[i]
        now, tags = now + part, tags + [label] * len(part)
        if len(now) >= SEQUENCE:
            sequences.append((now, tags))
            now, tags = [], []
    return sequences + ([(now, tags)] if now else [])


def train(sample: list[tuple[str, list[str]]]) -> Model:
    """Fits the field to (language, words) by Adam on the exact gradient of the whole sample."""
    labels = sorted({lang for lang, _ in sample})
    counts = [Counter(w for lang, found in sample if lang == label for w in found) for label in labels]
    lexicon: dict[str, tuple[int, ...]] = {}
    for k, count in enumerate(counts):
        for w in sorted(count, key=lambda w: (-count[w], w))[:LEXICON]:
            if count[w] > 1:
                lexicon[w] = (*lexicon.get(w, ()), k)
    size = len(labels)
    weights, trans, first = np.zeros((FEATURES, size)), np.zeros((size, size)), np.zeros(size)
    sequences = _spliced([(labels.index(lang), found) for lang, found in sample])
    if sequences:
        types = sorted({w for found, _ in sequences for w in found})
        place = {w: i for i, w in enumerate(types)}
        feats, starts = indexed(types, lexicon)
        owner = np.repeat(np.arange(len(types)), np.diff(np.append(starts, len(feats))))
        ids = np.array([place[w] for found, _ in sequences for w in found])
        gold = np.array([t for _, tags in sequences for t in tags])
        lengths = np.array([len(found) for found, _ in sequences])
        begins = np.cumsum(lengths) - lengths
        inner = np.setdiff1d(np.arange(len(ids)), begins)
        seen = np.zeros((size, size))
        np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
        parts = [weights, trans, first]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
        for step in range(1, ROUNDS + 1):
            scores = emissions(weights, feats, starts)
            emit = np.exp(scores - scores.max(axis=1, keepdims=True))[ids]
            post = posteriors(emit, lengths, np.exp(first), np.exp(trans))
            # Expected transitions: the joint of neighbours, from the left word's probabilities without its future.
            ahead = _forward(emit, lengths, np.exp(first), np.exp(trans))
            back = post[inner] / np.maximum(ahead[inner - 1] @ np.exp(trans), 1e-30)
            expected = (ahead[inner - 1].T @ back) * np.exp(trans)
            miss = post.copy()
            miss[np.arange(len(ids)), gold] -= 1
            by_type = np.stack([np.bincount(ids, miss[:, k], len(types)) for k in range(size)], axis=1)
            slopes = [np.stack([np.bincount(feats, by_type[owner, k], FEATURES) for k in range(size)], axis=1) / len(ids) + DECAY * weights,
                      (expected - seen) / len(ids) + DECAY * trans, miss[begins].sum(axis=0) / len(ids) + DECAY * first]
            for part, slope, (m, v) in zip(parts, slopes, moments, strict=True):
                m += 0.1 * (slope - m)
                v += 0.01 * (slope ** 2 - v)
                part -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    model = Model(labels, lexicon, weights.astype(np.float32), trans, first)
    model.__setstate__(model.__getstate__())
    return model


def _forward(emit: np.ndarray, lengths: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Label probabilities of each word given the words up to it."""
    order, active = _steps(lengths)
    at = (np.cumsum(lengths) - lengths)[order]
    out = np.empty_like(emit)
    state = np.broadcast_to(first, (len(lengths), len(first)))
    for t, k in enumerate(active):
        state = (state[:k] if t == 0 else state[:k] @ trans) * emit[at[:k] + t]
        state = state / state.sum(axis=1, keepdims=True)
        out[at[:k] + t] = state
    return out


def label_words(model: Model, texts: list[list[str]]) -> list[np.ndarray]:
    """Label probabilities of the words of each text."""
    filled = [t for t in texts if t]
    if not filled or not model.labels:
        return [np.zeros((len(t), len(model.labels))) for t in texts]
    ids = model.ids(filled)
    lengths = np.array([len(i) for i in ids])
    post = posteriors(model.scores[np.concatenate(ids)], lengths, np.exp(model.first).astype(np.float32), np.exp(model.trans).astype(np.float32))
    each = iter(np.split(post, np.cumsum(lengths)[:-1]))
    return [next(each) if t else np.zeros((0, len(model.labels))) for t in texts]


def languages(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; the score is the mean probability of its label over the words."""
    found = [words_of(t) for t in texts]
    names, scores = [], []
    for post in label_words(model, found):
        mean = post.mean(axis=0) if post.size else np.zeros(0)
        best = int(mean.argmax()) if mean.size else -1
        names.append(model.labels[best] if best >= 0 else UNKNOWN)
        scores.append(float(min(1.0, mean[best])) if best >= 0 else 0.0)
    return names, scores


def remainder(id_col: Column, divisor: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % divisor


def learnable(id_col: str, folds: int = 5) -> Column:
    """Whether a row may be learned from: those with a null id or in fold 0 may not."""
    return (remainder(F.col(id_col), folds) != 0) & F.col(id_col).isNotNull()


def training_sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, list[str]]]:
    """(language, words) of at most DOCS_PER_LANGUAGE whole documents of each language, which the driver gets.

    They are the rows with the lowest hashes of id and text, so neither partitions nor shared ids change the sample.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(
        learn & F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    found = [(r.lang, r.place, words_of(r.text)) for r in sampled(rows, "lang", DOCS_PER_LANGUAGE, LANGUAGES).select("lang", "place", "text").collect()]
    return [(lang, words) for lang, _, words in sorted(found) if words]


def trigrams(word: str) -> list[str]:
    whole = f"^{word}$"
    return [whole[i:i + 3] for i in range(len(whole) - 2)]


class Outside:
    """Tells text of no learned language by the share of its letter trigrams that the training words have.

    A word's share is that of its trigrams seen in at least two training documents; a text's is the mean over its words.
    `least` is a part of what the lower tail of training documents reaches that are judged by the others' trigrams.
    """

    def __init__(self, sample: list[tuple[str, list[str]]], part: float = 0.7, tail: float = 0.01) -> None:
        halves: list[Counter[str]] = [Counter(), Counter()]
        for i, (_, found) in enumerate(sample):
            halves[i % 2].update({g for w in set(found) for g in trigrams(w)})
        shares = []
        for k, half in enumerate(halves):
            self.seen, self.memory = frozenset(g for g, n in half.items() if n > 1), {}
            shares += [self.share(found) for _, found in sample[1 - k::2]]
        both = halves[0] + halves[1]
        self.seen, self.memory = frozenset(g for g, n in both.items() if n > 1), {}
        self.least = part * float(np.quantile(shares, tail)) if len(sample) > 20 else 0.0

    def shares(self, found: list[str]) -> np.ndarray:
        """The share of each word."""
        if len(self.memory) > REMEMBERED:
            self.memory = {}
        for w in set(found).difference(self.memory):
            grams = trigrams(w)
            self.memory[w] = sum(g in self.seen for g in grams) / len(grams)
        return np.fromiter(map(self.memory.__getitem__, found), float, len(found))

    def share(self, found: list[str]) -> float:
        return float(self.shares(found).mean()) if found else 0.0


def accepted(model: Model, outside: Outside, texts: list[str | None]) -> list[bool]:
    """Whether each text has words, words like those learned from, and labels that the field is not wholly unsure of."""
    found = [words_of(t) for t in texts]
    return [post.size > 0 and float(post.max(axis=1).mean()) >= CERTAINTY and outside.share(words) >= outside.least
            for words, post in zip(found, label_words(model, found), strict=True)]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Learns from rows with a language whose crc32 of the id, modulo folds, is not 0; nothing but the text enters a
    prediction. A text that is null or has no letter is `und` with score 0, as is every text if no row has a
    language. A null id counts as the empty string for the fold. An empty table gives no rows.
    """
    model = train(training_sample(docs, learnable(id_col, folds), id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), (remainder(F.col(id_col), folds) == 0).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                names, scores = languages(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows whose text is in no learned language: null, letterless, of another script or of no words.

    The field must choose a learned language for every word and cannot say that it is none. So a text stays if the mean
    certainty of its labels, in whatever mixture of languages, reaches CERTAINTY, and if its words' trigrams are those of
    the training words as far as `Outside` asks. Each row is judged by its own text, in the pass that carries the whole row, so equal or null
    ids do not matter. With fewer than 21 training documents only texts without a word go; where nothing can be learned
    from, every text goes. An empty table gives no rows.
    """
    sample = training_sample(docs, learnable(id_col), id_col, text_col, lang_col)
    model, outside = train(sample), Outside(sample)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                yield part.filter(pa.array(accepted(model, outside, part.column(at_text).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
