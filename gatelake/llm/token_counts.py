"""Token counts with a whole-token shortcut.

No piece of the vocabulary holds a space after another character, so merges never cross from one pre-token (spaces,
then other characters up to the next space) into the next. A pre-token that is known to encode alone as one token
counts as one; every other distinct pre-token is merged once and remembered. Which vocabulary strings encode alone is
proven by encoding each of them, before any text is read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Pre-tokens remembered by a task; when full, the memory starts anew.
REMEMBERED = 400_000
SPACE = "▁"
_PRE_TOKEN = re.compile(f"{SPACE}+[^{SPACE}]*")


@lru_cache(maxsize=2)
def model(name: str = MODEL) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))


def whole_tokens(name: str = MODEL) -> frozenset[str]:
    """Vocabulary strings that start with a space and encode alone as one token, without that space.

    Raises if a piece holds a space after another character, or if the model changes text before it merges: the
    counts by pre-token would then be wrong.
    """
    sp = model(name)
    pieces = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    crossing = [p for _, p in pieces if SPACE in p.lstrip(SPACE)]
    probe = "  Åﬁ ①Å\t\n x  "
    if crossing or sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError(f"{name} does not split at spaces: {crossing[:3]}")
    own = [(i, p) for i, p in pieces if p.startswith(SPACE)]
    bare = [p[1:].replace(SPACE, " ") for _, p in own]
    return frozenset(b for b, (i, _), ids in zip(bare, own, sp.encode(bare, num_threads=1), strict=True) if ids == [i])


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space: encoding one of these puts that space in front again."""
    if not text:
        return []
    found = text.split(" ")
    if "" in found or SPACE in text:  # runs of spaces, spaces at an end, or the visible sign itself
        found = [p[1:].replace(SPACE, " ") for p in _PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE))]
    return found


class Counts:
    """Token numbers of pre-tokens, for one task."""

    def __init__(self, shortcut: frozenset[str], name: str = MODEL) -> None:
        self.shortcut, self.sp, self.memory = shortcut, model(name), {}

    def tokens(self, texts: list[str]) -> list[int]:
        """Tokens of every text. Pre-tokens outside the shortcut and not yet known are merged in one call."""
        if not 0 < len(self.memory) < REMEMBERED:
            self.memory = dict.fromkeys(self.shortcut, 1)
            # A lone space comes back from the empty string as no token at all.
            self.memory[""] = len(self.sp.encode("a ")) - len(self.sp.encode("a"))
        found = [pre_tokens(t) for t in texts]
        new = list(set().union(*found).difference(self.memory))
        if new:
            self.memory.update(zip(new, map(len, self.sp.encode(new, num_threads=1)), strict=True))
        return [sum(map(self.memory.__getitem__, one)) for one in found]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, name: str = MODEL) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens).

    No begin, end or added special tokens; strings of control pieces inside a text are ordinary text. A null text
    counts as empty and has no token. Ids may be null or repeat; an empty table gives no rows.
    """
    shortcut = whole_tokens(name)  # at most the vocabulary, about half a megabyte
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(shortcut, name)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens = pa.array(counts.tokens(texts), pa.int64())
                size = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, tokens], ["doc_id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
