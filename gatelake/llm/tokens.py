"""Token ids of whole texts, as the tokenizers library gives them, computed in batches inside Spark tasks."""
from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE = "byte_bpe_50k.json"
BYTE_BPE_RANKS = "byte_bpe_50k.tiktoken"
#: The pre-token pattern of the vocabulary, in the form whose possessive parts need no backtracking.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=1)
def _fast() -> tiktoken.Encoding:
    with open(public_tokenizers.path(BYTE_BPE_RANKS), "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(BYTE_BPE, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@lru_cache(maxsize=1)
def _library() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))


def library_ids(text: str) -> np.ndarray:
    """Ids by the tokenizers library itself."""
    return np.array(_library().encode(text, add_special_tokens=False).ids, np.uint32)


def byte_bpe_ids(text: str | None) -> np.ndarray:
    """The same ids by a faster implementation of the same vocabulary; special strings inside a text are special tokens.

    The tests hold both against each other for every code point. A text that the fast one refuses (a pre-token too
    long for its pattern engine) goes through the library.
    """
    if not text:
        return np.empty(0, np.uint32)
    try:
        return _fast().encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
    except (KeyboardInterrupt, SystemExit, MemoryError):
        raise
    except BaseException:  # its errors are panics, which are no Exception
        return library_ids(text)
