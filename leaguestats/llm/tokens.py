"""Token ids of a public byte-level BPE vocabulary, in Python workers."""

from __future__ import annotations

import base64
import ctypes
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(string, id) of the tokens that a tokenizer's JSON file adds to its vocabulary and finds in texts."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens", [])
    loose = [t["content"] for t in added if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if loose:
        raise ValueError(f"tokens that take in their surroundings are not supported: {loose}")
    return tuple((t["content"], t["id"]) for t in added)


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str, specials: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    """The encoder of a vocabulary file of ranks; a worker loads it once.

    The strings of ``specials`` in a text become their ids; without them, as any
    other text, its tokens.
    """
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if max([*ranks.values(), *dict(specials).values()]) >= 1 << 16:
        raise ValueError("a vocabulary of at most 65,536 ids is needed")
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))


def encode(bpe: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a whole text as little-endian 16-bit numbers."""
    if any(special in text for special in bpe.special_tokens_set):
        return np.array(bpe.encode(text, allowed_special="all"), "<u2")
    return np.array(bpe.encode_ordinary(text), "<u2")


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that gives freed memory back to the system; None where there is none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Give memory that is free again back to the system: an executor's workers and stages share its memory."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def small_batches(texts: list[str], most_chars: int = 1_000_000, most: int = 2_000) -> Iterator[tuple[int, int]]:
    """Index ranges over ``texts`` whose sizes are bounded; a longer text is alone.

    What the last range left free is given back before the worker goes on.
    """
    start = chars = 0
    for i, text in enumerate(texts):
        if i > start and (chars + len(text) > most_chars or i - start >= most):
            yield start, i
            give_back()
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)
        give_back()
