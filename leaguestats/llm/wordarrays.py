"""Texts as arrays of word codes, in Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def gathered(batches: Iterable[pa.RecordBatch], most_bytes: int = 3 << 20) -> Iterator[pa.Table]:
    """Consecutive batches put together up to ``most_bytes``; a larger batch is alone.

    What Arrow has freed goes back to the system in between: an executor's workers share its memory.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.nbytes > most_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
            pa.default_memory_pool().release_unused()
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def one_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if not isinstance(column, pa.ChunkedArray):
        return column
    if column.num_chunks == 1:
        return column.chunk(0)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


class Words:
    """The words of some texts: ``codes`` into ``names``, text ``i`` from ``starts[i]`` to ``starts[i + 1]``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a NULL
    text has none.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        empty = coded.dictionary.index("").as_py()
        if empty >= 0:  # white space at the ends of a text
            real = codes != empty
            ends = np.concatenate(([0], np.cumsum(real)))[ends]
            codes = codes[real]
        self.codes, self.starts, self.names = codes, ends, coded.dictionary

    @cached_property
    def hashes(self) -> np.ndarray:
        """64-bit hashes of ``names``, the same in every process."""
        return word_hashes(self.names)


def word_hashes(names: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names.to_numpy(zero_copy_only=False)), np.uint64, len(names))


def mix(numbers: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = numbers.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def unmix(numbers: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""

    def unshift(x: np.ndarray, by: int) -> np.ndarray:
        return x ^ (x >> np.uint64(by)) ^ (x >> np.uint64(2 * by))

    with np.errstate(over="ignore"):
        x = unshift(numbers.astype(np.uint64), 31) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
        x = unshift(x, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
        return unshift(x, 30)


def chained(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each ``length`` consecutive hashes; shorter input gives none."""
    size = max(0, len(hashes) - length + 1)
    made = mix(hashes[:size])
    with np.errstate(over="ignore"):
        for k in range(1, length):
            made = mix(made * np.uint64(31) + hashes[k : size + k])
    return made
