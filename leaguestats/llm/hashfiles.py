"""Sorted arrays in the shared folder, written by tasks and memory-mapped by workers.

An array is dealt into ``2 ** bits`` parts by the top bits of its 64-bit keys; a
part is a file.  Keys are hashes, so parts are even.  A task writes a part under a
name of its own and renames it at the end: a task that runs twice, or is lost,
leaves one whole file.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs

# What tasks exchange: sorted keys of one part with their counts, packed; and what storing a part returns.
PIECE = "part int, keys binary, counts binary"
SIZED = "part int, size long, n1 long, n2 long, n3 long, n4 long, total long"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write one part, whole or not at all."""
    system, base = _place(folder)
    system.create_dir(base, recursive=True)
    own = f"{base}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        np.save(out, array)
    system.move(own, f"{base}/{name}.npy")


def load(folder: str, name: str) -> np.ndarray:
    """A part as a memory map.

    Files of a mounted folder are mapped where they are.  Of other stores the
    worker keeps a read-only copy beside the files Spark ships to its executor.
    """
    system, base = _place(folder)
    path = f"{base}/{name}.npy"
    if not isinstance(system, fs.LocalFileSystem):
        from pyspark import SparkFiles

        copy = os.path.join(SparkFiles.getRootDirectory(), hashlib.sha256(path.encode()).hexdigest())
        if not os.path.exists(copy):
            own = f"{copy}.{uuid.uuid4().hex}"
            fs.copy_files(path, own, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
            os.replace(own, copy)
        path = copy
    return np.load(path, mmap_mode="r")


def part_slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) over sorted keys."""
    parts = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(parts)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(keys)]):
        if end > start:
            yield int(parts[start]), int(start), int(end)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, high bytes apart from low ones, compressed."""
    planes = np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def packed_sorted(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts (a column or several)."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first, axis=0)


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def pieces(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted keys with counts as ``PIECE``, one row a part."""
    rows = [(p, packed_sorted(keys[a:b]), packed(counts[a:b])) for p, a, b in part_slices(keys, bits)]
    columns = [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)]]
    return pa.RecordBatch.from_arrays(columns, ["part", "keys", "counts"])


def small_counts(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def merging(folder: str, name: str) -> Callable[[pa.Table], pa.Table]:
    """For the pieces of one part: merge them and store keys and counts; returns ``SIZED``."""

    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked_sorted(x) for x in table["keys"].to_pylist()])
        keys, counts = summed(keys, np.concatenate([unpacked(x) for x in table["counts"].to_pylist()]))
        part = table["part"][0].as_py()
        save(folder, f"{name}-{part}", keys)
        save(folder, f"{name}_n-{part}", counts.astype(np.uint32 if len(counts) and counts.max() < 1 << 32 else np.int64))
        row = [part, len(keys), *small_counts(counts), int(counts.sum())]
        return pa.Table.from_pylist([dict(zip(("part", "size", "n1", "n2", "n3", "n4", "total"), row))], arrow_schema(SIZED))

    return merge


def part_bits(rows: int, most: int = 1 << 21) -> int:
    """The top bits that name a part, for parts of at most about ``most`` rows; 2**14 parts at most."""
    return min(14, max(0, (max(rows, 1) - 1).bit_length() - (most.bit_length() - 1)))


def part_sizes(rows: Iterable, bits: int) -> tuple[int, ...]:
    """Sizes of all parts from the ``SIZED`` rows of those that are not empty."""
    sizes = {r.part: r.size for r in rows}
    return tuple(sizes.get(p, 0) for p in range(1 << bits))


class SortedParts:
    """The parts of one sorted array of keys and the columns beside it."""

    def __init__(self, folder: str, keys: str, columns: tuple[str, ...], sizes: tuple[int, ...]):
        self.folder, self.names, self.sizes = folder, (keys, *columns), sizes
        self.bits = max(0, len(sizes).bit_length() - 1)
        self.bases = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self._maps: dict[tuple[str, int], np.ndarray] = {}

    def _part(self, name: str, part: int) -> np.ndarray:
        if (name, part) not in self._maps:
            self._maps[name, part] = load(self.folder, f"{name}-{part}")
        return self._maps[name, part]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the whole array, -1 where it is absent."""
        order = np.argsort(keys, kind="stable")
        wanted = keys[order]
        found = np.full(len(keys), -1, np.int64)
        for part, start, end in part_slices(wanted, self.bits):
            if self.sizes[part]:
                held = self._part(self.names[0], part)
                at = np.minimum(np.searchsorted(held, wanted[start:end]), len(held) - 1)
                found[start:end] = np.where(held[at] == wanted[start:end], self.bases[part] + at, -1)
        places = np.empty_like(found)
        places[order] = found
        return places

    def take(self, name: str, places: np.ndarray) -> np.ndarray:
        """Values of a column at places; 0 where the place is -1."""
        order = np.argsort(places, kind="stable")
        wanted = places[order]
        values: np.ndarray | None = None  # whole numbers, as wide as they come
        known = np.searchsorted(wanted, 0)
        cuts = np.maximum(np.searchsorted(wanted, self.bases), known)
        for part in np.flatnonzero(np.diff(cuts)):
            start, end = cuts[part], cuts[part + 1]
            column = self._part(name, int(part))
            if values is None:
                values = np.zeros((len(places), *column.shape[1:]), np.int64)
            values[order[start:end]] = column[wanted[start:end] - self.bases[part]]
        return np.zeros(len(places), np.int64) if values is None else values


@lru_cache(maxsize=8)
def sorted_parts(folder: str, keys: str, columns: tuple[str, ...], sizes: tuple[int, ...]) -> SortedParts:
    """A worker maps an array once."""
    return SortedParts(folder, keys, columns, sizes)
