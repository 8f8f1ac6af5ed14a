"""Chunk dictionaries: documents as positions in the distinct words of a chunk of documents.

A chunk is a few megabytes of documents that one task reads in a row. Its distinct words leave the task
once, grouped by part of a hash, so that equal words of all chunks meet; what is found for them goes
back to the chunk, where it is joined to the documents by position. A word as frequent as one likes
is one entry a chunk.

Words and documents of a chunk come from two reads of the same rows. A chunk's name holds the task, its
number in the task and a digest of its words, so that a read in another order is noticed, not used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
#: Codes that are turned into values at a time, so that a very long document needs no large arrays.
BLOCK = 1 << 18
#: Text whose words are looked up together, by their hashes: a part of the dictionary, which one task holds.
PART_BYTES = 4 << 20
LEAST_PARTS = 8


def name(task: int, number: int, words) -> str:
    """`words`: bytes-like, all distinct words of the chunk in their order."""
    return f"{task}-{number}-{hashlib.blake2b(words, digest_size=12).hexdigest()}"


def count_parts(docs: DataFrame, text: str) -> int:
    """Parts of the dictionary, from the bytes of all texts, so that a part stays of one size."""
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(LEAST_PARTS, -(-n_bytes // PART_BYTES))


def by_part(hashes: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, edges) of the runs of equal parts of sorted hashes; equal hashes are in equal parts everywhere."""
    part = ((hashes >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int32)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    return part[first], np.append(first, len(part))


def pack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack_bytes(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def pack(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Unsigned integers as compressed byte planes."""
    values = numbers.astype(kind)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack_sorted(numbers: np.ndarray) -> bytes:
    """Sorted unsigned integers of 64 bits, as the steps between them."""
    return pack(np.diff(numbers, prepend=np.uint64(0)), "<u8")


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, "<u8"), dtype=np.uint64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the values of several runs, one run after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
