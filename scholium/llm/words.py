"""Words and word hashes shared by the operators on word sequences."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Odd multipliers of a polynomial hash and its finish.
BASE = np.uint64(0x9E3779B97F4A7C15)
FINISH = np.uint64(0xD6E8FEB86659FD93)


def split_words(text: str | None) -> list[bytes]:
    """The maximal runs without space, tab, LF, VT, FF or CR, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(zlib.crc32, words)), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * FINISH
    x = x ^ (x >> np.uint64(29))
    x = x * BASE
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` consecutive words, by their hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    size = len(words) - n + 1
    found = np.zeros(size, np.uint64)
    for j in range(n):
        found = found * BASE + words[j : j + size]
    return mix(found)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :]) if width > reach else values


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux keeps what lies below the last block in use
    if trim:
        trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow; at its end the memory that its batches and objects took is given back, as workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, each made when its turn comes: large values are not all held twice."""
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


def row_keys(key: str, text: str) -> list[Column]:
    """Columns key and row, equal for equal rows only: the id, and a 128-bit digest of the text that tells rows of one id (or none) apart; null and empty texts are one."""
    return [F.col(key).alias("key"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("row")]


def packed_texts(rows: DataFrame) -> DataFrame:
    """key, row, text -> key, row, packed: texts compressed before a shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3)
        for batch in batches:
            packed = [squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("row"), pa.array(packed, pa.binary())], ["key", "row", "packed"])

    return rows.mapInArrow(lean(pack), f"key {rows.schema['key'].dataType.simpleString()}, row binary, packed binary")


def unpack(packed: bytes) -> bytes:
    return zstandard.decompress(packed)
