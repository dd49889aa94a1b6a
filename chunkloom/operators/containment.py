"""Blocks found at any byte offset: a weak checksum of every window, and a strong one of those that may be a block.

The weak checksum of a window is a polynomial in its bytes, for all windows of a text at once by doubling (of 1, 2, 4, ... bytes). The blocks' checksums
set two bits each in a filter of at most ``FILTER`` bits, whatever their number; it is the only thing that every task gets. Windows that
pass have their md5 taken and leave their file as one row for each different window, so a block that is in every file is one row per file, and one
row per task behind map-side counting. Counts then meet the blocks by md5.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: for each block, at least and at most (16 MB); bytes of a text that are looked at together.
PER_BLOCK, LEAST, FILTER, PIECE = 64, 1 << 16, 1 << 27, 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def checksums(data: np.ndarray, window: int) -> np.ndarray:
    """The weak checksum of each run of ``window`` bytes (a power of two), by where it begins."""
    if len(data) < window:
        return np.empty(0, _U)
    h, width, base = data.astype(_U) + _U(1), 1, _BASE
    while width < window:
        h = h[:-width] * _U(base) + h[width:]
        width, base = 2 * width, base * base % 2**64
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _spots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of ``bits`` bits, a power of two."""
    return h & _U(bits - 1), (h >> _U(32)) & _U(bits - 1)


def block_filter(blocks: DataFrame, window: int) -> np.ndarray:
    """The filter over ``blocks`` (bytes): words of 32 bits are put together by Spark, and at most ``FILTER / 32`` come to the driver."""
    n = blocks.count()
    bits = min(FILTER, max(LEAST, 1 << (PER_BLOCK * n - 1).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [checksums(np.frombuffer(b, np.uint8), window) for b in batch.column(0).to_pylist()]
            spots = np.concatenate(_spots(np.concatenate(h or [np.empty(0, _U)]), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spots >> 5), pa.array(np.int64(1) << (spots & 31))], names=["word", "bit"])

    words = blocks.select("bytes").mapInArrow(place, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 5, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def windows_found(files: DataFrame, filter_: np.ndarray, window: int) -> DataFrame:
    """file_id, fp (md5) and places of each different window of a file that passes the filter; ``files`` has file_id and body."""
    shared = files.sparkSession.sparkContext.broadcast(filter_)

    def one(body: bytes, words: np.ndarray) -> Counter:
        bits, found = 32 * len(words), Counter()
        for at in range(0, max(1, len(body) - window + 1), PIECE):
            piece = body[at : at + PIECE + window - 1]
            h = checksums(np.frombuffer(piece, np.uint8), window)
            passed = np.ones(len(h), bool)
            for spot in _spots(h, bits):
                passed &= (words[(spot >> _U(5)).astype(np.int64)] >> (spot & _U(31)).astype(np.uint32)) & 1 == 1
            for k in np.flatnonzero(passed).tolist():
                found[hashlib.md5(piece[k : k + window], usedforsecurity=False).hexdigest()] += 1
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for i, file_id in enumerate(batch.column(0).to_pylist()):
                found = one(batch.column(1)[i].as_py() or b"", words)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([file_id] * len(found), pa.int64()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["file_id", "fp", "places"])

    return files.select(F.col("file_id").cast("long"), "body").mapInArrow(run, "file_id long, fp string, places long")


def found_anywhere(blocks: DataFrame, files: DataFrame, window: int) -> DataFrame:
    """fp, files, places and first_file of each different block (bytes, fp) of exactly ``window`` bytes that stands at any offset of ``files``."""
    if window & (window - 1):
        raise ValueError("a window must be a power of two")
    distinct = blocks.select("fp", "bytes").dropDuplicates(["fp"])
    found = windows_found(files, block_filter(distinct, window), window)
    counts = found.groupBy("fp").agg(F.count("*").alias("files"), F.sum("places").alias("places"), F.min("file_id").alias("first_file"))
    return counts.join(distinct.select("fp"), "fp", "left_semi")
