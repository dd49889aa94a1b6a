"""Which earlier chunk a chunk resembles, whatever file or place it is of: super-features that meet, the best base verified by its delta.

1. A chunk's features are the least values of ``FEATURES`` linear transforms of its rolling hash (of 16 bytes) over all places; equal stretches make
   equal features more likely. Features in groups are super-features: several groups, and any that matches makes a candidate.
2. In each bucket of a super-feature the chunk stored first stands for all. A chunk has a candidate for each of its buckets at most, so work is linear
   in the chunks, no bucket is paired or cut, and a super-feature that a third of all chunks have is one row for each task and then one.
3. Candidates are encoded, and the shortest record that pays is the base. Bases are always stored earlier, so chains end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.codec import encode
from chunkloom.functions.gear import rolling
from chunkloom.operators import delta
from chunkloom.sources.storage import stored

WINDOW_BITS, GROUPS, EACH = 16, 6, 2
FEATURES = GROUPS * EACH


def transform(i: int) -> tuple[int, int]:
    """Multiplier (odd) and offset of the i-th transform, from a rule."""
    return (0x9E3779B1 * (2 * i + 1)) % 2**32, (0x85EBCA77 * (i + 1)) % 2**32


_M, _A = (np.array(x, np.uint32)[:, None] for x in zip(*map(transform, range(FEATURES)), strict=True))


def features(data: bytes) -> list[int]:
    """The least value of each transform over the hashes after every byte; none for no bytes."""
    if not data:
        return []
    h = rolling(np.frombuffer(data, np.uint8), WINDOW_BITS)
    return (h[None, :] * _M + _A).min(axis=1).tolist()


def super_features(chunks: DataFrame) -> DataFrame:
    """fp, g, sf for each of the ``GROUPS`` super-features of every chunk of ``chunks`` (fp, bytes; a row for each fp) that isn't empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(fp, g, ",".join(map(str, x[g * EACH : (g + 1) * EACH]))) for fp, b in zip(f["fp"], f["bytes"], strict=True) if (x := features(bytes(b))) for g in range(GROUPS)]
            yield pd.DataFrame(rows, columns=["fp", "g", "sf"])

    return chunks.select("fp", "bytes").mapInPandas(run, "fp string, g int, sf string")


def candidates(supers: DataFrame, places: DataFrame) -> DataFrame:
    """fp, t_fp, matches: the earlier chunks that stand for a chunk's buckets, and for how many of them. ``places`` has fp and pos, what orders chunks."""
    placed = stored(supers.join(places.select("fp", "pos"), "fp"), "super-features")
    heads = placed.groupBy("g", "sf").agg(F.min(F.struct("pos", "fp")).alias("h"), F.count("*").alias("_n")).filter("_n > 1").select("g", "sf", F.col("h.fp").alias("t_fp"))
    return placed.join(heads, ["g", "sf"]).filter("fp <> t_fp").groupBy("fp", "t_fp").agg(F.count("*").alias("matches"))


def bases(chunks: DataFrame, places: DataFrame, ratio: float, coder: Callable[[bytes, bytes], bytes] = encode) -> DataFrame:
    """fp, t_fp, matches, rec_len, record: the base of every chunk that has a candidate whose record is shorter than ``ratio`` of the raw one.

    ``chunks`` has fp, len and bytes, a row for each fp. Of equally short records the one with the lesser t_fp is taken.
    """
    found = stored(candidates(super_features(chunks), places), "resembling")
    made = delta.encoded(found.select("fp", "t_fp"), chunks, coder)
    best = found.join(made, ["fp", "t_fp"]).groupBy("fp").agg(F.min_by(F.struct("t_fp", "matches", "rec_len", "record"), F.struct("rec_len", "t_fp")).alias("d")).select("fp", "d.*")
    return best.join(chunks.select("fp", "len"), "fp").filter(F.col("rec_len") < (F.col("len") + 1) * ratio).drop("len")
