"""A Bloom filter over 64-bit hashes, built per task and merged by or."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bloom:
    def __init__(self, bits: int = 1 << 20, hashes: int = 5, data: np.ndarray | None = None):
        self.bits, self.hashes = bits, hashes
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def _at(self, h: np.ndarray) -> np.ndarray:
        h = h.astype(np.uint64)
        a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        return np.stack([(a + np.uint64(k) * b) % np.uint64(self.bits) for k in range(self.hashes)])

    def add(self, h: np.ndarray) -> None:
        at = self._at(h).ravel()
        np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self._at(h)
        return ((self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def build(hashes: DataFrame, bits: int = 1 << 20, k: int = 5) -> Bloom:
    """The filter of a column of longs. The driver gets ``bits`` bits per task, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Bloom(bits, k)
        for b in batches:
            one.add(b.column(0).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([one.data.tobytes()])], names=["data"])

    out = Bloom(bits, k)
    for row in hashes.mapInArrow(run, "data binary").toLocalIterator():
        out.data |= np.frombuffer(row["data"], np.uint8)
    return out


def gated(batch: DataFrame, store: DataFrame, key: str, shard: int = 1 << 18) -> DataFrame:
    """The distinct keys of ``batch`` with ``maybe``: whether a filter over ``store`` lets them through to the index.

    Keys are dealt by hash into shards of about ``shard`` stored keys, each with a filter of ten bits a key, so no filter grows with the store.
    A null key isn't looked up.
    """
    have, want = (d.select(F.col(key).cast("string").alias("k")).filter("k IS NOT NULL").distinct() for d in (store, batch))
    n = max(1, -(-have.count() // shard))
    dealt = lambda d: d.toDF("k").select("k", F.xxhash64("k").alias("h"), F.pmod(F.hash("k"), F.lit(n)).alias("shard"))

    def look(there: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        one = Bloom(max(1024, len(there) * 10 + 7 & ~7), 7)
        one.add(there["h"].to_numpy(np.int64).view(np.uint64))
        maybe = one.has(asked["h"].to_numpy(np.int64).view(np.uint64)) if len(asked) else np.zeros(0, bool)
        return pd.DataFrame({"k": asked["k"], "maybe": maybe})

    # the names of the two sides are their own, however the callers' frames are related
    there, asked = dealt(have).toDF("k", "h", "shard"), dealt(want).toDF("k", "h", "part")
    return there.groupBy("shard").cogroup(asked.groupBy("part")).applyInPandas(look, "k string, maybe boolean").withColumnRenamed("k", key)
