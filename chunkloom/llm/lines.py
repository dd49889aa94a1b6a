"""Line dedup through a sharded minimal perfect hash.

A line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at its ends and with A-Z lower-cased. Keys of at least
``MIN_CHARS`` code points that occur in two documents or more lose all their lines but those in the smallest doc_id.

1. Distinct keys, as two independent 64-bit hashes, are counted with map-side combining (a line in every document is one row per
   task): occurrences, smallest and largest doc_id.
2. Each shard of them becomes a minimal perfect hash (levels of bit arrays; the rank of a key's bit is its slot) over compact arrays
   of fingerprints, counts and keepers. The number of shards follows the number of distinct keys and of lines, so neither a shard's
   arrays nor the lines that probe it are many.
3. Lines go to their shard as hashes and probe its arrays; no line text is shuffled or joined. Keys with at least a quarter of a
   shard's mean load, of which there can be at most four times as many as shards and ``FREQUENT``, are probed before that in a broadcast, so no
   shard is hot.
4. What is to be dropped returns to its document by doc_id.

Null and empty texts have one empty line. A null doc_id counts as one document that comes after all others. Rows with equal doc_id
are one document. Repeated rows give repeated results. Order within a text stays; a text may end up empty. Further columns pass through.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.shared import store
from chunkloom.llm.words import mix

#: Distinct keys and lines of a shard on average; frequent keys that are broadcast at most (32 bytes each).
MIN_CHARS, SHARD, LINES, FREQUENT = 10, 250_000, 1_000_000, 1_000_000
_GOLD = 0x9E3779B97F4A7C15


def _id(c: Column) -> tuple[Column, Column]:
    """An id that is never null, and whether there was none."""
    return F.coalesce(c.cast("long"), F.lit(0)).alias("_did"), c.isNull().alias("_none")


def line_keys(docs: DataFrame) -> DataFrame:
    """_did and _none (the id, and whether there is none), _rk (which row), pos, h1, h2 for every line with a key that is long enough."""
    blank = " \t\n\x0b\x0c\r"
    lines = docs.select(*_id(F.col("doc_id")), F.xxhash64("text").alias("_rk"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keys = lines.select("_did", "_none", "_rk", "pos", F.translate(F.btrim("line", F.lit(blank)), string.ascii_uppercase, string.ascii_lowercase).alias("key")).filter(F.char_length("key") >= MIN_CHARS)
    return keys.select("_did", "_none", "_rk", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class PerfectHash:
    """A minimal perfect hash over pairs of 64-bit hashes: levels of bits, a key's slot being the rank of its bit."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @staticmethod
    def place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * _GOLD % 2**64)
        return (mix(mix(h1 + salt) ^ h2) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while len(h1):
            size = len(h1) * 3 // 2 + 1
            at = cls.place(h1, h2, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
            if len(sizes) > 200:
                raise ValueError("keys of a perfect hash must be distinct")
        return cls(sizes, np.concatenate(bits) if bits else np.zeros(0, bool))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; some slot or -1 for keys it wasn't built over."""
        out = np.full(len(h1), -1)
        open_, base = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            at = self.place(h1[open_], h2[open_], level, size) + base
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_, base = open_[~hit], base + size
        return out


INDEX = pa.schema([("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary()), ("keepers", pa.binary())])
INDEX_SQL = "shard long, sizes array<long>, bits binary, prints binary, counts binary, keepers binary"


def _u64(column) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def build_shard(keys: pa.Table) -> pa.Table:
    """One shard's arrays. A key's count is its occurrences, or 1 where all are in one document."""
    keys = keys.combine_chunks()
    h1, h2 = _u64(keys["h1"]), _u64(keys["h2"])
    mph = PerfectHash.build(h1, h2)
    at = mph.slots(h1, h2)
    prints, counts, keepers = np.empty(len(h1), np.uint32), np.empty(len(h1), np.uint32), np.empty(len(h1), np.int64)
    prints[at] = h2 & np.uint64(0xFFFFFFFF)
    counts[at] = np.where(keys["many"].to_numpy(), np.minimum(keys["n"].to_numpy(), 2**32 - 1), 1)
    keepers[at] = keys["lo"].fill_null(0).to_numpy()
    return pa.Table.from_pylist([{"shard": keys["shard"][0].as_py(), "sizes": mph.sizes, "bits": np.packbits(mph.bits).tobytes(), "prints": prints.tobytes(), "counts": counts.tobytes(), "keepers": keepers.tobytes()}], INDEX)


DROPS = pa.schema([("_did", pa.int64()), ("_none", pa.bool_()), ("_rk", pa.int64()), ("pos", pa.int32())])


def probe_shard(lines: pa.Table, index: pa.Table) -> pa.Table:
    """The lines that go: known to the arrays, in several documents, and not in the keeper."""
    if not lines.num_rows or not index.num_rows:
        return DROPS.empty_table()
    row = index.to_pylist()[0]
    mph = PerfectHash(row["sizes"], np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool))
    h1, h2 = _u64(lines["h1"]), _u64(lines["h2"])
    at = mph.slots(h1, h2)
    safe = np.maximum(at, 0)
    known = (at >= 0) & (np.frombuffer(row["prints"], np.uint32)[safe] == (h2 & np.uint64(0xFFFFFFFF)))
    # a key of several documents has a keeper with an id
    other = (np.frombuffer(row["keepers"], np.int64)[safe] != lines["_did"].to_numpy()) | lines["_none"].to_numpy()
    go = known & (np.frombuffer(row["counts"], np.uint32)[safe] > 1) & other
    return lines.select(DROPS.names).filter(pa.array(go)).cast(DROPS)


def line_index(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(arrays by shard, keys too frequent for one shard, number of shards)."""
    known = F.when(~F.col("_none"), F.col("_did"))
    keys = line_keys(docs).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(known).alias("lo"), F.max(known).alias("hi"), F.bool_or("_none").alias("none"))
    many = F.col("lo").isNotNull() & ((F.col("lo") < F.col("hi")) | F.col("none"))
    keys = store(keys.select("h1", "h2", "n", "lo", many.alias("many")), "line-keys")
    distinct, total = keys.agg(F.count("*"), F.sum("n")).first()
    shards = max(8, -(-distinct // SHARD), -(-(total or 0) // LINES))
    heavy = keys.filter(F.col("n") >= max(64, -(-(total or 0) // min(FREQUENT, 4 * shards))))  # so at most FREQUENT rows
    index = keys.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards))).groupBy("shard").applyInArrow(build_shard, INDEX_SQL)
    return store(index, "line-index"), heavy, shards


def dropped_lines(docs: DataFrame) -> DataFrame:
    """_did, _none, _rk, pos of all lines to drop."""
    index, heavy, shards = line_index(docs)
    lines = line_keys(docs).join(F.broadcast(heavy.select("h1", "h2", "lo", "many")), ["h1", "h2"], "left")
    direct = lines.filter(F.col("many") & (F.col("_none") | (F.col("_did") != F.col("lo")))).select("_did", "_none", "_rk", "pos")
    routed = lines.filter(F.col("many").isNull()).select(F.pmod(F.col("h1"), F.lit(shards)).alias("shard"), "_did", "_none", "_rk", "pos", "h1", "h2")
    probed = routed.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe_shard, "_did long, _none boolean, _rk long, pos int")
    return direct.unionByName(probed)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """row (a struct of the columns of ``docs``), kept (what is left of the text), n_lines and n_dropped."""
    drops = dropped_lines(docs.select("doc_id", "text")).groupBy("_did", "_none", "_rk").agg(F.collect_set("pos").alias("_drop"))
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *_id(docs["doc_id"]), F.xxhash64(docs["text"]).alias("_rk"))
    both = keyed.join(drops.hint("shuffle_hash"), ["_did", "_none", "_rk"], "left").withColumn("_lines", F.split(F.coalesce("row.text", F.lit("")), "\n"))
    left = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _drop), i -> _lines[i]), '\n')")
    return both.select("row", F.when(F.col("_drop").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(left).alias("kept"), F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, texts without repeated lines, and ``n_chars``, where there is one, to match."""
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept")}
    return without_repeated_lines(docs).select(*(new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col("row").getField(f.name).alias(f.name) for f in docs.schema.fields))


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return without_repeated_lines(docs.select("doc_id", "text")).select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
