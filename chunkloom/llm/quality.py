"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted texts, sharded count joins, and thresholds by language.

The model is over bytes of UTF-8, ``ORDER`` (6) at a time, so an n-gram is an exact 48-bit key; a text begins with five boundary
symbols (0xFF, which UTF-8 never has); a trusted one ends with one. Trusted texts are those labelled of good quality and not toxic; all are counted.

1. Counts of 6-grams of trusted texts: per task by numpy, then summed by key. Lower orders count distinct left extensions. Discounts
   D1, D2, D3+ of each order come from its counts of counts (a few numbers); orders 1 and 2 are a 256 x 256 table.
2. Keys are sharded by the two bytes before the predicted one. Suffixes down to order 3, their contexts and continuations are then in
   the same shard, so one shuffle serves all orders.
3. Documents are dealt into blocks of about ``BLOCK`` bytes. Each block asks each shard once for its distinct keys; the count join in
   the shard (cogroup of counts and requests) answers with log-probabilities; answers and texts meet again by block and are
   summed by document. So text moves once, and requests and answers are a fraction of it. The number of shards and of blocks grows with the
   input, and no model table is broadcast.
4. Perplexity is per predicted byte. A language's threshold is the quantile ``QUANTILE`` of its trusted texts' log-perplexities (from an exact
   histogram with bins of 0.001) plus ``MARGIN``; a document is kept up to it. Languages without trusted texts use that over all of them.

Trusted doc_ids are broadcast while there are at most ``TRUSTED`` (32 MB); beyond, documents are semi-joined with them.

Null and empty texts have nothing to predict: their perplexity is null, they are not kept, and they train nothing. Null ids are never trusted; a null
language is one of its own, apart from the empty one.
Repeated rows count as often as they occur and get equal results. Without trusted texts all bytes are alike and all texts that aren't empty are kept.
Further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.llm.shared import store
from chunkloom.llm.words import chunks, encoded

ORDER, BLOCK, TRUSTED = 6, 16_000_000, 4_000_000
#: Blocks for each shard, so that a task has no more than about their requests (some 2 MB each) at a time.
ASKED = 8
QUANTILE, MARGIN = 0.995, 0.1
#: Answers are in steps of this many nats.
STEP = 1 / 2048
_U = np.uint64
_PAD = b"\xff" * (ORDER - 1)


def grams(texts: list[bytes], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The key of every predicted byte of all texts (its last byte being the predicted one), and where each text's begin, with the end."""
    raw = np.frombuffer(b"".join(_PAD + t + end for t in texts), np.uint8)
    n = np.fromiter((len(t) + len(end) for t in texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(n)])
    key = np.zeros(max(0, len(raw) - ORDER + 1), _U)
    for j in range(ORDER):
        key = (key << _U(8)) | raw[j : len(raw) - ORDER + 1 + j]
    # a text of n predictions has as many keys, then ORDER - 1 follow that reach into the next text
    start = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
    turn = np.zeros(len(key) + 1, np.int32)
    some = np.flatnonzero(n)
    turn[start[some]] += 1
    turn[start[some] + n[some]] -= 1
    keep = np.cumsum(turn[:-1]) > 0
    return key[keep], begin


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _texts(column) -> list[bytes]:
    return [encoded(t) for t in column.to_pylist()]


def count_grams(batches: Iterator[pa.RecordBatch], trusted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (gram, n), merged within the task as far as memory allows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    out = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["gram", "n"])
    for batch in batches:
        if trusted is not None:
            ids = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(trusted, ids), max(0, len(trusted) - 1))
            batch = batch.filter(pa.array((trusted[place] == ids) & batch.column(0).is_valid().to_numpy(zero_copy_only=False) if len(trusted) else np.zeros(len(ids), bool)))
        texts = _texts(batch.column(1))
        for a, b in chunks([len(t) for t in texts]):
            held.append(np.unique(grams(texts[a:b], b"\xff")[0], return_counts=True))
            if sum(len(k) for k, _ in held) > 4_000_000:
                held = [merge(held)]
                if len(held[0][0]) > 2_000_000:
                    yield out(*held.pop())
    if held:
        yield out(*merge(held))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of grams seen once, twice, three and four times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(k - 0.05, max(0.05, k - (k + 1) * y * b / a)) if a else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


class Contexts:
    """One order's grams and contexts: counts, totals and the mass left to lower orders."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, d: tuple[float, float, float]):
        self.keys, self.counts, self.d = keys, counts, np.array([0.0, *d])
        self.ctx, first = np.unique(keys >> _U(8), return_index=True)
        self.total = np.add.reduceat(counts, first).astype(float) if len(keys) else np.empty(0)
        self.left = np.add.reduceat(self.d[np.minimum(counts, 3)], first) / self.total if len(keys) else np.empty(0)

    def refine(self, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities by this order, interpolated with ``lower``; contexts that weren't seen leave it as it is."""
        if not len(self.keys):
            return lower
        c = np.minimum(np.searchsorted(self.ctx, keys >> _U(8)), len(self.ctx) - 1)
        seen = self.ctx[c] == keys >> _U(8)
        g = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        n = np.where(self.keys[g] == keys, self.counts[g], 0)
        return np.where(seen, (n - self.d[np.minimum(n, 3)]) / self.total[c] + self.left[c] * lower, lower)


def lower(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes one shorter than ``order`` and their numbers of distinct left extensions."""
    return np.unique(keys & _U(256 ** (order - 1) - 1), return_counts=True)


def base_table(bigrams: np.ndarray, counts: np.ndarray, d1: tuple, d2: tuple) -> np.ndarray:
    """Probabilities of order 2, 256 x 256, over order 1 over the uniform one."""
    p = np.full(256, 1 / 256)
    if len(bigrams):
        p = Contexts(*lower(bigrams, 2), d1).refine(np.arange(256, dtype=_U), p)
        return Contexts(bigrams, counts, d2).refine(np.arange(65536, dtype=_U), np.tile(p, 256)).reshape(256, 256)
    return np.tile(p, (256, 1))


class Shard:
    """Orders 3 to 6 of the grams of one shard."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, base: np.ndarray, d: dict[int, tuple]):
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        self.base, self.orders = base, []
        for k in range(ORDER, 2, -1):
            self.orders.append((k, Contexts(keys, counts, d[k])))
            keys, counts = lower(keys, k)

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        p = self.base[((keys >> _U(8)) & _U(255)).astype(int), (keys & _U(255)).astype(int)]
        for k, c in reversed(self.orders):
            p = c.refine(keys & _U(256**k - 1), p)
        return np.log(p)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((((keys >> _U(8)) & _U(0xFFFF)) * _U(2654435761) >> _U(16)) % _U(shards)).astype(np.int64)


def shard_column(gram: Column, shards: int) -> Column:
    """The same for a column."""
    return F.shiftright(F.shiftright(gram, 8).bitwiseAND(F.lit(0xFFFF)) * F.lit(2654435761), 16) % F.lit(shards)


def distinct_keys(texts: list[bytes]) -> np.ndarray:
    parts = [np.unique(grams(texts[a:b])[0]) for a, b in chunks([len(t) for t in texts])]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, _U)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def gram_counts(docs: DataFrame, labels: DataFrame, bound: int = TRUSTED) -> DataFrame:
    """gram, n over all trusted texts."""
    ids = trusted_ids(labels)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text <> ''")
    if ids.count() <= bound:
        held = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow()["doc_id"].to_numpy()))
        rows = docs.mapInArrow(lambda batches: count_grams(batches, held.value), "gram long, n long")
    else:
        rows = docs.join(ids, "doc_id", "left_semi").mapInArrow(lambda batches: count_grams(batches, None), "gram long, n long")
    return store(rows.groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")


def model(counts: DataFrame) -> tuple[np.ndarray, dict[int, tuple]]:
    """(table of order 2, discounts of orders 3 to 6). Only counts of counts and the 65,536 bigrams reach the driver."""
    d, at = {}, counts
    for k in range(ORDER, 1, -1):
        if k == 2:
            got = at.toArrow()
            keys, n = got["gram"].to_numpy().view(_U), got["n"].to_numpy()
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            ones = lower(keys, 2)[1]
            few = lambda c: discounts([int((c == i).sum()) for i in range(1, 5)])
            return base_table(keys, n, few(ones), few(n)), d
        d[k] = discounts(list(at.agg(*(F.count_if(F.col("n") == i) for i in range(1, 5))).first()))
        at = at.select(F.col("gram").bitwiseAND(F.lit(256 ** (k - 1) - 1)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    raise AssertionError


def perplexities(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity for each row of ``docs``."""
    base, d = model(counts)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(64, -(-size // BLOCK))
    shards = max(16, blocks // ASKED, -(-counts.count() // 1_000_000))
    held = docs.sparkSession.sparkContext.broadcast((base, d))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce("text", F.lit("")).alias("text")).withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))

    def ask(block: pa.Table) -> pa.Table:
        keys = distinct_keys(_texts(block["text"]))
        where, z = shard_of(keys, shards), zstandard.ZstdCompressor(level=3)
        order = np.argsort(where, kind="stable")
        parts = np.split(keys[order], np.searchsorted(where[order], np.arange(1, shards)))
        some = [s for s, p in enumerate(parts) if len(p)]
        packets = [z.compress(np.diff(parts[s], prepend=_U(0)).tobytes()) for s in some]
        return pa.table({"shard": pa.array(some, pa.int64()), "block": pa.array([block["block"][0].as_py()] * len(some), pa.int64()), "asked": pa.array(packets, pa.binary())})

    def answer(grams_: pa.Table, asked: pa.Table) -> pa.Table:
        s = Shard(grams_["gram"].to_numpy().view(_U), grams_["n"].to_numpy(), *held.value)
        z, y, out = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3), []
        for row in asked["asked"]:
            keys = np.cumsum(np.frombuffer(z.decompress(row.as_py()), _U), dtype=_U)
            out.append(y.compress(np.minimum(np.rint(-s.log_p(keys) / STEP), 65535).astype(np.uint16).tobytes()))
        return pa.table({"block": asked["block"], "shard": asked["shard"], "said": pa.array(out, pa.binary())})

    def total(block: pa.Table, said: pa.Table) -> pa.Table:
        # keys once, piece by piece: the pieces' distinct keys give the block's, in the order in which the shards were asked
        texts, z, parts = _texts(block["text"]), zstandard.ZstdDecompressor(), []
        for a, b in chunks([len(t) for t in texts]):
            g, begin = grams(texts[a:b])
            u, at = np.unique(g, return_inverse=True)
            parts.append((u, at.astype(np.int32), begin))
        keys = np.unique(np.concatenate([u for u, *_ in parts])) if parts else np.empty(0, _U)
        where, value = shard_of(keys, shards), np.zeros(len(keys))
        order = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[order], np.arange(shards + 1))
        for s, x in zip(said["shard"].to_pylist(), said["said"], strict=True):
            value[order[cut[s] : cut[s + 1]]] = np.frombuffer(z.decompress(x.as_py()), np.uint16) * STEP
        out = []
        for u, at, begin in parts:
            n = np.diff(begin)
            mean = np.full(len(n), np.nan)
            if len(at):
                mean[n > 0] = np.add.reduceat(value[np.searchsorted(keys, u)][at], begin[:-1][n > 0]) / n[n > 0]
            out.append(mean)
        return pa.table({"doc_id": block["doc_id"], "lang": block["lang"], "nats": pa.array(np.concatenate(out), from_pandas=True)})

    sharded = counts.withColumn("shard", shard_column(F.col("gram"), shards))
    asked = dealt.groupBy("block").applyInArrow(ask, "shard long, block long, asked binary")
    said = sharded.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(answer, "block long, shard long, said binary")
    return dealt.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(total, "doc_id long, lang string, nats double")


def _language() -> Column:
    """The language as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("_lang")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep for each row of ``docs`` (doc_id, text, lang)."""
    counts = gram_counts(docs, labels)
    scored = store(perplexities(docs, counts), "nats")
    bins = scored.join(trusted_ids(labels), "doc_id", "left_semi").filter("nats IS NOT NULL").groupBy(_language(), F.round("nats", 3).alias("bin")).agg(F.count("*").alias("n"))

    def limits(bins: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by)
        up = bins.select(*by, "bin", F.sum("n").over(w.orderBy("bin")).alias("up"), F.sum("n").over(w).alias("all"))
        return up.filter(F.col("up") >= F.col("all") * QUANTILE).groupBy(*by).agg((F.min("bin") + MARGIN).alias("limit"))

    every = limits(bins.groupBy("bin").agg(F.sum("n").alias("n")), []).first()
    overall = every[0] if every and every[0] is not None else None
    own = scored.withColumn("_lang", _language()).join(limits(bins, ["_lang"]), "_lang", "left").withColumn("limit", F.coalesce("limit", F.lit(overall).cast("double")))
    return own.select("doc_id", "lang", F.round(F.exp("nats"), 6).alias("perplexity"), F.round(F.exp("limit"), 6).alias("threshold"), (F.col("nats").isNotNull() & F.coalesce(F.col("nats") <= F.col("limit"), F.lit(True))).alias("keep"))


def brute_force(texts: list[bytes], trusted: list[bytes]) -> list[float]:
    """Perplexities by the recursive definition over dictionaries, for tests."""
    from collections import Counter, defaultdict

    tables: dict[int, dict[bytes, int]] = {ORDER: Counter(p[i : i + ORDER] for t in trusted for p in [_PAD + t + b"\xff"] for i in range(len(t) + 1))}
    for k in range(ORDER, 1, -1):
        left = defaultdict(set)
        for g in tables[k]:
            left[g[1:]].add(g[0])
        tables[k - 1] = {g: len(s) for g, s in left.items()}
    d = {k: (0.0, *discounts([sum(c == i for c in t.values()) for i in range(1, 5)])) for k, t in tables.items()}
    ctx = {k: defaultdict(list) for k in tables}
    for k, t in tables.items():
        for g, c in t.items():
            ctx[k][g[:-1]].append(c)

    def p(g: bytes) -> float:
        k = len(g)
        if not k:
            return 1 / 256
        low, seen = p(g[1:]), ctx[k].get(g[:-1])
        if not seen:
            return low
        c = tables[k].get(g, 0)
        return (c - d[k][min(c, 3)]) / sum(seen) + sum(d[k][min(x, 3)] for x in seen) / sum(seen) * low

    return [math.exp(-sum(math.log(p(s[i : i + ORDER])) for i in range(len(t))) / len(t)) if t else math.nan for t in texts for s in [_PAD + t]]
