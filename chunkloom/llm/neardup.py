"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

Weights. A shingle is a run of five words (a shorter text is one shingle). Its weight in a text is its count there times
``1 + ln(1 + N / df) / ln(1 + N)``, a smoothed TF-IDF: from 2 for a shingle of one row to just over 1 for one that all rows have. Document
frequencies are exact and of all rows: rows are cut into blocks of about ``BLOCK`` shingles, each block sends a shard of the hash range its
distinct shingles there with their numbers of rows, packed, and what comes back is those in two rows or more. (Packets are as many
as blocks times shards: beyond some 10 TB raise ``BLOCK`` and ``SHARD`` with the square root of the input.)

Who can have a partner. All that two texts share is in two rows at least, so a text with less than 0.8 of its weight in such shingles is like
no other, exactly; the rest are sampled. The shingles that only one row has count in samples and similarities as one element of
their total weight, which changes neither. In the same way texts are left out later whose shingles that no other text in a bucket has
weigh over a fifth.

Candidates. ``BANDS * ROWS`` samples per text; two texts agree in a sample with the probability of their weighted Jaccard similarity.
Texts that agree in a band of ``ROWS`` samples share a bucket: at similarity 0.8 a pair is missed with probability below 1e-4.
Equal texts are one node from the start.

Verification. All members of a bucket are compared with its most central one, the hub (least weight of its own, fullest buckets): as many
comparisons as members. Links are joined to connected components; members that aren't connected with the hub get a hub of their own,
``TURNS`` times. What remains are pairs of a turn's connected and unconnected members, and in the last turn of unconnected ones. With o
and e of a text its overlap with the hub and its weight beside that which other texts have too, two texts share at most
min(o, o') + min(e, e'), which rules most pairs out. The bound is taken for cells of members of about equal o, e and
weight first, of which a bucket has a limited number whatever its size; only members of cells that it leaves meet, and are compared
unless they are connected by then. So any pair of a bucket is compared, or connected, or ruled out exactly, and no link is lost. What is
left grows with the number of pairs that are loosely similar (just below the threshold) and not connected.

Links are verified exactly, then joined to connected components by min-label propagation over stored tables. Nothing but counters
reaches the driver; nothing is broadcast. A bucket of any size is an ordinary (skewed) join, never one task's list, and a shingle that very many rows
have is one entry a block.

Null and empty texts, and texts without words, have no shingles: equal ones are one class, and they are like no other text. Rows with a
null doc_id form classes by their text like others; null counts as larger than all ids, so only a class without any id has a null one. Repeated rows
are in one class. ``near_dedup`` keeps one row of each class, its least by (id, hash of the text); further columns pass. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.shared import slices, store
from chunkloom.llm.words import encoded, mix, shingle_hashes, word_hashes

THRESHOLD, WIDTH = 0.8, 5
BANDS, ROWS = 14, 3
#: Shingles of a block, and on average of a shard; shards at least; texts of a block from which on a shingle's owners stay out of its shard.
BLOCK, SHARD, SHARDS, COMMON = 1_000_000, 1_000_000, 32, 64
#: Hubs that a bucket gets one after the other; steps of a hub's weight in which members are put together in cells.
TURNS, STEPS = 3, 64
EPS = 1e-9
_U = np.uint64


def shingle_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (sorted within it), their counts there, and where each text's begin, with the end."""
    h, first = word_hashes(texts)
    s, begin = shingle_hashes(h, first, WIDTH)
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        s[a:b].sort()
    new = np.empty(len(s), bool)
    if len(s):
        new[0] = True
        np.logical_or(s[1:] != s[:-1], owner[1:] != owner[:-1], out=new[1:])
    at = np.flatnonzero(new)
    return s[at], np.diff(np.append(at, len(s))), np.searchsorted(owner[at], np.arange(len(texts) + 1))


def idf(total: int, df: np.ndarray) -> np.ndarray:
    """The smoothed inverse document frequency."""
    return 1 + np.log1p(total / df) / np.log1p(total)


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays, bytes of the same place side by side, compressed."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64)
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * count, 8).reshape(-1, 2), 8 * (1 + 2 * count), []
    for width, n in head.tolist():
        plane = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(f"u{width}"))
        at += width * n
    return out


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


PACKETS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
PACKETS_SQL = "shard long, block long, kind int, data binary"
#: Packets of shingles by shard, of the owners of common shingles, and of the rows of a block.
SHINGLES, OWNERS, DOCS = 0, 1, 2


def _numbers(ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and where there is none."""
    return np.array([0 if i is None else i for i in ids], np.int64).view(_U), np.array([i is None for i in ids], np.uint8)


def cut_block(ids: list[int | None], texts: list[bytes], block: int, shards: int, common: int) -> Iterator[tuple[int, int, int, bytes]]:
    """The packets of one block."""
    first: dict[bytes, int] = {}
    digests = [hashlib.md5(t, usedforsecurity=False).digest() for t in texts]
    which = np.array([first.setdefault(d, len(first)) for d in digests], np.uint32)
    distinct = [texts[i] for i in np.unique(which, return_index=True)[1]]
    copies = np.bincount(which, minlength=len(distinct))
    s, tf, begin = shingle_counts(distinct)
    owner = np.repeat(np.arange(len(distinct), dtype=np.uint32), np.diff(begin))
    size = np.concatenate([[0], np.cumsum(tf)])[begin]
    yield block % shards, block, DOCS, packed(*_numbers(ids), which, np.frombuffer(b"".join(first), _U), np.diff(size).astype(_U))
    order = np.argsort(s, kind="stable")
    s, tf, owner = s[order], tf[order].astype(np.uint32), owner[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    n = np.diff(np.append(at, len(s)))
    rows = np.add.reduceat(copies[owner], at).astype(np.uint32) if len(s) else np.empty(0, np.uint32)
    h, few = s[at], n < common
    if not few.all():
        places = runs(at[~few], n[~few])
        yield block % shards, block, OWNERS, packed(h[~few], n[~few].astype(np.uint32), owner[places], tf[places])
    listed = np.where(few, n, 0).astype(np.uint32)
    shard = ((h >> _U(32)) * _U(shards)) >> _U(32)  # ranges of hashes, so a shard's are side by side
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(h) else np.empty(0, np.int64)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(h)], strict=False):
        places = runs(at[a:b], listed[a:b].astype(np.int64))
        yield int(shard[a]), block, SHINGLES, packed(np.diff(h[a:b], prepend=_U(0)), rows[a:b], listed[a:b], owner[places], tf[places])


ANSWERS_SQL = "block long, kind int, data binary"


def answer_shard(packets: pa.Table) -> pa.Table:
    """To each block what other rows have too of its shingles; other packets pass."""
    blocks, kinds, data = packets["block"].to_pylist(), packets["kind"].to_pylist(), packets["data"]
    mine = [i for i, k in enumerate(kinds) if k == SHINGLES]
    parts = [unpacked(data[i].as_py()) for i in mine]
    out = [(blocks[i], k, data[i].as_py()) for i, k in enumerate(kinds) if k != SHINGLES]
    hashes = [np.cumsum(p[0], dtype=_U) for p in parts]
    if parts:
        keys, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        df = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(_U)[inverse]
        at = 0
        for i, h, p in zip(mine, hashes, parts, strict=True):
            mine_df = df[at : at + len(h)]
            at += len(h)
            keep = mine_df > 1
            if keep.any():
                n = p[2].astype(np.int64)
                places = runs((np.cumsum(n) - n)[keep], n[keep])
                out.append((blocks[i], SHINGLES, packed(h[keep], mine_df[keep], p[2][keep], p[3][places], p[4][places])))
    return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([x[1] for x in out], pa.int32()), "data": pa.array([x[2] for x in out], pa.binary())})


SIGNED = pa.schema([("id", pa.int64()), ("h", pa.string()), ("total", pa.float64()), ("keys", pa.list_(pa.int64())), ("hs", pa.list_(pa.int64())), ("ws", pa.list_(pa.float64()))])
SIGNED_SQL = "id long, h string, total double, keys array<long>, hs array<long>, ws array<double>"


def sign_block(packets: pa.Table, total: int, threshold: float, bands: int) -> pa.Table:
    """id and h, the hash of the text, of each row of a block; once for each text that may have a partner also its weight, band keys, shared shingles and their weights."""
    parts: dict[int, list] = {SHINGLES: [], OWNERS: [], DOCS: []}
    for kind, data in zip(packets["kind"].to_pylist(), packets["data"], strict=True):
        parts[kind].append(unpacked(data.as_py()))
    ids, none, which, digests, size = parts[DOCS][0]
    n_texts = len(size)
    h, df, owner, tf = (np.concatenate([np.empty(0, _U), *x]) for x in zip(*[(np.repeat(p[0], p[2]), np.repeat(p[1], p[2]), p[3], p[4]) for p in parts[SHINGLES]], strict=True)) if parts[SHINGLES] else (np.empty(0, _U),) * 4
    for hot, n, who, count in parts[OWNERS]:
        known = [(p[0][p[2] == 0], p[1][p[2] == 0]) for p in parts[SHINGLES]]
        keys, values = np.concatenate([k for k, _ in known]), np.concatenate([v for _, v in known])
        order = np.argsort(keys)
        found = values[order][np.searchsorted(keys[order], hot)]  # common ones are in several rows, so each was answered
        h, df, owner, tf = np.concatenate([h, np.repeat(hot, n)]), np.concatenate([df, np.repeat(found, n)]), np.concatenate([owner, who]), np.concatenate([tf, count])
    owner = owner.astype(np.int64)
    w = tf * idf(total, df.astype(float))
    shared = np.bincount(owner, w, n_texts)
    own = (size - np.bincount(owner, tf.astype(float), n_texts)) * idf(total, np.ones(1))[0]
    weight = shared + own
    some = np.flatnonzero((shared >= threshold * weight - EPS) & (shared > 0))
    place = np.full(n_texts, -1)
    place[some] = np.arange(len(some))
    keep = place[owner] >= 0
    h, w, owner = h[keep], w[keep], place[owner[keep]]
    order = np.lexsort((h, owner))
    h, w = h[order], w[order]
    begin = np.searchsorted(owner[order], np.arange(len(some) + 1))
    keys = band_keys(h, w, begin, digests[::2][some], own[some], bands)
    hexes = [np.array([digests[2 * i], digests[2 * i + 1]], _U).tobytes().hex() for i in range(n_texts)]
    firsts = np.unique(which, return_index=True)[1]
    at = np.full(len(which), -1)
    at[firsts] = place
    rows, hv = at.tolist(), h.view(np.int64)
    pick = lambda f: [f(k) if k >= 0 else None for k in rows]
    cols = [pa.array(ids.view(np.int64), mask=none.astype(bool)), pa.array([hexes[i] for i in which.tolist()], pa.string()), pa.array(pick(lambda k: float(weight[some[k]])), pa.float64())]
    cols += [pa.array(pick(lambda k: keys[k]), SIGNED.types[3]), pa.array(pick(lambda k: hv[begin[k] : begin[k + 1]]), SIGNED.types[4]), pa.array(pick(lambda k: w[begin[k] : begin[k + 1]]), SIGNED.types[5])]
    return pa.Table.from_arrays(cols, schema=SIGNED)


def band_keys(h: np.ndarray, w: np.ndarray, begin: np.ndarray, names: np.ndarray, own: np.ndarray, bands: int) -> np.ndarray:
    """A row of ``bands`` keys for each text. What nobody else has is one element, named by the text's hash."""
    n = len(names)
    out = np.zeros((n, bands), _U)
    lone = np.flatnonzero(own > EPS)
    s, w = np.insert(h, begin[1:][lone], names[lone]), np.insert(w, begin[1:][lone], own[lone])
    begin = begin.copy()
    begin[1:] += np.cumsum(own > EPS)
    begin = begin[:-1]
    for a in range(0, n, 200):  # small arrays stay in the processor's cache
        b = min(n, a + 200)
        lo, hi = begin[a], begin[b] if b < n else len(s)
        ln = np.log(w[lo:hi]).astype(np.float32)
        for k in range(bands * ROWS):
            out[a:b, k // ROWS] = mix(out[a:b, k // ROWS] ^ samples(s[lo:hi], ln, begin[a:b] - lo, k) + _U(k + 1))
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], total: float) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights) of texts of ``total`` weight together."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    place = np.searchsorted(b[0], a[0])
    place[place == len(b[0])] = 0
    hit = b[0][place] == a[0]
    low = np.minimum(a[1][hit], b[1][place[hit]]).sum()
    return float(low / (total - low))


_LOW, _UNIT = _U(0x1FFFFF), np.float32(2**-21)


def samples(s: np.ndarray, w: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """The k-th consistent weighted sample of each text with shingles: 32 bits that tell the shingle and its level.

    For a shingle of weight S (``w`` is ln S), r and c are Gamma(2, 1) and b uniform, all drawn from its hash and k:
    t = floor(ln S / r + b), ln a = ln c - r (t - b + 1), and the shingle with the least a is the sample.
    """
    half = np.float32(0.5)
    x = mix(s + _U((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
    y = (x ^ (x >> _U(29))) * _U(0xD1B54A32D192ED03)
    y ^= y >> _U(32)
    # 21 bits a draw: u1, u2 and b from x, u3 and u4 from y
    r = ((x & _LOW).astype(np.float32) + half) * _UNIT
    r *= (((x >> _U(21)) & _LOW).astype(np.float32) + half) * _UNIT
    np.log(r, out=r)
    b = (x >> _U(43)).astype(np.float32) * _UNIT
    a = ((y & _LOW).astype(np.float32) + half) * _UNIT
    a *= (((y >> _U(21)) & _LOW).astype(np.float32) + half) * _UNIT
    np.log(a, out=a)
    np.negative(a, out=a)
    np.log(a, out=a)
    t = b - w / r  # r is still negative here
    np.floor(t, out=t)
    a += r * (t - b + np.float32(1))
    # floats as integers of the same order, above 32 bits that tell what was drawn
    i = a.view(np.int32)
    i ^= (i >> np.int32(31)) & np.int32(0x7FFFFFFF)
    high = (i.view(np.uint32) ^ np.uint32(0x80000000)).astype(_U) << _U(32)
    high |= (y ^ t.astype(np.int64).view(_U) * _U(0x9FB21C651E98DF25)) >> _U(32)
    return np.minimum.reduceat(high, begin) & _U(0xFFFFFFFF)


def components(edges: DataFrame) -> DataFrame:
    """node, class: for each linked node the least node it is connected with, by propagating labels and jumping along them until nothing changes."""
    both = store(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = store(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        best = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", "label", F.least("label", "near").alias("best"))
        # the label of the label: chains halve in each turn
        jump = best.join(labels.select(F.col("node").alias("best"), F.col("label").alias("far")), "best", "left").select("node", "label", F.least("best", F.coalesce("far", "best")).alias("next"))
        done = store(jump, "labels")
        changed = done.filter(F.col("label") != F.col("next")).limit(1).count()
        labels = done.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("class"))


def signatures(docs: DataFrame, threshold: float) -> DataFrame:
    """The rows of SIGNED for all rows of ``docs``."""
    total, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    shards = max(SHARDS, -(-(size or 0) // (6 * SHARD)))  # a word has some six bytes
    most, common, bands = BLOCK, COMMON, BANDS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def out():
            for packet in cut_block(ids, texts, block, shards, common):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(packet, PACKETS.types, strict=True)], schema=PACKETS)

        for batch in slices(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(encoded(t))
                held += len(texts[-1]) // 6 + 20
                if held >= most:
                    yield from out()
                    block, ids, texts, held = block + 1, [], [], 0
        if ids:
            yield from out()

    def sign(packets: pa.Table) -> pa.Table:
        return sign_block(packets, total, threshold, bands)

    packets = keyed(docs).select("id", "text").mapInArrow(cut, PACKETS_SQL)
    return packets.groupBy("shard").applyInArrow(answer_shard, ANSWERS_SQL).groupBy("block").applyInArrow(sign, SIGNED_SQL)


def merged(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """``classes`` (node, class) after new links (a, b): components of the classes that the links connect, so what is known isn't walked again."""
    if classes is None:
        return components(links)
    apart = labelled(labelled(links, classes, "a", "x"), classes, "b", "y").filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    apart = store(apart, "class-links")
    if not apart.limit(1).count():
        return classes
    top = components(apart)
    old = labelled(classes, top, "class", "least").select("node", F.col("least").alias("class"))
    return store(old.unionByName(top.join(classes, "node", "left_anti")), "classes")


def keyed(docs: DataFrame) -> DataFrame:
    """id, text, h of the rows of ``docs``."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("id"), text.alias("text"), F.md5(text).alias("h"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) for each row of ``docs``."""
    # a text with very many copies is a skewed join, which adaptive execution splits
    rows, texts = text_classes(docs, threshold)
    return rows.join(texts.select("h", "class_id"), "h").select(F.col("id").alias("doc_id"), "class_id")


def bucket_members(texts: DataFrame, threshold: float) -> DataFrame:
    """band, key, node, total, own (weight of shingles that no other member has), rank (the less, the more central) of all texts in buckets of several."""
    keys = texts.filter("keys IS NOT NULL").select("node", F.posexplode("keys").alias("band", "key"))

    def several(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
        return rows.join(sizes, ["band", "key"])

    found = store(several(keys), "members")
    vectors = texts.join(found.groupBy("node").agg(F.sum("n").alias("degree")), "node")
    each = vectors.select("node", F.explode(F.arrays_zip("hs", "ws")).alias("x")).select("node", F.col("x.hs").alias("s"), F.col("x.ws").alias("w"))
    lone = each.groupBy("s").agg(F.min("node").alias("node"), F.max("node").alias("other"), F.max("w").alias("w")).filter("node = other").groupBy("node").agg(F.sum("w").alias("lone"))
    about = vectors.select("node", "degree", "total", (F.col("total") - F.aggregate("ws", F.lit(0.0), lambda a, x: a + x)).alias("unshared")).join(lone, "node", "left")
    own = F.greatest(F.lit(0.0), F.col("unshared") + F.coalesce("lone", F.lit(0.0)))
    # what is a fifth and more of their weight of its own is like no other
    about = about.select("node", "total", own.alias("own"), F.struct(F.round(own / F.col("total"), 2).alias("share"), (-F.col("degree")).alias("less"), "node").alias("rank")).filter(F.col("total") - F.col("own") >= threshold * F.col("total") - EPS)
    return store(several(found.drop("n").join(about, "node")).drop("n"), "members")


def text_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(id and h, the hash of the text, of each row of ``docs``; h, id, the least of its rows, class_id and head, whether it is its class's first, of each distinct text)."""
    signed = store(signatures(docs, threshold), "signed")
    vector = F.first(F.when(F.col("keys").isNotNull(), F.struct("total", "keys", "hs", "ws")), ignorenulls=True)
    # a node for each text; its row with the least id stands for it
    texts = store(signed.groupBy("h").agg(F.min("id").alias("id"), vector.alias("v")).select("h", "id", "v.*").withColumn("node", F.monotonically_increasing_id()), "texts")
    bodies, at = texts.select("node", "total", "hs", "ws"), bucket_members(texts, threshold)
    known = met = classes = None
    for turn in range(TURNS):
        lead = at.groupBy("band", "key").agg(F.min(F.struct("rank", "total")).alias("r")).select("band", "key", F.col("r.rank.node").alias("hub"), F.col("r.total").alias("hub_total"))
        here = store(at.join(lead, ["band", "key"]).withColumn("a", F.least("node", "hub")).withColumn("b", F.greatest("node", "hub")), "turn")
        pairs = here.filter("node != hub").select("a", "b").distinct()
        pairs = pairs if known is None else pairs.join(known, ["a", "b"], "left_anti")
        sims = store(compare(pairs, bodies), "similarities")
        known = sims if known is None else known.unionByName(sims)
        classes = merged(classes, sims.filter(F.col("sim") >= threshold - EPS).select("a", "b"))
        # overlap with the hub, and what else other texts may share
        both = here.join(known, ["a", "b"], "left").withColumn("sim", F.when(F.col("node") == F.col("hub"), 1.0).otherwise(F.col("sim")))
        both = both.withColumn("o", F.col("sim") * (F.col("total") + F.col("hub_total")) / (1 + F.col("sim"))).withColumn("e", F.greatest(F.lit(0.0), F.col("total") - F.col("o") - F.col("own")))
        both = labelled(labelled(both, classes, "node", "class"), classes, "hub", "hub_class").withColumn("near", F.col("class") == F.col("hub_class"))
        both = store(both.select(F.lit(turn).alias("turn"), "band", "key", "node", "total", "own", "rank", "o", "e", "hub_total", "near"), "met")
        met = both if met is None else met.unionByName(both)
        apart = both.filter(~F.col("near"))
        sizes = apart.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
        at = apart.join(sizes, ["band", "key"]).select("band", "key", "node", "total", "own", "rank")
        if turn + 1 < TURNS:
            at = store(at, "apart")
            if not at.limit(1).count():
                break
    pairs = possible_pairs(met, turn, classes, threshold).join(known, ["a", "b"], "left_anti")
    more = compare(pairs, bodies).filter(F.col("sim") >= threshold - EPS).select("a", "b")
    classes = merged(classes, more)
    by_node = labelled(texts.select("h", "id", "node"), classes, "node", "class")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first")
    heads = by_node.join(classes.select("node"), "node", "left_semi").groupBy("class").agg(first)
    found = by_node.join(heads, "class", "left")
    head = F.col("first").isNull() | (F.col("h") == F.col("first.h"))
    return signed.select("id", "h"), found.select("h", "id", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"), head.alias("head"))


def labelled(rows: DataFrame, classes: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the class of the column ``node``, which is the node itself where it isn't linked."""
    return rows.join(classes.select(F.col("node").alias(node), F.col("class").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def possible_pairs(met: DataFrame, last: int, classes: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs a < b of texts of different classes that met the same hub and that the bound on their overlap doesn't rule out."""
    key = ["turn", "band", "key"]
    step = lambda c: F.floor(F.col(c) / F.col("hub_total") * STEPS).cast("int")
    rows = store(labelled(met, classes, "node", "class").withColumn("cell", F.struct("near", step("o").alias("o"), step("e").alias("e"), step("total").alias("t"))), "cells")
    cells = rows.groupBy(*key, "cell").agg(F.max("o").alias("o"), F.max("e").alias("e"), F.min("total").alias("total"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n"))
    cells = store(cells, "cell-bounds")

    def side(of: DataFrame, name: str, columns: list[str]) -> DataFrame:
        return of.select(*key, *(F.col(c).alias(f"{name}_{c}") for c in columns))

    most = F.least("x_o", "y_o") + F.least("x_e", "y_e")
    room = most >= (threshold - EPS) * (F.col("x_total") + F.col("y_total") - most)
    # the connected meet those that aren't, and these in the last turn each other
    order = (F.col("x_cell.near") & ~F.col("y_cell.near")) | ((F.col("turn") == last) & ~F.col("x_cell.near") & ~F.col("y_cell.near") & (F.col("x_cell") <= F.col("y_cell")))
    one = (F.col("x_lo") == F.col("x_hi")) & (F.col("x_lo") == F.col("y_lo")) & (F.col("x_lo") == F.col("y_hi"))
    columns = ["cell", "o", "e", "total", "lo", "hi"]
    some = store(side(cells, "x", columns).join(side(cells, "y", columns), key).filter(order & room & ~one).select(*key, "x_cell", "y_cell"), "cell-pairs")
    columns = ["cell", "node", "o", "e", "total", "own", "class"]
    pairs = some.join(side(rows, "x", columns), [*key, "x_cell"]).join(side(rows, "y", columns), [*key, "y_cell"])
    most = F.least(most, F.col("x_total") - F.col("x_own"), F.col("y_total") - F.col("y_own"))
    room = most >= (threshold - EPS) * (F.col("x_total") + F.col("y_total") - most)
    once = (F.col("x_cell") != F.col("y_cell")) | (F.col("x_node") < F.col("y_node"))
    return pairs.filter((F.col("x_class") != F.col("y_class")) & room & once).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def compare(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """a, b, sim for each pair of nodes."""
    side = lambda n: bodies.select(F.col("node").alias(n), F.col("total").alias(f"t{n}"), F.col("hs").alias(f"h{n}"), F.col("ws").alias(f"w{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            lists = []
            for k in (4, 5, 6, 7):
                c = batch.column(k)
                edge, flat = c.offsets.to_numpy(), c.values.to_numpy()
                lists.append([flat[x:y].view(_U) if k < 6 else flat[x:y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)])
            sims = [similarity((ha, wa), (hb, wb), t) for ha, hb, wa, wb, t in zip(*lists, total.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    return both.select("a", "b", "ta", "tb", "ha", "hb", "wa", "wb").mapInArrow(run, "a long, b long, sim double")


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each class: its least by (doc_id, hash of the text), null ids last; of repeated rows one."""
    split = lambda c: (F.coalesce(c, F.lit(0)).alias("id"), c.isNull().alias("none"))
    heads = text_classes(docs.select("doc_id", "text"), threshold)[1].filter("head")
    keep = heads.select(*split(F.col("id")), "h")
    key = docs["doc_id"].cast("long")
    packed_ = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *split(key), F.md5(F.coalesce(docs["text"], F.lit(""))).alias("h"))
    # the same keys for the join and the choice: one exchange
    return packed_.join(keep.hint("shuffle_hash"), ["id", "none", "h"], "left_semi").dropDuplicates(["id", "none", "h"]).select("row.*")


def brute_force(docs: list[tuple[int | None, str | None]], threshold: float = THRESHOLD) -> dict[int | None, int | None]:
    """doc_id to class_id by comparing all pairs, for tests."""
    texts = [encoded(t) for _, t in docs]
    grams = [shingle_counts([t])[:2] for t in texts]
    h, n = np.unique(np.concatenate([g[0] for g in grams] or [np.empty(0, _U)]), return_counts=True)
    vectors = [(g, c * idf(len(docs), n[np.searchsorted(h, g)])) for g, c in grams]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if texts[i] == texts[j] or similarity(vectors[i], vectors[j], vectors[i][1].sum() + vectors[j][1].sum()) >= threshold - EPS:
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return {d: least[find(i)] for i, (d, _) in enumerate(docs)}
