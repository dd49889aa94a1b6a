"""SimHash near-duplicates: fingerprints within a few bits, found by pigeonring filtering, joined to components.

Fingerprints. Words are runs of other than white space, A-Z lower-cased; shingles three words joined by a space (a shorter text is one
shingle), hashed by XXH64 with seed 42, repeats included. A bit is set if it is set in over half of the hashes; a text without words has
fingerprint zero, which links like any other.

Candidates. The 64 bits are ``SEGMENTS`` segments in a ring. If two fingerprints differ in ``distance`` bits or fewer, there is a segment from
which on every chain of 1, 2, ... l consecutive segments differs in at most ``floor(l * distance / SEGMENTS)`` bits together (were there none, the
chains that break their budgets would tile the ring and exceed the distance). Budgets of the first chains are zero (with five segments and
two bits those of one and two segments), so pairs share that stretch of bits: each fingerprint is dealt to ``SEGMENTS`` buckets by ring position and stretch.
Pairs of a bucket are held against the budgets of the longer chains, one after the other; the chain of all segments is the full Hamming check.

Skew. Only distinct fingerprints are dealt out. A bucket of more than ``BUCKET`` of them is dealt again by its members' neighbours:
each member stands under itself and itself with one bit outside the shared stretch flipped. Two members within two bits meet under a common neighbour,
and at most 65 fingerprints are next to one. So no group exceeds ``BUCKET``, nothing is left out, and work grows with the number of fingerprints.
Each group gives a spanning forest of its links and no list of pairs. Components come from label propagation over stored tables.

A null text is empty. Rows with a null doc_id get a component like all others; null counts as larger than all ids, so a component has a null id
only if all its rows do. Repeated rows are rows of their own in one component. Further columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.neardup import components
from chunkloom.llm.shared import slices, store

WIDTH, DISTANCE, SEGMENTS, SEED = 3, 2, 5, 42
#: Distinct fingerprints of a bucket that are compared with each other; bytes of a text, hashes and pairs that are held at a time.
BUCKET, PIECE, HASHES, PAIRS = 256, 1 << 20, 1 << 16, 1 << 22
_U = np.uint64
_BLANK = re.compile(rb"[ \t-\r]")


def pieces(data: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, in lists of about ``most`` bytes of text, cut at white space."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, at + most)
        end = cut.start() if cut else len(data)
        yield data[at:end].lower().split()
        at = end


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of all runs of ``width`` words."""
    from xxhash import xxh64_intdigest

    text = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1]
    return np.fromiter((xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)), _U, len(starts))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, from the lowest."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(h), HASHES):
        out += np.unpackbits(h[at : at + HASHES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def simhash(data: bytes, width: int = WIDTH) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    counts, n, carried = np.zeros(64, np.int64), 0, []
    for words in pieces(data):
        words = carried + words
        if len(words) >= width:
            h = shingle_hashes(words, width)
            counts, n = counts + bit_counts(h), n + len(h)
        carried = words[max(0, len(words) - width + 1) :]
    if not n and carried:
        h = shingle_hashes(carried, len(carried))
        counts, n = bit_counts(h), 1
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1)
            found = np.fromiter((simhash(texts[i].as_buffer().to_pybytes(), width) for i in range(len(texts))), _U, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, "doc_id long, fp long")


def chains(distance: int, segments: int) -> list[list[tuple[int, int]]]:
    """For each ring position (mask, budget) of its chains: of the longest without budget, and then of each longer one."""
    width = [64 // segments + (k < 64 % segments) for k in range(segments)]
    masks = [((1 << w) - 1) << sum(width[:k]) for k, w in enumerate(width)]
    out = []
    for i in range(segments):
        ring = [(sum(masks[(i + k) % segments] for k in range(n)), n * distance // segments) for n in range(1, segments + 1)]
        free = sum(budget == 0 for _, budget in ring[:-1])
        out.append(ring[free - 1 :])
    return out


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the least node that the links a < b connect it with."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = np.minimum(least, label[least])
        if (least == label).all():
            return label
        label = least


def group_links(fps: np.ndarray, sizes: np.ndarray, ring: np.ndarray, plan: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Links that span each group: members one after the other, each group's size and ring position."""
    ends = np.cumsum(sizes)
    after = np.repeat(ends, sizes) - np.arange(len(fps)) - 1
    a = np.repeat(np.arange(len(fps)), after)
    b = np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after) + a + 1
    differ, where = fps[a] ^ fps[b], np.repeat(ring, sizes * (sizes - 1) // 2)
    masks, budgets = np.array([[m for m, _ in p] for p in plan], _U), np.array([[most for _, most in p] for p in plan])
    for k in range(1, masks.shape[1]):
        fits = np.bitwise_count(differ & masks[where, k]) <= budgets[where, k]
        a, b, differ, where = a[fits], b[fits], differ[fits], where[fits]
    label = forest(a, b, len(fps))
    member = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[member]], fps[member]


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """a and b: links between the distinct ``fp`` of ``fps`` that connect all that are within ``distance`` bits."""
    if not 0 <= distance <= 2 or segments <= distance:
        raise ValueError("distance must be 0 to 2 and less than the number of segments")
    plan = chains(distance, segments)
    spots = F.array(*(F.struct(F.lit(i).alias("ring"), F.col("fp").bitwiseAND(F.lit(signed(p[0][0]))).alias("key")) for i, p in enumerate(plan)))
    dealt = store(fps.select("fp", F.explode(spots).alias("x")).select("x.*", "fp"), "ring")
    sizes = dealt.groupBy("ring", "key").agg(F.count("*").alias("members")).filter("members > 1")
    met = dealt.join(sizes, ["ring", "key"])
    # bits outside the shared stretch, one of which is flipped
    flips = [F.array(*(F.lit(signed(1 << k)) for k in range(64) if not p[0][0] >> k & 1)) for p in plan]
    outside = F.element_at(F.array(*flips), F.col("ring") + 1)
    near = F.concat(F.array("fp"), F.transform(outside, lambda bit: F.col("fp").bitwiseXOR(bit)))
    met = met.select("ring", "key", "fp", F.explode(F.when(F.col("members") > bucket, near).otherwise(F.array(F.lit(None).cast("long")))).alias("under"))
    groups = met.groupBy("ring", "key", "under").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1").select("ring", F.col("under").isNotNull().alias("all"), "fps")
    last = [p[-1:] * len(p) for p in plan]  # no chains where neighbours meet: only the full check

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()].view(_U)
            ring = batch.column(0).to_numpy() + np.where(batch.column(1).to_numpy(zero_copy_only=False), segments, 0)
            weight, begin = np.cumsum(sizes.astype(np.int64) ** 2), np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < len(sizes):
                end = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + 2 * PAIRS, side="right")))
                a, b = group_links(flat[begin[at] : begin[end]], sizes[at:end], ring[at:end], plan + last)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
                at = end

    return groups.mapInArrow(work, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_components(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links reach) for each row of ``docs``."""
    rows = store(fingerprints(docs, width), "simhash")
    fps = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    classes = components(links(fps.select("fp"), distance))
    known = fps.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "class")
    heads = known.filter("class IS NOT NULL").groupBy("class").agg(F.min("least").alias("component_id"))
    named = known.join(heads, "class", "left").select("fp", F.when(F.col("class").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    # a fingerprint of very many rows is a skewed join, which adaptive execution splits
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = simhash_components(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
