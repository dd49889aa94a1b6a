"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Benchmark items are partitioned by their number of distinct word shingles (powers of two, and by shingle width for items of
fewer than five words). Each partition is an index of its own: an item of q shingles is held there as a bottom-k MinHash, the
``k = q - ceil(t q) + 1 + SPARE`` smallest hashes of its shingles (all, if it has fewer), whose size follows the partition. A text that holds at least
the share ``t`` of the item's shingles misses at most ``q - ceil(t q)`` of all and so of these; so a text is a candidate if it holds
``k - (q - ceil(t q))`` of the sketch or more: the sketch's estimate of containment, at a bound that loses nothing. Every document's
shingles probe each partition; candidates are verified on the words themselves.

The items are the stated query set. They are taken in blocks of at most ``BLOCK`` rows and ``BLOCK_BYTES`` bytes of text, each block
against all documents, so a task holds one block's sketches, whatever the size of either table. Documents are read in one map per block: no
shuffle; ``decontaminate`` stores what one block leaves for the next.

Null and empty texts contain nothing and items without words match nothing. Repeated documents or items give repeated rows. Further
columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chunkloom.llm.shared import store
from chunkloom.llm.words import FOLD, chunks, encoded, shingle_hashes, word_hashes

BLOCK, BLOCK_BYTES = 20_000, 32_000_000
WIDTH, THRESHOLD = 5, 0.8
#: Hashes of a sketch beyond those needed to lose nothing; a candidate holds one more of them.
SPARE = 3


def shingle_set(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


class Sketches:
    """The partitions of one block of items: (width, class of size) to the sketches' sorted hashes, a filter over them, and who has each."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float):
        self.threshold, self.items = threshold, []
        held: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = encoded(text).translate(FOLD).split()
            if not words:
                continue
            width = min(WIDTH, len(words))
            whole = shingle_set(words, width)
            h, first = word_hashes([b" ".join(words)])
            hashes = np.unique(shingle_hashes(h, first, width)[0])
            q = len(hashes)
            miss = q - math.ceil(threshold * q - 1e-9)
            k = min(q, miss + 1 + SPARE)
            for x in hashes[:k].tolist():
                held[width, q.bit_length()][x].append(len(self.items))
            self.items.append((item_id, width, whole, k - miss))
        self.parts = {}
        for part, owners in held.items():
            keys = np.array(sorted(owners), np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.parts[part] = keys, seen, dict(owners)

    def candidates(self, texts: list[bytes]) -> dict[int, set[int]]:
        """Of each text's place, the items of whose sketch it holds enough."""
        out: dict[int, set[int]] = defaultdict(set)
        h, first = word_hashes(texts)
        for width in sorted({w for w, _ in self.parts}):
            s, begin = shingle_hashes(h, first, width, short=False)
            top = (s >> np.uint64(44)).astype(np.int64)
            for (w, _), (keys, seen, owners) in self.parts.items():
                if w != width:
                    continue
                at = np.flatnonzero(seen[top])
                at = at[np.isin(s[at], keys)]
                docs = np.searchsorted(begin, at, side="right") - 1
                hits = Counter((d, i) for d, x in set(zip(docs.tolist(), s[at].tolist(), strict=True)) for i in owners[x])
                for (d, i), n in hits.items():
                    if n >= self.items[i][3]:
                        out[d].add(i)
        return out

    def found(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text's place, item_id, shingles of the item, shingles of it in the text)."""
        for d, who in sorted(self.candidates(texts).items()):
            words = texts[d].translate(FOLD).split()
            sets = {}
            for i in sorted(who):
                item_id, width, whole, _ = self.items[i]
                if width not in sets:
                    sets[width] = shingle_set(words, width)
                shared = len(whole & sets[width])
                if shared >= self.threshold * len(whole) - 1e-9:
                    yield d, item_id, len(whole), shared


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in bounded blocks, whatever their number."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if len(block) >= BLOCK or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())])
SQL_SCHEMA = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: every item of which a document holds the share ``threshold`` or more."""
    spark, out = docs.sparkSession, None
    for items in item_blocks(benchmark):
        held = spark.sparkContext.broadcast(Sketches(items, threshold).__dict__)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sk = Sketches([], threshold)
            sk.__dict__ = held.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                texts = [encoded(t) for t in batch.column(1).to_pylist()]
                rows = []
                for a, b in chunks([len(t) for t in texts]):
                    rows += [(ids[a + d], i, n, m, m / n) for d, i, n, m in sk.found(texts[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(SCHEMA.types)], schema=SCHEMA)

        one = docs.select("doc_id", "text").mapInArrow(search, SQL_SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], SQL_SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item. A map per block of items, stored between blocks: no shuffle."""
    spark, held = docs.sparkSession, None
    for items in item_blocks(benchmark):
        if held is not None:
            docs = store(docs, "decontaminated")
            held.unpersist()
        held = spark.sparkContext.broadcast(Sketches(items, threshold).__dict__)

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sk = Sketches([], threshold)
            sk.__dict__ = held.value
            for batch in batches:
                texts = [encoded(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                keep = np.ones(len(texts), bool)
                for a, b in chunks([len(t) for t in texts]):
                    for d, *_ in sk.found(texts[a:b]):
                        keep[a + d] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], threshold: float = THRESHOLD) -> set[tuple[int, int]]:
    """Every document against every item, for tests."""
    out = set()
    for item_id, text in items:
        w = encoded(text).translate(FOLD).split()
        if not w:
            continue
        whole = shingle_set(w, min(WIDTH, len(w)))
        for doc_id, t in docs:
            if len(whole & shingle_set(encoded(t).translate(FOLD).split(), min(WIDTH, len(w)))) >= threshold * len(whole) - 1e-9:
                out.add((doc_id, item_id))
    return out
