"""Index strategies that see a stream of chunks in order: the whole hash table, Extreme Binning, SiLo.

The last two decide by what they have met before, so a store's stream is an ordered fold, one shard a group (shards are bounded by
``operators.store.STREAM`` files). ``binned`` is the form of Extreme Binning that needs no order: files go to the bin of their
representative and dedup within it. ``segmented`` is SiLo's: segments meet by their least fingerprint, over the whole store.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.config import ENTRY, DedupConfig
from chunkloom.operators.dedup import ratio
from chunkloom.sources.storage import stored


class FullHash:
    """One entry per chunk, one look into memory per chunk."""

    def __init__(self, cfg: DedupConfig):
        self.seen: set[str] = set()

    def begin(self, file_id: int, fps: list[str]) -> None: ...

    def look(self, fp: str) -> tuple[bool, int, int]:
        """(hit, seeks, entries read in sequence)."""
        hit = fp in self.seen
        self.seen.add(fp)
        return hit, 0, 0

    @property
    def entries(self) -> int:
        return len(self.seen)

    @property
    def ram(self) -> int:
        return len(self.seen) * ENTRY


class ExtremeBinning:
    """Memory holds a representative per file; the file's own index is read whole, once, when its representative is met."""

    def __init__(self, cfg: DedupConfig):
        self.by_min = cfg.eb_representative == "min"
        self.owner: dict[str, int] = {}
        self.on_disk: dict[int, set[str]] = {}
        self.met: set[int] = set()

    def begin(self, file_id: int, fps: list[str]) -> None:
        self.file, self.linked, self.waiting = file_id, None, True
        self.rep = min(fps, default=None) if self.by_min else None
        self.met.add(file_id)

    def look(self, fp: str) -> tuple[bool, int, int]:
        own = self.on_disk.setdefault(self.file, set())
        if self.linked is not None:
            hit = fp in self.linked
            if not hit:
                own.add(fp)
            return hit, 0, 0
        if fp in self.owner and (not self.by_min or fp == self.rep):
            self.linked = self.on_disk[self.owner[fp]]
            return True, 1, len(self.linked)
        own.add(fp)
        if self.waiting and (not self.by_min or fp == self.rep):
            self.owner[fp], self.waiting = self.file, False
        return False, 0, 0

    @property
    def entries(self) -> int:
        return len(self.owner)

    @property
    def ram(self) -> int:
        return len(self.met) * ENTRY


class SiLo:
    """Memory holds a representative per segment of missed chunks; a hit on one reads its segment, which stays at hand."""

    def __init__(self, cfg: DedupConfig):
        self.size = max(2, cfg.segment_chunks)
        self.lead: dict[str, list[str]] = {}
        self.last: dict[int, list[str]] = {}

    def begin(self, file_id: int, fps: list[str]) -> None:
        self.file, self.read = file_id, []

    def look(self, fp: str) -> tuple[bool, int, int]:
        current = self.last.get(self.file)
        if (current and fp in current) or fp in self.read:
            return True, 0, 0
        if fp in self.lead:
            self.read = self.lead[fp]
            return True, 1, len(self.read)
        if current is None or len(current) >= self.size:
            current = self.last[self.file] = self.lead[fp] = []
        current.append(fp)
        return False, 0, 0

    @property
    def entries(self) -> int:
        return len(self.lead)

    @property
    def ram(self) -> int:
        return len(self.lead) * ENTRY


STRATEGIES = {"hash": FullHash, "eb": ExtremeBinning, "silo": SiLo}


def replay(frame: pd.DataFrame, cfg: DedupConfig) -> dict:
    """Counters of one shard's stream (file_id, ord, fp, len) under one strategy.

    With ``first`` (the place of a fingerprint's first occurrence in the whole store) what other streams stored before counts as
    stored, so false_neg holds what this stream's index can't see of it; else only the stream counts.
    """
    frame = frame.sort_values("ord")
    first = frame["first"] if "first" in frame else frame.groupby("fp")["ord"].transform("min")
    index = STRATEGIES[cfg.index_kind](cfg)
    whole = cfg.index_kind == "hash"  # one table for all streams
    out = dict.fromkeys(("chunks", "fresh", "dups", "false_neg", "logical", "stored", "disk_reads", "seq_reads", "containers"), 0)
    used = 0
    for file_id, part in frame.assign(known=frame["ord"] > first).groupby("file_id", sort=False):
        fps = part["fp"].tolist()
        index.begin(file_id, fps)
        for fp, n, known in zip(fps, part["len"].tolist(), part["known"].tolist(), strict=True):
            hit, seek, seq = index.look(fp)
            hit = hit or known and whole
            out["chunks"] += 1
            out["logical"] += n
            out["disk_reads"] += seek
            out["seq_reads"] += seq
            if hit and known:
                out["dups"] += 1
                continue
            out["false_neg"] += known  # stored already, and the index didn't see it
            out["fresh"] += 1
            out["stored"] += n
            if not used or used + n > cfg.container_bytes:
                out["containers"], used = out["containers"] + 1, 0
            used += n
    entries, ram = (out["fresh"], out["fresh"] * ENTRY) if whole else (index.entries, index.ram)
    return out | {"ram_reads": out["chunks"], "index_entries": entries, "index_ram": ram}


COLUMNS = "chunks fresh dups false_neg logical stored disk_reads seq_reads containers ram_reads index_entries index_ram".split()


def strategy_totals(chunks: DataFrame, cfg: DedupConfig, shard: str = "shard") -> DataFrame:
    """One row of counters of ``cfg.index_kind`` over all shards of ``chunks``, which may tell ``first``."""
    told = ["first"] * ("first" in chunks.columns)
    fold = chunks.select(shard, "file_id", "ord", "fp", "len", *told).groupBy(shard).applyInPandas(lambda f: pd.DataFrame([replay(f, cfg)])[COLUMNS], ", ".join(f"{c} long" for c in COLUMNS))
    out = fold.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COLUMNS))
    return out.select(F.lit(cfg.index_kind).alias("strategy"), "*", ratio(F.col("logical"), F.col("stored")).alias("ratio"), (F.col("containers") * cfg.container_bytes).alias("container_bytes"))


def representatives(chunks: DataFrame, by_min: bool = False) -> DataFrame:
    """file_id and rep: each file's representative fingerprint, its first or its least."""
    rep = F.min("fp") if by_min else F.min_by("fp", "seq")
    return chunks.groupBy("file_id").agg(rep.alias("rep"))


def binned(chunks: DataFrame, by_min: bool = True) -> DataFrame:
    """Extreme Binning without order: counters of dedup within the bins of equal representatives. No skew but a bin's distinct fingerprints."""
    per = chunks.join(representatives(chunks, by_min), "file_id").groupBy("rep", "fp").agg(F.count("*").alias("n"), F.max("len").alias("len"))
    bins = per.groupBy("rep").agg(F.sum("n").alias("chunks"), F.count("*").alias("fresh"), F.sum(F.col("n") * F.col("len")).alias("logical"), F.sum("len").alias("stored"))
    return bins.agg(F.count("*").alias("bins"), F.sum("chunks").alias("chunks"), F.sum("fresh").alias("fresh"), F.sum("logical").alias("logical"), F.sum("stored").alias("stored")).withColumn("ratio", ratio(F.col("logical"), F.col("stored")))


def segmented(chunks: DataFrame, sizes: list[int]) -> DataFrame:
    """SiLo without order, a row of counters for each segment size: files are cut into segments of so many chunks, and a segment whose least fingerprint
    an earlier one has too (the first one counts) is looked up in that one's block: it and the segments beside it in its file.

    ``chunks`` has file_id, seq, ord, fp and len. A chunk is found if its fingerprint stands earlier in its own segment or in that block; what is found
    is a duplicate, and ``false_neg`` are the duplicates that aren't found. Memory has an entry for each least fingerprint. A segment looks into one block
    at most, so a block that very many segments meet is one row for each of its fingerprints on its side of the join, and copies make no pairs.
    """
    seg = ["size", "file_id", "seg"]
    c = chunks.select("file_id", "seq", "ord", "fp", "len", F.explode(F.array(*map(F.lit, sizes))).alias("size")).withColumn("seg", F.floor(F.col("seq") / F.col("size")).cast("int"))
    w = Window.partitionBy(*seg)  # no more rows than a segment has
    c = c.select(*seg, "ord", "fp", "len", F.min("fp").over(w).alias("rep"), F.min("ord").over(w).alias("begin"), (F.min("ord").over(Window.partitionBy(*seg, "fp")) < F.col("ord")).alias("own"))
    c = stored(c, "segments")
    met = c.select(*seg, "rep", "begin").distinct()
    first = F.min(F.struct("begin", "file_id", "seg")).alias("h")
    heads = met.groupBy("size", "rep").agg(first, F.count("*").alias("segments")).select("size", "rep", "segments", F.col("h.begin").alias("head"), F.col("h.file_id").alias("file_id"), F.col("h.seg").alias("at"))
    heads = stored(heads, "heads")
    beside = heads.filter("segments > 1").select("size", "head", "file_id", F.explode(F.sequence(F.col("at") - 1, F.col("at") + 1)).alias("seg"))
    block = beside.join(c.select(*seg, "fp", "ord"), seg).groupBy("size", "head", "fp").agg(F.min("ord").alias("there"))
    known = chunks.groupBy("fp").agg(F.min("ord").alias("first"))
    looked = c.join(heads.select("size", "rep", "head"), ["size", "rep"]).join(block, ["size", "head", "fp"], "left").join(known, "fp")
    found = F.col("own") | ((F.col("head") != F.col("begin")) & F.coalesce(F.col("there") < F.col("ord"), F.lit(False)))
    dup = F.col("first") < F.col("ord")
    size = lambda x: F.sum(F.when(x, F.col("len")).otherwise(0))
    out = looked.groupBy("size").agg(F.count("*").alias("chunks"), F.count_if(dup).alias("dups"), F.count_if(found).alias("found"), F.count_if(dup & ~found).alias("false_neg"), F.sum("len").alias("logical"), size(~found).alias("stored"))
    index = heads.groupBy("size").agg(F.count("*").alias("entries"), F.sum(F.col("segments") - 1).alias("reads"))
    return out.join(index, "size").select(F.col("size").alias("segment_chunks"), "chunks", "dups", "found", "false_neg", "logical", "stored", ratio(F.col("logical"), F.col("stored")).alias("ratio"), ratio(F.col("found"), F.col("dups")).alias("recall"), "entries", (F.col("entries") * ENTRY).alias("index_ram"), "reads")
