"""Delta compression: which earlier chunk to encode against, what it saves, and the chains it makes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.config import DedupConfig
from chunkloom.functions.codec import apply, encode, parse
from chunkloom.functions.growth import savings
from chunkloom.operators.chunking import slices
from chunkloom.sources.storage import stored


def previous_versions(backups: DataFrame) -> DataFrame:
    """``backups`` (file_id, version) with prev, the version before it that was backed up (an as-of lookup within the file)."""
    return backups.withColumn("prev", F.lag("version").over(Window.partitionBy("file_id").orderBy("version")))


def candidates(chunks: DataFrame, cfg: DedupConfig, only: DataFrame | None = None) -> DataFrame:
    """file_id, version, seq, t_version, t_seq, rank: the chunks of the previous version a chunk (of ``only``, if given) may be encoded against.

    ``index``: those around the same place, from one before it on. ``recent``: the last ones. Both are equi-joins: places are exploded, so
    there is no range join.
    """
    versions = previous_versions(chunks.select("file_id", "version").distinct())
    here = (chunks if only is None else only).select("file_id", "version", "seq").join(versions, ["file_id", "version"]).filter("prev IS NOT NULL")
    there = chunks.select("file_id", F.col("version").alias("prev"), F.col("seq").alias("t_seq"))
    n = cfg.delta_targets
    if cfg.delta_pick == "recent":
        last = there.groupBy("file_id", "prev").agg(F.max("t_seq").alias("end"))
        both = here.join(last, ["file_id", "prev"]).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t_seq", F.col("end") - F.col("rank")).filter("t_seq >= 0")
    else:
        near = here.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t_seq", F.greatest(F.col("seq") - 1, F.lit(0)) + F.col("rank"))
        both = near.join(there, ["file_id", "prev", "t_seq"])
    return both.select("file_id", "version", "seq", F.col("prev").alias("t_version"), F.col("t_seq").cast("int").alias("t_seq"), F.col("rank").cast("int").alias("rank"))


def different(chunks: DataFrame) -> DataFrame:
    """fp, len, version, file_id, seq (where it first occurs, by these) and bytes of each different chunk that isn't empty; rows of ``chunks`` without bytes are met again, never first."""
    at = F.min(F.struct("version", "file_id", "seq")).alias("at")
    return chunks.filter("bytes IS NOT NULL AND len > 0").groupBy("fp").agg(F.max("len").alias("len"), at, F.first("bytes").alias("bytes")).select("fp", "len", "at.*", "bytes")


def first_pairs(places: DataFrame, firsts: DataFrame, cfg: DedupConfig) -> DataFrame:
    """fp, t_fp, rank: what each different chunk may be encoded against where it first occurs. ``places`` has file_id, version, seq, fp, len of every chunk, ``firsts`` is ``different``."""
    big = firsts.filter(F.col("len") >= cfg.delta_min).select("file_id", "version", "seq", "fp")
    target = places.filter("len >= 32").select("file_id", F.col("version").alias("t_version"), F.col("seq").alias("t_seq"), F.col("fp").alias("t_fp"))
    return candidates(places, cfg, big).join(big, ["file_id", "version", "seq"]).join(target, ["file_id", "t_version", "t_seq"]).select("fp", "t_fp", "rank")


def measured(pairs: DataFrame, contents: DataFrame, coders: dict[str, Callable[[bytes, bytes], bytes]]) -> DataFrame:
    """``pairs`` (fp, t_fp and more; different in these two) by each of ``coders``: coder, rec_len and same (the record gives the chunk again), but no record. ``contents`` has fp and bytes, a row for each fp."""
    source, target = contents.select("fp", F.col("bytes").alias("source")), contents.select(F.col("fp").alias("t_fp"), F.col("bytes").alias("target"))
    kept = pairs.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, coder in coders.items():
                rec = [coder(t, s) for t, s in zip(f["target"], f["source"], strict=True)]
                same = [apply(t, r, len(s)) == s for t, s, r in zip(f["target"], f["source"], rec, strict=True)]
                yield f[kept].assign(coder=name, rec_len=list(map(len, rec)), same=same)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", coder string, rec_len long, same boolean"
    return pairs.join(source, "fp").join(target, "t_fp").select(*kept, "target", "source").mapInPandas(run, schema)


def encoded(pairs: DataFrame, chunks: DataFrame, coder: Callable[[bytes, bytes], bytes] = encode) -> DataFrame:
    """Different ``pairs`` (fp, t_fp) with rec_len and record: each chunk's bytes are shuffled once for each pair that it is in."""
    bytes_of = chunks.groupBy("fp").agg(F.first("bytes").alias("bytes"))
    both = pairs.join(bytes_of.select("fp", F.col("bytes").alias("source")), "fp").join(bytes_of.select(F.col("fp").alias("t_fp"), F.col("bytes").alias("target")), "t_fp")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rec = [coder(bytes(t), bytes(s)) for t, s in zip(f["target"], f["source"], strict=True)]
            yield f[["fp", "t_fp"]].assign(rec_len=[len(r) for r in rec], record=rec)

    return both.select("fp", "t_fp", "target", "source").mapInPandas(run, "fp string, t_fp string, rec_len long, record binary")


def best_records(chunks: DataFrame, cfg: DedupConfig, coder: Callable[[bytes, bytes], bytes] = encode) -> DataFrame:
    """For each chunk with bytes and fp: raw_len, rec_len and, where a delta pays, its target and record; the first of equally short ones.

    Eligibility (length, target length) is filtered before any encoding. Encoding is a map over the different (target, source) pairs of
    fingerprints, so what many versions or files have in common is encoded once, and bytes are shuffled once for each different chunk and pair.
    """
    places = chunks.select("file_id", "version", "seq", "fp", "len")
    target = places.filter("len >= 32").select("file_id", F.col("version").alias("t_version"), F.col("seq").alias("t_seq"), F.col("fp").alias("t_fp"))
    big = places.filter(F.col("len") >= cfg.delta_min).select("file_id", "version", "seq", "fp")
    pairs = candidates(places, cfg).join(big, ["file_id", "version", "seq"]).join(target, ["file_id", "t_version", "t_seq"])
    made = encoded(pairs.select("fp", "t_fp").distinct(), chunks, coder)
    best = pairs.join(made, ["fp", "t_fp"]).groupBy("file_id", "version", "seq").agg(F.min_by(F.struct("t_version", "t_seq", "t_fp", "rec_len", "record"), F.struct("rec_len", "rank")).alias("d"))
    out = chunks.select("file_id", "version", "seq", "fp", "len").join(best, ["file_id", "version", "seq"], "left")
    pays = F.col("d.rec_len") < (F.col("len") + 1) * cfg.delta_min_ratio
    kept = [F.when(pays, F.col(f"d.{c}")).alias(c) for c in ("t_version", "t_seq", "t_fp", "record")]
    return out.select("file_id", "version", "seq", "fp", F.col("len").alias("raw_len"), F.col("d").isNotNull().alias("tried"), F.when(pays, F.col("d.rec_len")).otherwise(F.col("len") + 1).alias("rec_len"), *kept)


def growing_savings(files: DataFrame, cfg: DedupConfig, picks: tuple[str, ...]) -> DataFrame:
    """pick, chunks, tries, deltas, raw, stored: what ``best_records`` over all versions comes to for each of ``picks``. ``files`` (body of the last
    version and ends, as ``growing_chunks`` has them) are counted where they are; no chunk, pair or record leaves its task."""
    names = ["chunks", "tries", "deltas", "raw", "stored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [r for body, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in savings(body, [(x["version"], x["end"]) for x in ends], cfg, picks)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names=["pick", *names])

    by_file = files.select("body", "ends").mapInArrow(run, "pick string, " + ", ".join(f"{c} long" for c in names))
    one = by_file.agg(*(F.sum(F.when(F.col("pick") == p, F.col(c))).alias(f"{p}_{c}") for p in picks for c in names))
    counts = lambda p: (F.coalesce(F.col(f"{p}_{c}"), F.lit(0)).alias(c) for c in names[:3])
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("pick"), *counts(p), *(F.col(f"{p}_{c}").alias(c) for c in names[3:])) for p in picks)))
    return one.select(each.alias("x")).select("x.*")


def applied(records: DataFrame, targets: DataFrame) -> DataFrame:
    """file_id, version, seq, bytes of delta records put together with their targets' bytes; null where a record doesn't fit."""
    both = records.filter("record IS NOT NULL").join(targets.select("file_id", F.col("version").alias("t_version"), F.col("seq").alias("t_seq"), F.col("bytes").alias("target")), ["file_id", "t_version", "t_seq"], "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["file_id", "version", "seq"]].assign(bytes=[apply(None if t is None else bytes(t), bytes(r), n) for t, r, n in zip(f["target"], f["record"], f["raw_len"], strict=True)])

    return both.select("file_id", "version", "seq", "raw_len", "record", "target").mapInPandas(run, "file_id long, version long, seq int, bytes binary")


def wrong_records(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row, wrong: how many of ``records`` (fp, t_fp, raw_len, record) don't give the chunk that they stand for. ``chunks`` has fp and bytes."""
    targets = chunks.groupBy(F.col("fp").alias("t_fp")).agg(F.first("bytes").alias("target"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["fp"]].assign(bytes=[apply(bytes(t), bytes(r), n) for t, r, n in zip(f["target"], f["record"], f["raw_len"], strict=True)])

    again = records.join(targets, "t_fp").select("fp", "raw_len", "record", "target").mapInPandas(run, "fp string, bytes binary")
    return again.agg(F.count_if(~F.md5("bytes").eqNullSafe(F.col("fp"))).alias("wrong"))


def record_ops(records: DataFrame) -> DataFrame:
    """A row per operation of each record: op (raw, copy, insert), off and len."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(a, b, c, k, op, off, n) for a, b, c, r in zip(f["file_id"], f["version"], f["seq"], f["record"], strict=True) for k, (op, off, n, _) in enumerate(parse(bytes(r)))]
            yield pd.DataFrame(rows, columns=["file_id", "version", "seq", "k", "op", "off", "len"]).astype({"off": "Int64"})

    return records.filter("record IS NOT NULL").select("file_id", "version", "seq", "record").mapInPandas(run, "file_id long, version long, seq int, k int, op string, off long, len long")


def chain_depths(edges: DataFrame) -> DataFrame:
    """node, depth, root: how many records must be read before the raw one, by pointer jumping over stored tables until no pointer moves.

    ``edges`` has node and target (null for raw). Pointers double in each round. Only what leads to no raw node has no root: null.
    """
    at = stored(edges.select("node", F.col("target").alias("to"), F.when(F.col("target").isNull(), 0).otherwise(1).cast("long").alias("depth")), "pointers")
    nodes, hops = at.count(), 1
    while True:
        step = at.filter("to IS NOT NULL").select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("depth").alias("more"))
        jumped = at.join(step, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("to2").isNotNull().alias("moved"))
        at, hops = stored(jumped, "pointers"), hops * 2
        # in a ring pointers always move, and no chain has more hops than there are nodes
        if hops > nodes or not at.filter("moved").limit(1).count():
            break
    ends = edges.filter("target IS NULL").select(F.col("node").alias("root"))
    return at.select("node", "depth", F.coalesce("to", "node").alias("_r")).join(ends, F.col("_r") == F.col("root"), "left").select("node", "depth", "root")


def broken_links(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Live delta nodes whose target isn't live: what garbage collection would break, or a guard must write raw before."""
    alive = live.select("node").distinct()
    return edges.filter("target IS NOT NULL").join(alive, "node", "left_semi").join(alive.withColumnRenamed("node", "target"), "target", "left_anti").select("node", "target")


def record_store(chunks: DataFrame, cfg: DedupConfig, coder: Callable[[bytes, bytes], bytes] = encode, firsts: DataFrame | None = None) -> DataFrame:
    """fp, raw_len, rec_len, target (fp, null if raw), record (null if raw) and bytes (null if a delta): what a store writes for each different chunk.

    A chunk is written where it first occurs, by (version, file, seq), so a target, which is of an earlier version, is always written
    before what is encoded against it, and no chain returns to itself. Only first occurrences are encoded. ``firsts``: ``different``, if it is stored already.
    """
    firsts = different(chunks) if firsts is None else firsts
    pairs = first_pairs(chunks.select("file_id", "version", "seq", "fp", "len"), firsts, cfg)
    pairs = pairs.groupBy("fp", "t_fp").agg(F.min("rank").alias("rank"))
    made = pairs.join(encoded(pairs.select("fp", "t_fp"), firsts, coder), ["fp", "t_fp"])
    best = made.groupBy("fp").agg(F.min_by(F.struct("t_fp", "rec_len", "record"), F.struct("rec_len", "rank")).alias("d"))
    both, pays = firsts.join(best, "fp", "left"), F.coalesce(F.col("d.rec_len") < (F.col("len") + 1) * cfg.delta_min_ratio, F.lit(False))
    return both.select("fp", F.col("len").alias("raw_len"), F.when(pays, F.col("d.rec_len")).otherwise(F.col("len") + 1).alias("rec_len"), F.when(pays, F.col("d.t_fp")).alias("target"), F.when(pays, F.col("d.record")).alias("record"), F.when(~pays, F.col("bytes")).alias("bytes"))


def decoded(records: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """fp, bytes of the chunks of ``records`` that can be read, or of those in ``wanted`` (fp): level by level, each a join of deltas with the chunks of the level before.

    A chunk is missing where its chain leads to a record that isn't there. Chains have as many levels as versions at most.
    """
    need = records if wanted is None else records.join(chain_of(records, wanted), "fp", "left_semi")
    deltas = stored(need.filter("target IS NOT NULL").select("fp", "target", "raw_len", "record"), "deltas")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"fp": f["fp"], "bytes": [apply(bytes(t), bytes(r), n) for t, r, n in zip(f["bytes"], f["record"], f["raw_len"], strict=True)]})

    level = stored(need.filter("target IS NULL").select("fp", "bytes"), "level")
    done = level
    while True:
        more = deltas.join(level.withColumnRenamed("fp", "target"), "target").select("fp", "bytes", "record", "raw_len")
        level = stored(more.mapInPandas(run, "fp string, bytes binary").filter("bytes IS NOT NULL"), "level")
        if not level.limit(1).count():
            break
        done = done.unionByName(level)
    return done if wanted is None else done.join(wanted.select("fp").distinct(), "fp", "left_semi")


def chain_of(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp of ``wanted`` and of all that their deltas need, to the raw record: liveness closed over the delta graph."""
    edges = stored(records.filter("target IS NOT NULL").select("fp", "target"), "edges")
    front = stored(wanted.select("fp").distinct(), "front")
    closed = front
    while True:
        front = stored(edges.join(front, "fp").select(F.col("target").alias("fp")).distinct().join(closed, "fp", "left_anti"), "front")
        if not front.limit(1).count():
            return closed
        closed = closed.unionByName(front)


def collected(records: DataFrame, live: DataFrame, guard: str) -> tuple[DataFrame, DataFrame]:
    """(the records that a collection leaves, fp and bytes of those it writes raw first) for ``live`` (fp).

    ``off``: what isn't live goes, whoever needs it. ``close``: targets of the living stay. ``expand``: a living delta whose target isn't live is
    read through its chain and written raw, then only the living stay.
    """
    alive = live.select("fp").distinct()
    none = records.select("fp", F.lit(None).cast("binary").alias("bytes")).limit(0)
    if guard == "off":
        return records.join(alive, "fp", "left_semi"), none
    if guard == "close":
        return records.join(chain_of(records, alive), "fp", "left_semi"), none
    if guard != "expand":
        raise ValueError("guard must be off, close or expand")
    kept = records.join(alive, "fp", "left_semi")
    hanging = stored(kept.filter("target IS NOT NULL").join(alive.withColumnRenamed("fp", "target"), "target", "left_anti").select("fp"), "hanging")
    raw = stored(decoded(records, hanging), "rewritten")
    rest = kept.join(hanging, "fp", "left_anti")
    n = F.octet_length("bytes").cast("long")
    again = raw.select("fp", n.alias("raw_len"), (n + 1).alias("rec_len"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("binary").alias("record"), "bytes")
    return rest.unionByName(again), raw
