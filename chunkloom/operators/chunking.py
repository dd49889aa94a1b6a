"""From bodies to chunks: one map over files, with nothing but (file, place, fingerprint) leaving it."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.config import DedupConfig
from chunkloom.functions.fingerprint import digest
from chunkloom.functions.gear import cdc_spans, extremum_spans, maximum_spans
from chunkloom.sources.tables import SPAN


def whole_files(files: DataFrame) -> DataFrame:
    """A file as its only chunk."""
    return files.select(*[c for c in files.columns if c != "body"], F.lit(0).alias("seq"), F.lit(0).cast("long").alias("off"), F.octet_length("body").cast("long").alias("len"), digest(F.col("body")).alias("fp"))


def fixed_chunks(files: DataFrame, size: int = 256, keep: bool = False) -> DataFrame:
    """Blocks of ``size`` bytes, with built-in functions only: file columns, seq, off, len, fp, ord, and bytes if ``keep``."""
    n = F.octet_length("body")
    others = [c for c in files.columns if c != "body"]
    pos = F.explode(F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))))
    rows = files.select(*others, "body", pos.alias("seq")).select(*others, "seq", F.substring("body", F.col("seq") * size + 1, F.lit(size)).alias("bytes"))
    out = rows.select(*others, "seq", (F.col("seq").cast("long") * size).alias("off"), F.octet_length("bytes").cast("long").alias("len"), digest(F.col("bytes")).alias("fp"), (F.col("file_id") * SPAN + F.col("seq")).alias("ord"), "bytes")
    return out if keep else out.drop("bytes")


def spans_of(cfg: DedupConfig) -> Callable[[bytes], list[tuple[int, int]]]:
    return lambda body: cdc_spans(body, cfg)


#: Rows of files and bytes of their bodies that Python cuts at a time.
ROWS, BYTES = 500, 1 << 22


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches, whose first column is ``body``, in slices of at most ``ROWS`` rows and about ``BYTES`` of bodies (one row at least): what is held besides a batch doesn't grow with it."""
    for batch in batches:
        size, at = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist(), 0
        while at < batch.num_rows:
            end, held = at + 1, size[at]
            while end < min(at + ROWS, batch.num_rows) and held + size[end] <= BYTES:
                held, end = held + size[end], end + 1
            yield batch.slice(at, end - at)
            at = end


def span_chunks(files: DataFrame, spans: Callable[[bytes], list[tuple[int, int]]], keep: bool = False) -> DataFrame:
    """Chunks by any boundary function, in Arrow batches: file columns, seq, off, len, fp, ord, and bytes if ``keep``."""
    others = [f for f in files.schema.fields if f.name != "body"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["seq int, off long, len long, fp string, ord long"] + ["bytes binary"] * keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bodies, ids = batch.column(0), batch.column(1).to_pylist()
            at, seq, off, size, fp, data = [], [], [], [], [], []
            for i, body in enumerate(bodies):
                body = body.as_py() or b""
                for k, (o, n) in enumerate(spans(body)):
                    part = body[o : o + n]
                    at.append(i)
                    seq.append(k)
                    off.append(o)
                    size.append(n)
                    fp.append(hashlib.md5(part, usedforsecurity=False).hexdigest())
                    if keep:
                        data.append(part)
            taken = [batch.column(1 + k).take(pa.array(at, pa.int64())) for k in range(len(others))]
            new = [pa.array(seq, pa.int32()), pa.array(off, pa.int64()), pa.array(size, pa.int64()), pa.array(fp, pa.string()), pa.array([ids[i] * SPAN + k for i, k in zip(at, seq, strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*taken, *new, *([pa.array(data, pa.binary())] if keep else [])], names=[f.name for f in others] + ["seq", "off", "len", "fp", "ord"] + ["bytes"] * keep)

    first = ["file_id"] + [f.name for f in others if f.name != "file_id"]
    others = [files.schema[c] for c in first]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["seq int, off long, len long, fp string, ord long"] + ["bytes binary"] * keep)
    return files.select("body", *first).mapInArrow(run, schema)


def cdc_chunks(files: DataFrame, cfg: DedupConfig, keep: bool = False) -> DataFrame:
    """Content-defined chunks under ``cfg``."""
    return span_chunks(files, spans_of(cfg), keep)


def growing_chunks(files: DataFrame, cfg: DedupConfig) -> DataFrame:
    """file_id, version, seq, len, fp, bytes of all versions of files that only grow: ``files`` has file_id, body (of the last version) and ends (an array of version and end, in order).

    A chunk's end depends on nothing behind it, so a version has the last one's chunks up to its own end, and what is left. Bytes are null where an earlier version of the file has the same chunk.
    """
    schema = "file_id long, version long, seq int, len long, fp string, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for body, file_id, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = [(o, n, hashlib.md5(body[o : o + n], usedforsecurity=False).hexdigest()) for o, n in cdc_spans(body, cfg)]
                met = set()
                for v in ends:
                    done = bisect_right(whole, v["end"], key=lambda x: x[0] + x[1])
                    mine, o = whole[:done], sum(whole[done - 1][:2]) if done else 0
                    if o < v["end"]:
                        rest = body[o : v["end"]]
                        mine = [*mine, (o, len(rest), hashlib.md5(rest, usedforsecurity=False).hexdigest())]
                    for k, (o, n, fp) in enumerate(mine):
                        rows.append((file_id, v["version"], k, n, fp, None if fp in met else body[o : o + n]))
                        met.add(fp)
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file_id", "version", "seq", "len", "fp", "bytes"])

    return files.select("body", "file_id", "ends").mapInArrow(run, schema)


def ae_chunks(files: DataFrame, window: int = 128) -> DataFrame:
    """Chunks by the asymmetric extremum."""
    return span_chunks(files, lambda body: extremum_spans(body, window))


def peak_chunks(files: DataFrame, window: int = 64) -> DataFrame:
    """Chunks by local maxima."""
    return span_chunks(files, lambda body: maximum_spans(body, window))


def transitions(decided: DataFrame) -> DataFrame:
    """``decided`` (file_id, seq, kind) with recut: a new chunk beside a duplicate, where an edit begins or ends."""
    w = Window.partitionBy("file_id").orderBy("seq")
    beside = F.coalesce(F.lag("kind").over(w) == "dup", F.lit(False)) | F.coalesce(F.lead("kind").over(w) == "dup", F.lit(False))
    return decided.withColumn("recut", (F.col("kind") == "new") & beside)


def recut_chunks(files: DataFrame, spans: DataFrame, small: DedupConfig) -> DataFrame:
    """file_id, off (of the chunk that is cut again), seq, len, fp of the small chunks within each of ``spans`` (file_id, off, len).

    A file's spans (no more than its chunks) meet its body once; only what is cut again becomes a row of bytes.
    """
    wanted = spans.groupBy("file_id").agg(F.collect_list(F.struct("off", "len")).alias("spans"))
    parts = files.select("file_id", "body").join(wanted, "file_id").select("file_id", "body", F.explode("spans").alias("x"))
    bodies = parts.select("file_id", F.col("x.off").alias("at"), F.expr("substring(body, CAST(x.off AS INT) + 1, CAST(x.len AS INT))").alias("body"))
    return cdc_chunks(bodies, small).select("file_id", F.col("at").alias("off"), "seq", "len", "fp")


def hashed_share(len_: Column, min_size: int) -> Column:
    """The share of bytes a chunker must hash if it skips the first ``min_size`` of each chunk (it still hashes the window before a cut)."""
    return F.round(1 - F.sum(F.greatest(F.least(len_, F.lit(min_size)) - 32, F.lit(0))) / F.sum(len_), 6)
