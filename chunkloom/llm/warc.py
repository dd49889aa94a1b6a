"""WARC archives as seekable Zstandard bundles.

A bundle holds records in independent frames, so any frame decompresses on its own, then a seek table in a skippable frame: the
compressed and decompressed size of each frame and the footer of the Zstandard seekable format. Beside it stands the map from record
to frame and offset within the decompressed frame. Bundles are rows of a table in the shared folder (a lost task's bundle is written
anew under Spark's commit protocol); ``export_bundles`` writes them as .warc.zst files.

Of records with equal payloads of at least ``REVISIT`` bytes the one with the largest page_id is a response, the others revisit it.
Equal payloads are found by SHA-1 over (page_id, digest) only: counted with map-side combining, joined back by digest (a hot digest is
an ordinary skewed join, which adaptive execution splits) and to the payloads by page_id.

A null html is an empty payload; a null page_id comes before all others. Rows that repeat the largest page_id of their payload are all
responses. A null url has no target header. Payloads are written whole, in a frame of their own where they are large. Empty tables
give empty archives. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.shared import store

REVISIT = 1000
#: Uncompressed bytes after which a frame or a bundle is closed.
FRAME_BYTES, BUNDLE_BYTES = 262_144, 8_388_608
#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
NONE = -(2**63)
BUNDLE = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("record_ids", pa.list_(pa.string())), ("frames", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64()))])
BUNDLE_SQL = "bundle string, data binary, record_ids array<string>, frames array<int>, offsets array<long>"
ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
ROWS_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(said: str) -> int | None:
    x = said.removeprefix("<urn:page:").removesuffix(">")
    return None if x == "none" else int(x)


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header, which tells the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int, int]:
    """(headers, payload, its full length as told by HTTP, where the next record begins) of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) for x in lines)
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    cut = block.index(b"\r\n\r\n") + 4
    http = dict(x.split(": ", 1) for x in block[: cut - 4].decode().split("\r\n")[1:])
    return head, block[cut:], int(http["Content-Length"]), end + 8 + len(block)


class Writer:
    """Collects records into frames and frames into a bundle."""

    def __init__(self):
        import zstandard

        self.squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frame, self.held, self.out, self.table, self.total = [], 0, [], [], 0
        self.ids, self.frames, self.offsets = [], [], []

    def add(self, rid: str, record: bytes) -> None:
        if self.held and self.held + len(record) > FRAME_BYTES:
            self.close_frame()
        self.ids.append(rid)
        self.frames.append(len(self.table))
        self.offsets.append(self.held)
        self.frame.append(record)
        self.held += len(record)
        self.total += len(record)

    def close_frame(self) -> None:
        if self.frame:
            z = self.squeeze.compress(b"".join(self.frame))
            self.table.append((len(z), self.held))
            self.out.append(z)
            self.frame, self.held = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join(self.out) + struct.pack("<II", SKIPPABLE, len(entries)) + entries


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, read from the footer."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = len(data) - 9 - n * width, []
    start = 0
    for k in range(n):
        c, d = struct.unpack_from("<II", data, at + k * width)
        out.append((start, c, d))
        start += c
    return out


def frame_of(data: bytes, entry: tuple[int, int, int]) -> bytes:
    import zstandard

    start, c, d = entry
    return zstandard.ZstdDecompressor().decompress(data[start : start + c], max_output_size=d)


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    small = pages.select(F.coalesce("page_id", F.lit(NONE)).alias("_id"), F.sha1(F.col("payload").cast("binary")).alias("_sha"), F.octet_length("payload").alias("_n")).filter(F.col("_n") >= REVISIT)
    kept = small.groupBy("_sha").agg(F.max("_id").alias("_to"), F.count("*").alias("_c")).filter("_c > 1").select("_sha", "_to")
    refs = small.join(kept, "_sha").filter(F.col("_id") < F.col("_to")).select("_id", "_sha", "_to").distinct()
    keyed = pages.withColumn("_id", F.coalesce("page_id", F.lit(NONE))).withColumn("_sha", F.sha1(F.col("payload").cast("binary")))
    return keyed.join(refs.hint("shuffle_hash"), ["_id", "_sha"], "left").select("page_id", "url", "payload", F.col("_to").alias("refers_to"))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, n, w = TaskContext.get().partitionId(), 0, Writer()

    def close():
        return pa.RecordBatch.from_pylist([{"bundle": f"{task:06d}-{n:06d}", "data": w.finish(), "record_ids": w.ids, "frames": w.frames, "offsets": w.offsets}], BUNDLE)

    for batch in batches:
        for page_id, url, payload, to in zip(*(batch.column(k) for k in range(4)), strict=True):
            page_id = page_id.as_py()
            w.add(record_id(page_id), write_record(page_id, url.as_py(), payload.as_py().encode("utf-8", "surrogatepass"), to.as_py()))
            if w.total >= BUNDLE_BYTES:
                yield close()
                n, w = n + 1, Writer()
    if w.ids:
        yield close()


def write_archives(pages: DataFrame) -> DataFrame:
    """bundle, data, record_ids, frames, offsets: the archives of ``pages`` (page_id, url, html), written to the shared folder."""
    return store(marked(pages).mapInArrow(pack, BUNDLE_SQL), "warc")


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            data, frames, offsets = batch.column(1)[k].as_py(), batch.column(3)[k].as_py(), batch.column(4)[k].as_py()
            table, rows, at, raw = seek_table(data), [], -1, b""
            for f, o in zip(frames, offsets, strict=True):
                if f != at:
                    at, raw = f, frame_of(data, table[f])
                head, payload, n, _ = read_record(raw, o)
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                to = head.get("WARC-Refers-To")
                if to is None and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"record {head['WARC-Record-ID']} doesn't match its digest")
                rows.append((page_of(head["WARC-Record-ID"]), n, digest, head["WARC-Type"], None if to is None else page_of(to)))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(ROWS.types)], schema=ROWS)


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; digests of responses are recomputed."""
    return archives.select("bundle", "data", "record_ids", "frames", "offsets").mapInArrow(unpack, ROWS_SQL)


def export_bundles(archives: DataFrame, folder: str) -> None:
    """Write each bundle as ``folder``/<bundle>.warc.zst, ``folder`` being a URI that all executors reach through pyarrow."""

    def put(rows) -> None:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        for row in rows:
            with where.open_output_stream(f"{path}/{row['bundle']}.warc.zst", compression=None) as f:
                f.write(row["data"])

    archives.select("bundle", "data").foreachPartition(put)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS keeper FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN k.keeper > d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keeper > d.page_id THEN k.keeper END AS refers_to
FROM d LEFT JOIN k ON d.digest = k.digest AND d.n >= 1000
"""
