"""Seeded data: byte pools, files that share content, their new versions and replacements, and shifted pairs.

Generation is a map over file numbers (``spark.range``), so any amount is made in parallel and the same each time. Copies need not see
each other: the shared parts are functions of the seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 4096


@dataclass(frozen=True)
class FileType:
    name: str
    share: float  # of a file that is library blocks
    extension: str
    base: str
    churn: float


# fixed values: profiles of file types
TYPES = (
    FileType("vm", 0.82, "vmdk", "img", 0.02),
    FileType("code", 0.55, "tar", "src", 0.10),
    FileType("logs", 0.30, "log", "app", 0.35),
    FileType("db", 0.70, "sql", "dump", 0.05),
)


def type_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name, t.share, t.extension, t.base, t.churn) for t in TYPES], "type string, share double, ext string, base string, churn double")


def pool(n: int, seed: int) -> bytes:
    """``n`` bytes, half of them printable."""
    rng = np.random.default_rng(seed)
    raw = rng.integers(0, 256, n, np.uint8)
    return np.where(raw & 128, 32 + raw % 95, raw).astype(np.uint8).tobytes()


def library_offsets(length: int, share: float) -> range:
    """Where shared blocks stand in a file."""
    return range(0, max(0, int(length * share) - 1), BLOCK)


def base_body(i: int, length: int, kind: FileType, seed: int, noise: float = 0.0) -> bytes:
    """A file's first content: library blocks, then its own bytes."""
    own = bytearray(pool(length, seed * 1_000_003 + i))
    for at in library_offsets(length, kind.share):
        part = pool(min(BLOCK, length - at), seed * 31 + at // BLOCK % 7)
        own[at : at + len(part)] = part
    if noise:
        rng = np.random.default_rng(seed * 7 + i)
        for at in rng.integers(0, max(1, length), int(length * noise)):
            own[at] = int(rng.integers(0, 256))
    return bytes(own)


def next_version(body: bytes, churn: float, seed: int) -> bytes:
    """One to three edits of random bytes, each a few per cent of the body and 192 bytes at least."""
    rng, out = np.random.default_rng(seed), bytearray(body)
    spots = int(rng.integers(1, 4))
    for _ in range(spots):
        span = min(len(out), max(192, int(len(out) * churn / spots * rng.uniform(0.6, 1.4))))
        at = int(rng.integers(0, max(1, len(out) - span + 1)))
        out[at : at + span] = rng.integers(0, 256, span, np.uint8).tobytes()
    return bytes(out)


def dataset(spark: SparkSession, n: int, kilobytes: int = 48, kind: str = "code", redundancy: float = 0.55, versions: int = 2, seed: int = 12345) -> DataFrame:
    """file_id, name, type, kind (base or copy), version, body, len. The first ``redundancy`` of the files begin as the file before."""
    t = next(x for x in TYPES if x.name == kind)
    length = kilobytes * 1024

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i in frame["id"].tolist():
                copy = i > 0 and i / n < redundancy
                body = base_body(i, length, t, seed)
                if copy:
                    body = base_body(i - 1, length, t, seed)[: length * 3 // 4] + body[length * 3 // 4 :]
                for v in range(versions):
                    if v:
                        body = next_version(body, t.churn, seed * 97 + i * 13 + v)
                    rows.append((i, f"{t.base}-{i + 1:03d}.{t.extension}", t.name, "copy" if copy else "base", v, body, len(body)))
            yield pd.DataFrame(rows, columns=["file_id", "name", "type", "kind", "version", "body", "len"])

    return spark.range(n).mapInPandas(make, "file_id long, name string, type string, kind string, version int, body binary, len long")


def recycled(files: DataFrame, seed: int) -> DataFrame:
    """Fresh content in the places of ``files`` (file_id, type, len): library blocks with a tenth of noise."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_name = {t.name: t for t in TYPES}
        for f in frames:
            yield f.assign(body=[base_body(i + 100_000, n, by_name[k], seed, 0.1) for i, k, n in zip(f["file_id"], f["type"], f["len"], strict=True)])

    return files.select("file_id", "type", "len").mapInPandas(make, "file_id long, type string, len long, body binary")


def shifted_pair(seed: int, kilobytes: int, insert: int) -> tuple[bytes, bytes]:
    """A body, and the same with ``insert`` bytes in front."""
    body = pool(kilobytes * 1024, seed)
    return body, pool(insert, seed + 7919) + body


def spliced(text, at: int, insert: str):
    """A text column with ``insert`` put in before character ``at`` (from 0)."""
    return F.overlay(text, F.lit(insert), F.lit(at + 1), F.lit(0))
