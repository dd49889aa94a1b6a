"""Fingerprints, their truncation, and index buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 1024


def two_lane(data: bytes) -> str:
    """The 64-bit non-cryptographic fingerprint as two 32-bit lanes, for parity; stores use SHA-256 or MD5."""
    # fixed values: offset bases and multipliers of the two lanes
    m, a, b = 0xFFFFFFFF, 0x811C9DC5, 0x01000193
    for x in data:
        a = ((a ^ x) * 0x01000193) & m
        # the second lane mixes in its own state from before the step
        b = ((b ^ x) * 0x85EBCA6B & m) ^ (b >> 13)
    return f"{a}:{b}"


def digest(data: Column) -> Column:
    """The fingerprint column of a binary column."""
    return F.md5(data)


def truncated(fp: Column, bits: int) -> Column:
    """The low ``bits`` bits (at most 60) of a hex fingerprint's first 15 digits, as a number; 0 or over 60 keeps all 60."""
    whole = F.conv(F.substring(fp, 1, 15), 16, 10).cast("long")
    return whole if not bits or bits > 60 else whole.bitwiseAND(F.lit((1 << bits) - 1))


def bucket(fp: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.conv(F.substring(fp, 1, 15), 16, 10).cast("long"), F.lit(buckets))
