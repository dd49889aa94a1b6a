"""Scalar functions of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_size(n: Column) -> Column:
    """'1.5 MB', '12 KB' or '17 B'; halves go to the even digit, as in C and SQL (Java's format rounds them up)."""
    mega, kilo = F.bround(n / 1048576.0, 1), F.bround(n / 1024.0, 0)
    return F.when(n >= 1048576, F.concat(F.format_string("%.1f", mega), F.lit(" MB"))).when(n >= 1024, F.concat(F.format_string("%.0f", kilo), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def grouped(n: Column) -> Column:
    """Digits in groups of three."""
    return F.format_number(n, 0)


def nice_maximum(v: Column) -> Column:
    """The next 1, 2, 5 or 10 times a power of ten: where an axis ends."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    m = v / p
    return F.when(v <= 0, F.lit(1.0)).otherwise(F.when(m <= 1, 1.0).when(m <= 2, 2.0).when(m <= 5, 5.0).otherwise(10.0) * p)


def unit_hash(s: Column) -> Column:
    """A number in [0, 1) from a string: FNV-1a over its code points, for colours and sizes that stay the same."""
    # fixed values: offset basis and prime
    basis, prime, m = F.lit(0x811C9DC5).cast("long"), F.lit(0x01000193).cast("long"), F.lit(0xFFFFFFFF).cast("long")
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, basis, lambda h, c: (h.bitwiseXOR(c) * prime).bitwiseAND(m)) % 100000 / 100000.0


def day_sentence(day: Column, chunks: Column, dups: Column, written: Column, delta: Column, gc: Column, expired: Column) -> Column:
    """What a day meant, the first of seven outcomes that holds: counts of chunks, duplicates and deltas, bytes written and collected, copies expired."""
    return (
        F.when(day == 0, "first backup")
        .when(written == 0, "nothing new")
        .when((chunks > 0) & (dups > 0.8 * chunks), "mostly duplicates")
        .when((delta > 0) & (delta * 3 > chunks), "shortened by deltas")
        .when(gc > 0, "collected")
        .when(expired > 0, "expiry and small changes")
        .otherwise("ordinary")
    )


def hex_window(body: Column, at: Column, n: int = 96) -> Column:
    """The ``n`` bytes up to ``at``, in hex."""
    start = F.greatest(at - n + 1, F.lit(0))
    return F.hex(F.substring(body, (start + 1).cast("int"), (at - start + 1).cast("int")))


def mark_key(file_id: Column, day: Column) -> Column:
    """'file@day', for exchange with systems that key recipes so; ``split_key`` is the way back. Null if either is."""
    return F.concat(file_id.cast("string"), F.lit("@"), day.cast("string"))


def split_key(key: Column) -> Column:
    return F.struct(F.split_part(key, F.lit("@"), F.lit(1)).cast("long").alias("file_id"), F.split_part(key, F.lit("@"), F.lit(2)).cast("int").alias("day"))


def bit(h: Column, b: int) -> Column:
    """Bit ``b`` of a hash, as a loupe over a boundary shows it."""
    return F.shiftright(h, b).bitwiseAND(F.lit(1).cast("long"))


def smoothed(values: Column, keep: float = 0.9) -> Column:
    """The exponentially smoothed end of an array of rates, starting at 0."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc * keep + x * (1 - keep))


def padded_range(low: Column, high: Column, pad: float = 0.18) -> Column:
    """Where a small chart's axis begins and ends: the data's range and ``pad`` of it on either side."""
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return F.struct((low - pad * span).alias("low"), (high + pad * span).alias("high"))


def varint_length(n: Column) -> Column:
    """Bytes of a number as LEB128."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def focus_first(file_id: Column, chosen: int) -> list[Column]:
    """Sort keys of a queue that puts a chosen file first."""
    return [(file_id == chosen).desc(), file_id.asc()]
