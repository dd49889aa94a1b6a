"""Delta records: a chunk as copies from another chunk and inserted bytes.

Format (fixed values): the first byte of a record is 0x00 for raw bytes or 0x01 for a delta; a delta is a run of 0xC0 offset length
(copy) and 0xA0 length bytes (insert), numbers as LEB128. Matches start at anchors every 8 bytes of the target, found by a hash of 16
bytes, grow both ways, and count from 24 bytes on.

``encode_words`` writes the same format from words instead of anchors: both chunks are cut by their content into words, equal words are found by
hash and confirmed by their bytes, and each match takes in what is equal beside it before the next word is looked up.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from chunkloom.functions.gear import rolling

WINDOW, STEP, LEAST = 16, 8, 24
#: A word is 2^5 bytes on average (the usual 64 would be two words to a chunk of 256 bytes); shorter copies take as many bytes as they save.
WORD_BITS, WORD_LEAST = 5, 8
RAW, DELTA, COPY, INSERT = 0x00, 0x01, 0xC0, 0xA0


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


@lru_cache(64)
def _window_hashes(data: bytes) -> np.ndarray:
    """A hash of each run of WINDOW bytes, by where it begins; a chunk meets several targets one after another."""
    if len(data) < WINDOW:
        return np.empty(0, np.uint32)
    return rolling(np.frombuffer(data, np.uint8), WINDOW)[WINDOW - 1 :]


def _common(a: memoryview, b: memoryview) -> int:
    """Length of the common prefix, found by doubling."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _delta_ops(target: bytes, source: bytes) -> list[tuple[int, int, int]]:
    """(COPY, place in target, length) and (INSERT, place in source, length) that make ``source``."""
    t, s = memoryview(target), memoryview(source)
    anchors: dict[int, int] = {}
    for at, h in zip(range(0, len(target), STEP), _window_hashes(target)[::STEP].tolist(), strict=False):
        anchors.setdefault(h, at)
    hashes, found, ops, open_ = _window_hashes(source), anchors.get, [], 0
    # only places whose hash is an anchor's are looked at
    known = [(i, at) for i, h in enumerate(hashes.tolist()) if (at := found(h)) is not None]
    for i, at in known:
        if i < open_:
            continue
        back = 0
        while back < min(i, at) and source[i - back - 1] == target[at - back - 1]:
            back += 1
        # never into what the last copy made
        back = min(back, i - open_)
        ahead = _common(s[i:], t[at:])
        if ahead < WINDOW or back + ahead < LEAST:
            continue
        if i - back > open_:
            ops.append((INSERT, open_, i - back - open_))
        ops.append((COPY, at - back, back + ahead))
        open_ = i + ahead
    if open_ < len(source):
        ops.append((INSERT, open_, len(source) - open_))
    return ops


def encode(target: bytes, source: bytes) -> bytes:
    """The delta record of ``source`` against ``target``."""
    out = bytearray([DELTA])
    for op, at, n in _delta_ops(target, source):
        out.append(op)
        out += varint(at) + varint(n) if op == COPY else varint(n) + source[at : at + n]
    return bytes(out)


def words(data: bytes, bits: int = WORD_BITS) -> list[tuple[int, int]]:
    """(offset, length) of the words of ``data``: cut where the low ``bits`` bits of the rolling hash are zero, so 2^bits bytes on average."""
    if not data:
        return []
    ends = (np.flatnonzero(rolling(np.frombuffer(data, np.uint8), bits) == 0) + 1).tolist()
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    return [(a, b - a) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode_words(target: bytes, source: bytes, bits: int = WORD_BITS) -> bytes:
    """The delta record of ``source`` against ``target`` by words (the first of equal ones in the target). An edit changes the words it touches and
    where the next begins, no other; a word that a copy has passed isn't looked up. Copies are at least ``WORD_LEAST`` bytes."""
    t, s = memoryview(target), memoryview(source)
    known: dict[bytes, int] = {}
    for at, n in words(target, bits):
        known.setdefault(target[at : at + n], at)
    out, open_ = bytearray([DELTA]), 0

    def insert(to: int) -> None:
        if to > open_:
            out.append(INSERT)
            out.extend(varint(to - open_) + source[open_:to])

    for i, n in words(source, bits):
        if i + n <= open_:
            continue
        at = known.get(source[i : i + n])
        if at is None:
            continue
        # a word that the last copy has begun goes on where that copy ended
        skip = max(0, open_ - i)
        back = 0
        while back < min(i + skip - open_, at + skip) and source[i + skip - back - 1] == target[at + skip - back - 1]:
            back += 1
        ahead = _common(s[i + skip :], t[at + skip :])
        if back + ahead < WORD_LEAST:
            continue
        insert(i + skip - back)
        out.append(COPY)
        out += varint(at + skip - back) + varint(back + ahead)
        open_ = i + skip + ahead
    insert(len(source))
    return bytes(out)


def raw_record(data: bytes) -> bytes:
    return bytes([RAW]) + data


def parse(record: bytes) -> list[tuple[str, int | None, int, bytes | None]]:
    """(op, offset, length, bytes) rows of a record: raw, copy or insert."""
    if not record:
        return []
    if record[0] == RAW:
        return [("raw", None, len(record) - 1, record[1:])]
    at, out = 1, []
    while at < len(record):
        op = record[at]
        at += 1
        if op == COPY:
            off, at = read_varint(record, at)
            n, at = read_varint(record, at)
            out.append(("copy", off, n, None))
        else:
            n, at = read_varint(record, at)
            out.append(("insert", None, n, record[at : at + n]))
            at += n
    return out


def apply(target: bytes | None, record: bytes, length: int) -> bytes | None:
    """The bytes a record stands for, or None where a copy leaves the target or the length is wrong."""
    parts = []
    for op, off, n, data in parse(record):
        if op == "copy":
            if target is None or off + n > len(target):
                return None
            parts.append(target[off : off + n])
        else:
            parts.append(data)
    out = b"".join(parts)
    return out if len(out) == length else None


def first_difference(a: bytes, b: bytes) -> int:
    """Where two bodies differ first (a length counts too), or -1."""
    if a == b:
        return -1
    return _common(memoryview(a), memoryview(b))


def positional(base: str, text: str) -> tuple[int, int, int]:
    """(copies, inserts, literal code points) of a delta that compares code points at the same place only: a run of equal ones is one copy."""
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (base, text))
    same = np.zeros(len(b), bool)
    n = min(len(a), len(b))
    same[:n] = a[:n] == b[:n]
    starts = np.flatnonzero(np.diff(same, prepend=~same[:1]))
    copies = int(same[starts].sum())
    return copies, len(starts) - copies, int((~same).sum())
