"""Content-defined chunk boundaries.

The rolling hash after byte i is h = 2 h + G[byte] mod 2^32, never reset at a cut. Its low n bits depend on the last n bytes only, so
boundary candidates of a whole body are n shifted adds in numpy; only the choice among the (sparse) candidates is sequential.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from chunkloom.config import DedupConfig


@cache
def gear_table() -> np.ndarray:
    """256 pseudo-random 32-bit values from a two-round integer mix of a running state."""
    m, s, out = 0xFFFFFFFF, 0x9E3779B9, []
    for _ in range(256):
        # fixed values: multipliers and offset of the mix
        s = ((s ^ (s >> 16)) * 0x7FEB352D + 0x9E3779B9) & m
        s = (((s ^ (s >> 15)) * 0x846CA68B & m) ^ 0x9E3779B9) & m
        out.append(s)
    return np.array(out, np.uint32)


def rolling(body: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` bits (at most 32) of the rolling hash after each byte."""
    g = gear_table()[body]
    h = g.copy()
    for k in range(1, min(bits, len(g))):
        h[k:] += g[:-k] << np.uint32(k)
    return h & np.uint32((1 << bits) - 1)


def _spans(ends: list[int], n: int) -> list[tuple[int, int]]:
    """(offset, length) from exclusive ends, with what is left at the end."""
    if n and (not ends or ends[-1] < n):
        ends = [*ends, n]
    starts = [0, *ends[:-1]]
    return [(a, b - a) for a, b in zip(starts, ends, strict=False) if b > a]


def probing_spans(body: bytes, bits: int) -> list[tuple[int, int]]:
    """(offset, length) by a table of 128 entries: between a quarter of the mean and four times it, every 16th place is probed first, then each.

    The hash starts anew in each chunk; from the ``bits``-th byte on its low bits don't show it, and no cut stands before a quarter of the mean.
    """
    n, low, high = len(body), (1 << bits) >> 2, (1 << bits) * 4
    if low < bits:
        raise ValueError("a quarter of the mean must hold the hash's window")
    zero = np.concatenate([[False], rolling(np.frombuffer(body, np.uint8) & 0x7F, bits) == 0]) if n else np.zeros(1, bool)
    ends, start = [], 0
    while start < n:
        limit = min(start + high, n)
        far, near = zero[start + low + 16 : limit + 1 : 16], zero[start + low + 1 : limit + 1]
        if far.any():
            limit = start + low + 16 + 16 * int(far.argmax())
        elif near.any():
            limit = start + low + 1 + int(near.argmax())
        ends.append(limit)
        start = limit
    return _spans(ends, n)


def cdc_spans(body: bytes, cfg: DedupConfig) -> list[tuple[int, int]]:
    """(offset, length) of the chunks of ``body``: cut where the masked hash is zero, within the size bounds."""
    n = len(body)
    if not n:
        return []
    arr = np.frombuffer(body, np.uint8)
    hard, easy = cfg.mask_bits
    h = rolling(arr, max(hard, easy))
    below = np.flatnonzero((h & np.uint32((1 << hard) - 1)) == 0)
    if not cfg.bounded:
        return _spans((below + 1).tolist(), n)
    above = below if easy == hard else np.flatnonzero((h & np.uint32((1 << easy) - 1)) == 0)
    mean, low, high = 1 << cfg.bits, cfg.min_size, cfg.max_size
    ends, start = [], 0
    while start < n:
        # size s ends before byte start + s; sizes below the mean use the hard mask
        cut = start + high
        i = np.searchsorted(below, start + low - 1)
        if i < len(below) and below[i] + 1 - start < mean:
            cut = int(below[i]) + 1
        else:
            j = np.searchsorted(above, start + max(low, mean) - 1)
            if j < len(above):
                cut = min(cut, int(above[j]) + 1)
        if cut > n:
            break
        ends.append(cut)
        start = cut
    return _spans(ends, n)


def fixed_spans(body: bytes, size: int) -> list[tuple[int, int]]:
    return [(i, min(size, len(body) - i)) for i in range(0, len(body), size)]


def extremum_spans(body: bytes, window: int) -> list[tuple[int, int]]:
    """Hash-less asymmetric extremum: cut ``window`` bytes behind the first byte that no byte up to there exceeds."""
    ends, start, n = [], 0, len(body)
    while start < n:
        top, at, i = -1, start, start
        while i < n:
            if body[i] > top:
                top, at = body[i], i
            elif i == at + window:
                break
            i += 1
        if i >= n:
            break
        ends.append(i + 1)
        start = i + 1
    return _spans(ends, n)


def maximum_spans(body: bytes, window: int) -> list[tuple[int, int]]:
    """Hash-less local maxima: cut behind each byte that exceeds all of the ``window`` bytes before it and all of those after it."""
    n = len(body)
    if n <= 2 * window:
        return _spans([], n)
    top, width = np.frombuffer(body, np.uint8), 1
    while width < window:  # the maximum of ``width`` bytes from each place on, by doubling
        step = min(width, window - width)
        top, width = np.maximum(top[:-step], top[step:]), width + step
    inner = np.frombuffer(body, np.uint8)[window : n - window]
    peak = (inner > top[: n - 2 * window]) & (inner > top[window + 1 :])
    return _spans((np.flatnonzero(peak) + window + 1).tolist(), n)


class Resumable:
    """The chunker fed piece by piece: it holds back the bytes since the last cut and the few before it that the hash still needs."""

    def __init__(self, cfg: DedupConfig, before: bytes = b"", open_: bytes = b"", offset: int = 0, seq: int = 0):
        self.cfg, self.before, self.open, self.offset, self.seq = cfg, before, open_, offset, seq

    def feed(self, data: bytes, last: bool = False) -> list[tuple[int, int, bytes]]:
        """(seq, offset, bytes) of the chunks that ``data`` completes."""
        self.open += data
        lead = len(self.before)
        h = self.before + self.open
        spans = _after(h, lead, self.cfg)
        done, out = 0, []
        for at, size in spans:
            whole = last or at + size < len(self.open) or _is_cut(h, lead, at, size, self.cfg)
            if not whole:
                break
            out.append((self.seq, self.offset + at, self.open[at : at + size]))
            self.seq += 1
            done = at + size
        self.before = h[max(0, lead + done - 31) : lead + done]
        self.open, self.offset = self.open[done:], self.offset + done
        return out


def _after(h: bytes, lead: int, cfg: DedupConfig) -> list[tuple[int, int]]:
    """Spans of ``h`` behind its first ``lead`` bytes, which are only context for the hash."""
    if not lead:
        return cdc_spans(h, cfg)
    hard, easy = cfg.mask_bits
    arr = np.frombuffer(h, np.uint8)
    r = rolling(arr, max(hard, easy))[lead:]
    n, mean, low, high = len(r), 1 << cfg.bits, cfg.min_size, cfg.max_size or len(r) + 1
    below = np.flatnonzero((r & np.uint32((1 << hard) - 1)) == 0)
    above = np.flatnonzero((r & np.uint32((1 << easy) - 1)) == 0)
    ends, start = [], 0
    while start < n:
        cut = start + high
        i = np.searchsorted(below, start + low - 1)
        if i < len(below) and (not cfg.bounded or below[i] + 1 - start < mean):
            cut = int(below[i]) + 1
        elif cfg.bounded:
            j = np.searchsorted(above, start + max(low, mean) - 1)
            if j < len(above):
                cut = min(cut, int(above[j]) + 1)
        if cut > n:
            break
        ends.append(cut)
        start = cut
    return _spans(ends, n)


def _is_cut(h: bytes, lead: int, at: int, size: int, cfg: DedupConfig) -> bool:
    """Whether the chunk that reaches the end of the data so far ends by rule and not for lack of data."""
    if cfg.max_size and size == cfg.max_size:
        return True
    if size < cfg.min_size:
        return False
    hard, easy = cfg.mask_bits
    bits = hard if size < (1 << cfg.bits) else easy
    r = rolling(np.frombuffer(h, np.uint8)[max(0, lead + at + size - 32) : lead + at + size], bits)
    return bool(r[-1] == 0)
