"""Words and word shingles of many texts at a time, hashed in numpy.

A word is a maximal run of ASCII letters or digits and non-ASCII characters, after lower-casing A-Z.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: ASCII upper case to lower case, every other ASCII non-word byte to a space; bytes of UTF-8 sequences stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U64)


def encoded(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


def chunks(sizes: list[int], most: int = 2_000_000):
    """Slices of consecutive texts of about ``most`` bytes; one longer text makes a slice of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(sizes):
        yield start, len(sizes)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and for each text the place of its first word, with the end appended."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    raw = (b" ".join(texts) + b" " * 9).translate(FOLD)
    arr = np.frombuffer(raw, np.uint8)
    inside = np.empty(len(arr) + 1, np.int8)
    inside[0] = 0
    np.not_equal(arr, 32, out=inside[1:].view(bool))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lanes = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    left = ends - starts
    h = mix(left.astype(U64) + U64(0x9E3779B97F4A7C15))
    at, who = starts, None
    while len(at):
        x = lanes[np.minimum(at, len(lanes) - 1)] & _MASKS[np.minimum(left, 8)]
        if who is None:
            h = mix(h ^ x)
            more = np.flatnonzero(left > 8)
            who = more
        else:
            h[who] = mix(h[who] * U64(0x9FB21C651E98DF25) ^ x)
            more = np.flatnonzero(left > 8)
            who = who[more]
        at, left = at[more] + 8, left[more] - 8
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return h, np.searchsorted(starts, begins)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within each text, and where each text's begin, with the end appended.

    With ``short`` a text of fewer words has one shingle made of all its words; a text without words has none.
    """
    n = np.diff(first)
    if len(words) >= width:
        s = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            s *= U64(0xD6E8FEB86659FD93)
            s += words[k : len(words) - width + 1 + k]
        s = mix(s)
    else:
        s = np.empty(0, U64)
    count = np.maximum(n - width + 1, 0)
    lone = np.flatnonzero((n > 0) & (n < width)) if short else np.empty(0, np.int64)
    total = count.copy()
    total[lone] = 1
    begin = np.concatenate([[0], np.cumsum(total)])
    out = np.empty(begin[-1], U64)
    keep = np.zeros(len(words) + 1, np.int32)
    full = np.flatnonzero(count)
    keep[first[full]] += 1
    np.add.at(keep, first[full] + count[full], -1)
    chosen = s[np.cumsum(keep)[: len(s)] > 0]
    place = np.ones(begin[-1], bool)
    place[begin[lone]] = False
    out[place] = chosen
    for i in lone:
        z = U64(n[i])
        with np.errstate(over="ignore"):
            for w in words[first[i] : first[i + 1]]:
                z = z * U64(0xD6E8FEB86659FD93) + w
        out[begin[i]] = mix(np.array([z]))[0]
    return out, begin
