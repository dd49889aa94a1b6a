"""What deltas save over all versions of a file that only grows, from its last body alone.

A version's chunks are those of the last body up to its own end, and what is left; so versions are counted and not made. Two chunks without
``WINDOW`` equal bytes at an anchor make no copy, and a delta without a copy never pays, so only chunks that have such bytes are encoded.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np

from chunkloom.config import DedupConfig
from chunkloom.functions.codec import STEP, WINDOW, encode
from chunkloom.functions.gear import cdc_spans

#: A shorter target is none.
TARGET_LEAST = 32
#: Any odd numbers: a window is two numbers of eight bytes, mixed into one. Other windows with the same number are encoded in vain, nothing else.
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

Span = tuple[int, int]


class Windows:
    """The places of a body by the WINDOW bytes that begin there; about 40 bytes of memory for each byte of the body."""

    def __init__(self, body: bytes) -> None:
        n = max(0, len(body) - WINDOW + 1)
        if n:
            eight = np.lib.stride_tricks.sliding_window_view(np.frombuffer(body, np.uint8), 8)
            words = np.ascontiguousarray(eight).view(np.uint64).ravel()
            keys = words[:n] * _MIX[0] + words[8:] * _MIX[1]
        else:
            keys = np.empty(0, np.uint64)
        self.order = np.argsort(keys, kind="stable").astype(np.int32 if n < 1 << 31 else np.int64)
        new = np.ones(n, bool)
        inorder = keys[self.order]
        new[1:] = inorder[1:] != inorder[:-1]
        self.first = np.flatnonzero(new)
        self.count = np.diff(self.first, append=n)
        self.ids = np.empty(n, self.order.dtype)
        self.ids[self.order] = np.cumsum(new) - 1

    def like(self, target: Span) -> np.ndarray:
        """The places, in order, whose bytes are those at an anchor of ``target``: no more than there are places."""
        off, n = target
        anchors = np.unique(self.ids[off : max(off, off + n - WINDOW + 1) : STEP])
        count = self.count[anchors]
        skip = np.repeat(self.first[anchors] - np.cumsum(count) + count, count)
        return np.sort(self.order[np.arange(len(skip)) + skip])


def savings(body: bytes, ends: Sequence[tuple[int | None, int]], cfg: DedupConfig, picks: Iterable[str]) -> list[tuple[str, int, int, int, int, int]]:
    """pick, chunks, tries, deltas, raw and stored bytes over all versions of a file; ``ends`` has version and end of each, in order.

    ``index``: what a chunk is encoded against stays the same from version to version but near the end, so each such chunk counts once and is
    added up. ``recent``: the last chunks of the version before are looked up in the whole body.
    """
    whole = cdc_spans(body, cfg)
    stops = [o + n for o, n in whole]
    edges, windows = np.array(stops, np.int64), Windows(body)
    like = lru_cache(64)(windows.like)
    record = lru_cache(1 << 14)(lambda s, t: len(encode(body[t[0] : sum(t)], body[s[0] : sum(s)])))

    def meets(source: Span, target: Span) -> bool:
        places = like(target)
        at = places.searchsorted(source[0])
        return at < len(places) and places[at] + WINDOW <= sum(source)

    def gain(source: Span, best: int | None) -> int:
        """Bytes that the delta saves, 0 if it doesn't pay."""
        raw = source[1] + 1
        return raw - best if best is not None and best < raw * cfg.delta_min_ratio else 0

    def near(k: int, source: Span, there: Sequence[Span], skip: int = 0) -> tuple[int, int, int]:
        """tried, delta and saved of the chunk at place ``k``; ``there``: the chunks of the version before from the place ``skip`` on."""
        at = max(k - 1, 0) - skip
        targets = [t for t in there[at : at + cfg.delta_targets] if t[1] >= TARGET_LEAST]
        if source[1] < cfg.delta_min or not targets:
            return 0, 0, 0
        saved = gain(source, min((record(source, t) for t in targets if meets(source, t)), default=None))
        return 1, int(saved > 0), saved

    # sums over the first k chunks of the last body
    big, steady = [0], [(0, 0, 0)]
    for _, n in whole:
        big.append(big[-1] + (n >= cfg.delta_min))
    chunks, raw, sums = 0, 0, {p: [0, 0, 0] for p in picks}
    before: tuple[int | None, int, list[Span]] | None = None
    for version, end in ends:
        done = bisect_right(stops, end)
        at = stops[done - 1] if done else 0
        rest = [(at, end - at)] if at < end else []
        n = done + len(rest)
        if not n:  # it has no chunks and is the version before of none
            continue
        chunks, raw = chunks + n, raw + end + n
        if before is not None and before[0] is not None:
            _, old, old_rest = before
            for pick, tally in sums.items():
                if pick == "recent":
                    first = max(0, old - cfg.delta_targets)
                    last = [*whole[first:old], *old_rest][-cfg.delta_targets :]
                    targets = [t for t in reversed(last) if t[1] >= TARGET_LEAST]
                    bounds, best = np.append(edges[:done], end), {}
                    for t in targets:
                        places = like(t)
                        places = places[: places.searchsorted(end - WINDOW, "right")]
                        inside = bounds.searchsorted(places, "right")
                        fits = places + WINDOW <= bounds[inside]
                        for k in np.unique(inside[fits]).tolist():
                            source = whole[k] if k < done else rest[0]
                            if source[1] >= cfg.delta_min:
                                size = record(source, t)
                                best[k] = min(size, best.get(k, size))
                    if targets:
                        tally[0] += big[done] + sum(x[1] >= cfg.delta_min for x in rest)
                    for k, size in best.items():
                        saved = gain(whole[k] if k < done else rest[0], size)
                        tally[1] += saved > 0
                        tally[2] += saved
                else:
                    same = min(done, max(0, old - cfg.delta_targets + 2)) if old >= cfg.delta_targets else 0
                    for k in range(len(steady) - 1, same):
                        steady.append(tuple(a + b for a, b in zip(steady[-1], near(k, whole[k], whole), strict=True)))
                    skip = max(0, same - 1)
                    there = [*whole[skip:old], *old_rest]
                    found = [near(k, x, there, skip) for k, x in enumerate([*whole[same:done], *rest], same)]
                    for i in range(3):
                        tally[i] += steady[same][i] + sum(x[i] for x in found)
        before = version, done, rest
    return [(p, chunks, tries, deltas, raw, raw - saved) for p, (tries, deltas, saved) in sums.items()]
