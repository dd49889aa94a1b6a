"""The configuration of a store: which chunker, index, container, retention and delta rules hold."""

from __future__ import annotations

from dataclasses import dataclass

#: Bytes of an index entry: fingerprint and place.
ENTRY = 24


@dataclass(frozen=True)
class DedupConfig:
    """Defaults are those of the month-long lifecycle; ``bits`` is the binary logarithm of the mean chunk."""

    bits: int = 10
    bounded: bool = True  # chunks between a quarter of the mean and eight times the mean
    normalized: bool = False  # a stricter mask below the mean, a looser one above
    index_kind: str = "hash"  # hash | eb | silo
    segment_chunks: int = 16
    eb_representative: str = "first"  # first | min
    container_bytes: int = 256 * 1024
    retention: int = 7
    gc_threshold: float = 0.25
    churn: float | None = None
    min_churn: float = 0.05
    births_per_day: int = 1
    deaths_per_day: int = 1
    fp_bits: int = 0  # 0: whole fingerprints
    fp_verify: bool = True
    delta: bool = False
    delta_pick: str = "index"  # index | recent
    delta_min: int = 256
    delta_targets: int = 4
    delta_min_ratio: float = 0.85
    delta_max_depth: int = 12
    chain_guard: str = "expand"  # expand | off

    def __post_init__(self) -> None:
        if self.fp_bits and not self.fp_verify and self.index_kind != "hash":
            raise ValueError("unverified truncated keys need the hash index: other indexes don't tell chunks apart")

    @property
    def min_size(self) -> int:
        return max(2, (1 << self.bits) >> 2) if self.bounded else 1

    @property
    def max_size(self) -> int | None:
        return (1 << self.bits) * 8 if self.bounded else None

    @property
    def mask_bits(self) -> tuple[int, int]:
        """Below the mean, and from it on."""
        return (min(31, self.bits + 2), max(1, self.bits - 2)) if self.normalized and self.bounded else (self.bits, self.bits)
