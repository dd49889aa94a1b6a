"""Chunkers and the codec against byte loops, and their invariants."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.config import DedupConfig
from chunkloom.functions import codec, fingerprint, gear
from chunkloom.functions.bloom import Bloom
from chunkloom.sources import generate

CONFIGS = [DedupConfig(bits=5), DedupConfig(bits=6, normalized=True), DedupConfig(bits=5, bounded=False), DedupConfig(bits=4)]


def byte_loop(body, cfg):
    table, h, start, out = gear.gear_table().tolist(), 0, 0, []
    hard, easy = cfg.mask_bits
    for i, b in enumerate(body):
        h = (2 * h + table[b]) % 2**32
        size = i - start + 1
        mask = (1 << (hard if size < 1 << cfg.bits else easy)) - 1
        if (size >= cfg.min_size and h & mask == 0) or size == cfg.max_size:
            out.append((start, size))
            start = i + 1
    return [*out, (start, len(body) - start)] if start < len(body) else out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from(CONFIGS))
def test_boundaries_match_a_byte_loop(body, cfg):
    assert gear.cdc_spans(body, cfg) == byte_loop(body, cfg)


@pytest.mark.parametrize("cfg", CONFIGS)
def test_resumed_chunking_equals_whole(cfg):
    r = random.Random(1)
    for _ in range(30):
        body = bytes(r.choice(b"abc ") if r.random() < 0.5 else r.randrange(256) for _ in range(r.randint(0, 4000)))
        c, got, at = gear.Resumable(cfg), [], 0
        while at < len(body):
            n = r.randint(1, 500)
            got += c.feed(body[at : at + n])
            at += n
        got += c.feed(b"", True)
        assert [(o, len(b)) for _, o, b in got] == gear.cdc_spans(body, cfg) and b"".join(b for *_, b in got) == body


def test_sizes_stay_in_bounds():
    cfg = DedupConfig(bits=8)
    body = generate.pool(60_000, 3)
    sizes = [n for _, n in gear.cdc_spans(body, cfg)]
    assert sum(sizes) == len(body) and all(cfg.min_size <= n <= cfg.max_size for n in sizes[:-1])
    assert gear.cdc_spans(b"", cfg) == []
    # constant bytes whose hash never fits are cut at the greatest size
    flat = next(bytes([x]) * 5000 for x in range(256) if not len(gear.cdc_spans(bytes([x]) * 5000, DedupConfig(bits=8, bounded=False))) > 1)
    assert {n for _, n in gear.cdc_spans(flat, cfg)[:-1]} == {cfg.max_size}


def test_masks():
    assert DedupConfig(bits=13, normalized=True).mask_bits == (15, 11)
    assert DedupConfig(bits=1, normalized=True).mask_bits == (3, 1)


def test_normalized_sizes_spread_less():
    body = generate.pool(400_000, 5)
    spread = {}
    for nc in (False, True):
        n = sorted(x for _, x in gear.cdc_spans(body, DedupConfig(bits=10, normalized=nc)))
        spread[nc] = n[int(len(n) * 0.95)] - n[int(len(n) * 0.05)]
        assert 0.6 * 1024 < sum(n) / len(n) < 1.6 * 1024
    assert spread[True] <= 0.75 * spread[False]


@pytest.mark.parametrize("insert", [0, 137, 1024])
def test_shifted_copies_are_found_again(insert):
    a, b = generate.shifted_pair(1, 64, insert)
    cfg = DedupConfig(bits=9)
    have = {a[o : o + n] for o, n in gear.cdc_spans(a, cfg)}
    part = sum(n for o, n in gear.cdc_spans(b, cfg) if b[o : o + n] in have) / len(b)
    assert part == 1.0 if not insert else part > 0.9
    fixed = {a[o : o + n] for o, n in gear.fixed_spans(a, 512)}
    if insert % 512:
        assert sum(n for o, n in gear.fixed_spans(b, 512) if b[o : o + n] in fixed) < 0.05 * len(b)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=2000), st.integers(1, 64))
def test_extremum_chunks(body, window):
    spans = gear.extremum_spans(body, window)
    assert b"".join(body[o : o + n] for o, n in spans) == body and all(n > window for _, n in spans[:-1])


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=600), st.binary(max_size=600), st.integers(0, 600))
def test_delta_round_trip(target, other, cut):
    source = target[:cut] + other + target[cut:]
    for t in (target, b"", other):
        record = codec.encode(t, source)
        assert codec.apply(t, record, len(source)) == source
    assert codec.apply(None, codec.raw_record(source), len(source)) == source
    assert codec.apply(target, codec.encode(target, source), len(source) + 1) is None


def test_delta_is_small_for_small_edits():
    body = generate.pool(4096, 2)
    edited = body[:1000] + b"edit" + body[1000:]
    assert len(codec.encode(body, edited)) < 60 and len(codec.encode(generate.pool(4096, 9), edited)) > len(edited)
    assert codec.apply(body[:10], codec.encode(body, edited), len(edited)) is None  # copies beyond the target
    assert [op for op, *_ in codec.parse(codec.encode(body, edited))] == ["copy", "insert", "copy"]


@given(st.integers(0, 2**40))
def test_varint(n):
    assert codec.read_varint(codec.varint(n), 0) == (n, len(codec.varint(n)))


def test_two_lane_fingerprint():
    assert fingerprint.two_lane(b"") == f"{0x811C9DC5}:{0x01000193}" != fingerprint.two_lane(b"hello")


def test_first_difference():
    assert codec.first_difference(b"abc", b"abc") == -1 and codec.first_difference(b"abc", b"abd") == 2 and codec.first_difference(b"ab", b"abc") == 2


def test_bloom_has_no_false_negative():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)
    f = Bloom(1 << 17)
    f.add(a)
    assert f.has(a).all() and f.has(b).mean() < 0.02


def test_unverified_keys_need_the_hash_index():
    with pytest.raises(ValueError):
        DedupConfig(fp_bits=8, fp_verify=False, index_kind="eb")
