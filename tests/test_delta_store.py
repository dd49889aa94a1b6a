"""Stored delta records, reading through chains, collections with and without a guard: against plain Python on the same chunks."""

import hashlib
import random

import pytest

from chunkloom.config import DedupConfig
from chunkloom.functions import codec
from chunkloom.operators import delta
from chunkloom.plans import delta as queries

CFG = DedupConfig(bits=8, delta=True, delta_min=64)


def md5(b):
    return hashlib.md5(b).hexdigest()


def versions(seed=3, files=5, days=9):
    """file, version, chunks: each day some bytes of some chunks change; the hot file's chunks are in every file."""
    r = random.Random(seed)
    hot = bytes(r.randrange(256) for _ in range(200))
    out = []
    for f in range(files):
        parts = [bytes(r.randrange(256) for _ in range(r.choice([20, 150, 260]))) for _ in range(3)] + [hot]
        for v in range(days):
            if v:
                k = r.randrange(3)
                b = bytearray(parts[k])
                b[r.randrange(len(b))] ^= 0xFF
                parts[k] = bytes(b) + bytes([v])
            out.append((f, v, list(parts)))
    return out


def rows(data):
    return [(f, v, i, md5(b), len(b), b) for f, v, parts in data for i, b in enumerate(parts)]


def plain_records(data):
    """fp to (target fp or None, record or bytes), each written where it first occurs by (version, file, place)."""
    at = {(f, v): parts for f, v, parts in data}
    store = {}
    for f, v, parts in sorted(data, key=lambda x: (x[1], x[0])):
        for i, b in enumerate(parts):
            if md5(b) in store:
                continue
            best = None
            before = at.get((f, v - 1))
            if before and len(b) >= CFG.delta_min:
                for rank in range(CFG.delta_targets):
                    k = max(i - 1, 0) + rank
                    if k < len(before) and len(before[k]) >= 32:
                        rec = codec.encode(before[k], b)
                        if best is None or (len(rec), rank) < best[:2]:
                            best = (len(rec), rank, md5(before[k]), rec)
            pays = best and best[0] < (len(b) + 1) * CFG.delta_min_ratio
            store[md5(b)] = (best[2], best[3], len(b)) if pays else (None, b, len(b))
    return store


def plain_read(store, fp):
    if fp not in store:
        return None
    target, data, n = store[fp]
    if target is None:
        return data
    base = plain_read(store, target)
    return None if base is None else codec.apply(base, data, n)


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(rows(versions()), "file_id long, version long, seq int, fp string, len long, bytes binary")


def kept(df):
    return {x.fp: (x.target, bytes(x.record if x.target else x.bytes), x.raw_len) for x in df.collect()}


def test_records_and_reading_through_chains(chunks):
    store = plain_records(versions())
    records = delta.record_store(chunks, CFG)
    assert kept(records) == store and sum(t is not None for t, *_ in store.values()) > 20
    got = {x.fp: bytes(x.bytes) for x in delta.decoded(records).collect()}
    assert got == {fp: plain_read(store, fp) for fp in store} and all(md5(b) == fp for fp, b in got.items())
    deep = max(store, key=lambda fp: len(chain(store, fp)))
    assert len(chain(store, deep)) > 4
    one = records.sparkSession.createDataFrame([(deep,), ("nowhere",)], "fp string")
    assert [x.fp for x in delta.decoded(records, one).collect()] == [deep]
    assert {x.fp for x in delta.chain_of(records, one).collect()} == {*chain(store, deep), "nowhere"}


def chain(store, fp):
    out = [fp]
    while store[out[-1]][0] is not None:
        out.append(store[out[-1]][0])
    return out


@pytest.mark.parametrize("guard", ["off", "close", "expand"])
def test_a_forced_collection(spark, chunks, guard):
    data = versions()
    store, live = plain_records(data), {md5(b) for _, v, parts in data if v >= 7 for b in parts}
    left, raw = delta.collected(delta.record_store(chunks, CFG), chunks.filter("version >= 7").select("fp"), guard)
    got, rewritten = kept(left), {x.fp: bytes(x.bytes) for x in raw.collect()}
    hanging = {fp for fp in live if store[fp][0] is not None and store[fp][0] not in live}
    if guard == "close":
        want = {fp: store[fp] for x in live for fp in chain(store, x)}
    else:
        want = {fp: store[fp] for fp in live}
        if guard == "expand":
            want |= {fp: (None, plain_read(store, fp), store[fp][2]) for fp in hanging}
    assert got == want and set(rewritten) == (hanging if guard == "expand" else set())
    read = {x.fp: bytes(x.bytes) for x in delta.decoded(left).collect()}
    assert {fp for fp in live if read.get(fp) is None} == {fp for fp in live if plain_read(got, fp) is None}
    assert (live <= set(read)) == (guard != "off") and hanging


def test_a_collection_of_nothing(spark, chunks):
    records = delta.record_store(chunks, CFG)
    for guard in ("off", "close", "expand"):
        assert delta.collected(records, chunks.limit(0).select("fp"), guard)[0].count() == 0
    with pytest.raises(ValueError):
        delta.collected(records, chunks.select("fp"), "maybe")
    assert delta.record_store(chunks.limit(0), CFG).count() == 0 and delta.decoded(records.limit(0)).count() == 0


def test_no_version_is_lost_behind_a_guard(spark, monkeypatch, chunks):
    monkeypatch.setattr(queries, "chunks", lambda spark, sf_dir: chunks)
    got = {x.guard: x for x in queries.collection_guards(spark, "").collect()}
    assert got["off"].lost_versions > 0 == got["close"].lost_versions == got["expand"].lost_versions
    assert got["expand"].rewritten > 0 and got["off"].records == got["expand"].records < got["close"].records
    assert {x.versions for x in got.values()} == {15} and all(x.dropped + x.records == chunks.select("fp").distinct().count() for x in got.values())


def test_a_chunk_is_hashed_once_for_all_its_targets(monkeypatch):
    r = random.Random(4)
    source = bytes(r.randrange(256) for _ in range(300))
    targets = [source[:k] + b"?" + source[k + 1 :] for k in (10, 100, 150, 290)]
    codec._window_hashes.cache_clear()
    calls, real = [], codec.rolling
    monkeypatch.setattr(codec, "rolling", lambda data, bits: calls.append(bytes(data)) or real(data, bits))
    assert all(codec.apply(t, codec.encode(t, source), len(source)) == source for t in targets)
    assert calls.count(source) == 1 and len(calls) == 5
