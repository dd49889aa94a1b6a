"""Files that only grow: cut once for all versions, bytes once for each file."""

import random
from dataclasses import replace

import pytest

from chunkloom.config import DedupConfig
from chunkloom.operators import chunking, delta
from chunkloom.plans import delta as queries


@pytest.mark.parametrize("cfg", [queries.CFG, DedupConfig(bits=6, normalized=True), DedupConfig(bits=6, bounded=False)])
def test_versions_of_a_growing_file_are_cut_once(spark, cfg):
    r = random.Random(8)
    files, versions = [], []
    for f in range(12):
        body, ends = bytes(r.choice(b"abcdefgh ") for _ in range(r.choice([0, 1, 40, 3000, 9000]))), []
        for v in range(r.randint(1, 8)):
            ends.append((v, len(body) if v > 5 else r.randint(0, len(body))))
        ends = [(v, e) for (v, _), e in zip(ends, sorted(e for _, e in ends))]
        files.append((f, body, ends))
        versions += [(f, v, body[:e]) for v, e in ends]
    got = chunking.growing_chunks(spark.createDataFrame(files, "file_id long, body binary, ends array<struct<version:long,end:long>>"), cfg).collect()
    whole = chunking.cdc_chunks(spark.createDataFrame(versions, "file_id long, version long, body binary"), cfg, keep=True).collect()
    assert sorted((x.file_id, x.version, x.seq, x.len, x.fp) for x in got) == sorted((x.file_id, x.version, x.seq, x.len, x.fp) for x in whole)
    first = {}
    for x in sorted(whole, key=lambda x: (x.file_id, x.version, x.seq)):
        first.setdefault((x.file_id, x.fp), (x.version, bytes(x.bytes)))
    held = [(x.file_id, x.fp, x.version, bytes(x.bytes)) for x in got if x.bytes is not None]
    assert sorted(held) == sorted((*k, *v) for k, v in first.items()) and len(held) < len(whole)


def test_records_of_growing_files_are_those_of_whole_versions(spark, tmp_path):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(300)]
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    turns = [(c, t, None if r.random() < 0.1 else "naïve " * (c % 2) + said(r.randint(1, 150))) for c in range(8) for t in range(r.randint(1, 8))]
    shared = said(90)
    turns += [(c, 0, shared) for c in (20, 21)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = lambda x: (x.fp, x.raw_len, x.rec_len, x.target, x.record, x.bytes)
    once, whole = (delta.record_store(f(spark, str(tmp_path)), queries.CFG) for f in (queries.chunks, queries.whole_chunks))
    once, whole = (sorted(map(row, x.collect()), key=lambda x: x[0]) for x in (once, whole))
    assert once == whole and any(x[3] for x in once)


@pytest.mark.parametrize("cfg", [queries.CFG, DedupConfig(bits=6, bounded=False, delta_min=40, delta_targets=2), DedupConfig(bits=6, delta_min=64, delta_targets=6)])
def test_savings_of_growing_files_are_those_of_all_versions(spark, cfg):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(120)]
    shared = " ".join(r.choice(words) for _ in range(400)).encode()
    files, versions = [], []
    for f in range(16):
        said = [r.choice([b"", b"x", b"ab" * 700, shared, shared[r.randrange(900) :], " ".join(r.choice(words) for _ in range(r.randint(1, 150))).encode()]) for _ in range(r.choice([1, 2, 8, 30]))]
        body = b"\n".join(said)
        ends = [(3 * v, len(b"\n".join(said[: v + 1]))) for v in range(len(said))]
        files.append((f, body, ends))
        versions += [(f, v, body[:e]) for v, e in ends]
    files, versions = spark.createDataFrame(files, "file_id long, body binary, ends array<struct<version:long,end:long>>"), spark.createDataFrame(versions, "file_id long, version long, body binary")
    c = chunking.cdc_chunks(versions, cfg, keep=True)
    got = {x[0]: tuple(x)[1:] for x in delta.growing_savings(files, cfg, ("index", "recent")).collect()}
    for pick in ("index", "recent"):
        records = delta.best_records(c, replace(cfg, delta_pick=pick)).collect()
        assert got[pick] == (len(records), sum(x.tried for x in records), sum(x.t_seq is not None for x in records), sum(x.raw_len + 1 for x in records), sum(x.rec_len for x in records))
        assert 0 < got[pick][2] < got[pick][1] < got[pick][0]


def test_savings_shuffle_no_chunks_and_no_pairs(spark, tmp_path):
    spark.createDataFrame([(c, t, f"{c} said {t} " * 40) for c in range(3) for t in range(6)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.delta_savings(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert [x.pick for x in got.collect()] == ["index", "recent"] and "Join" not in plan and plan.count("mapInArrow") + plan.count("MapInArrow") == 1


def test_savings_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(x) for x in queries.delta_savings(spark, str(tmp_path)).collect()] == [("index", 0, 0, 0, None, None, None), ("recent", 0, 0, 0, None, None, None)]
