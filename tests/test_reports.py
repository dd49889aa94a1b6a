"""Functions of the reports, the probing chunker, the gate and positional deltas, on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from chunkloom.functions import bloom, report
from chunkloom.functions.codec import positional
from chunkloom.functions.gear import gear_table, probing_spans


def test_a_day_is_told_by_the_first_outcome_that_holds(spark):
    rows = [
        (0, 10, 9, 5, 0, 0, 0, "first backup"),
        (1, 10, 10, 0, 0, 1, 1, "nothing new"),
        (2, 10, 9, 5, 9, 1, 1, "mostly duplicates"),
        (3, 10, 8, 5, 4, 1, 1, "shortened by deltas"),
        (4, 10, 8, 5, 3, 1, 1, "collected"),
        (5, 10, 8, 5, 0, 0, 1, "expiry and small changes"),
        (6, 10, 8, 5, 0, 0, 0, "ordinary"),
        (7, 0, 0, 5, 0, 0, 0, "ordinary"),
    ]
    d = spark.createDataFrame(rows, "day int, chunks long, dups long, written long, delta long, gc long, expired long, want string")
    got = d.select("want", report.day_sentence(*(F.col(c) for c in d.columns[:7])).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_unit_hash_is_fnv(spark):
    def plain(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        return h % 100000 / 100000

    words = ["", "a", "web", "żółć", "x" * 50]
    d = spark.createDataFrame([(w,) for w in words], "s string")
    assert [r.h for r in d.select(report.unit_hash(F.col("s")).alias("h")).collect()] == [plain(w) for w in words]


def plain_probing(body, bits):
    """Place by place, with a hash that starts anew in each chunk."""
    table, mask, low, high = gear_table().tolist(), (1 << bits) - 1, (1 << bits) >> 2, (1 << bits) * 4
    out, start = [], 0
    while start < len(body):
        limit, h, zero = min(len(body) - start, high), 0, {}
        for k in range(limit):
            h = ((h << 1) + table[body[start + k] & 127]) & 0xFFFFFFFF
            zero[k + 1] = h & mask == 0
        far = [k for k in range(low + 16, limit + 1, 16) if zero[k]]
        near = [k for k in range(low + 1, limit + 1) if zero[k]]
        n = (far or near or [limit])[0]
        out.append((start, n))
        start += n
    return out


@pytest.mark.parametrize("bits", [4, 5, 6, 8])
def test_probing_chunks_match_the_plain_loop(bits):
    r = random.Random(bits)
    for n in (0, 1, 7, 16, 17, 300, 5000):
        body = r.randbytes(n)
        assert probing_spans(body, bits) == plain_probing(body, bits)
    assert probing_spans(b"\0" * 4000, bits) == plain_probing(b"\0" * 4000, bits)


def test_probing_refuses_means_too_small_for_the_window():
    with pytest.raises(ValueError):
        probing_spans(b"abc", 3)


def test_positional_deltas_count_runs():
    assert positional("", "") == (0, 0, 0)
    assert positional("abc", "") == (0, 0, 0)
    assert positional("", "abc") == (0, 1, 3)
    assert positional("abcdef", "abXdef") == (2, 1, 1)
    assert positional("ab", "abcd") == (1, 1, 2)
    assert positional("żółw", "żołw!") == (2, 2, 2)
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 12))) for _ in "xy")
        same = [i < len(a) and a[i] == c for i, c in enumerate(b)]
        runs = [s for i, s in enumerate(same) if not i or s != same[i - 1]]
        assert positional(a, b) == (sum(runs), len(runs) - sum(runs), same.count(False))


@pytest.mark.parametrize("shard", [10, 1 << 18])
def test_the_gate_misses_nothing_that_is_stored(spark, shard):
    store = spark.range(500).select(F.concat(F.lit("k"), "id").alias("fp")).union(spark.createDataFrame([(None,)], "fp string"))
    batch = spark.range(250, 1500).select(F.concat(F.lit("k"), "id").alias("fp")).union(store)
    got = {r.fp: r.maybe for r in bloom.gated(batch, store, "fp", shard).collect()}
    assert set(got) == {f"k{i}" for i in range(1500)} and all(got[f"k{i}"] for i in range(500))
    assert sum(got[f"k{i}"] for i in range(500, 1500)) < 100
    assert bloom.gated(batch.limit(0), store, "fp", shard).count() == 0
    assert not any(r.maybe for r in bloom.gated(batch, store.limit(0), "fp", shard).collect())


def test_file_labels_round_halves_and_keep_nulls_as_sql_does(spark, tmp_path):
    import duckdb

    from chunkloom import catalog

    sizes = [1, 512, 1024, 1535, 1536, 1537, 2560, 3584, 1048575, 1310720, 1835008]
    d = duckdb.connect()
    d.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    d.executemany("INSERT INTO documents VALUES (?, ?, ?, 's')", [(i, "x" * n, "en") for i, n in enumerate(sizes)] + [(99, "no language", None), (None, "no id", "de")])
    d.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    key = lambda r: [str(x) for x in r]
    got = catalog.QUERIES["file_labels"](spark, str(tmp_path))
    want = d.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE['file_labels']})").fetchall()
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
