"""Deltas by words and resemblance: round trips, brute force over all earlier chunks, hot super-features."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.functions import codec
from chunkloom.operators import delta, resemblance

small = st.binary(max_size=60) | st.lists(st.sampled_from([b"ab", b"the quick brown ", b"\x00" * 9, b"z"]), max_size=40).map(b"".join)


@settings(max_examples=300, deadline=None)
@given(small, small, st.integers(1, 8))
def test_words_round_trip(target, source, bits):
    assert codec.apply(target, codec.encode_words(target, source, bits), len(source)) == source


def test_words_cover_the_data_and_keep_to_their_content():
    r = random.Random(2)
    a = r.randbytes(4000)
    cut = [a[o : o + n] for o, n in codec.words(a)]
    assert b"".join(cut) == a and 20 < 4000 / len(cut) < 48 and codec.words(b"") == []
    again = {(b"new bytes" + a)[o : o + n] for o, n in codec.words(b"new bytes" + a)}
    assert len([w for w in cut if w in again]) >= len(cut) - 2


def test_an_edit_costs_what_it_touches():
    r = random.Random(3)
    a = r.randbytes(5000)
    b = a[:1000] + b"inserted" + a[1000:3000] + a[3100:]
    record = codec.encode_words(a, b)
    assert codec.apply(a, record, len(b)) == b and len(record) < 40
    # nothing in common: the record is an insert
    assert codec.parse(codec.encode_words(b"", b)) == [("insert", None, len(b), b)]


def md5(b):
    return hashlib.md5(b).hexdigest()


def words_of(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) + str(r.randrange(500)) for _ in range(n)).encode()


def family(seed, families=25, members=6):
    """Chunks in families: some bytes replaced, put in or taken out in each member; order is mixed."""
    r, out = random.Random(seed), []
    for _ in range(families):
        base = words_of(r, 40)
        for _ in range(members):
            b = bytearray(base)
            for _ in range(r.randint(0, 2)):
                at = r.randrange(len(b))
                b[at : at + r.choice([0, 4, 12])] = words_of(r, r.choice([0, 1, 2]))
            out.append(bytes(b))
    r.shuffle(out)
    return list(dict.fromkeys(out))


def frame(spark, data):
    return spark.createDataFrame([(md5(b), len(b), bytearray(b), i) for i, b in enumerate(data)], "fp string, len long, bytes binary, pos long")


@pytest.mark.parametrize("coder", [codec.encode, codec.encode_words])
def test_recall_against_all_earlier_chunks(spark, coder):
    """Of the chunks that some earlier chunk would halve at least nine in ten get a base that halves them."""
    data = family(11)
    near = {md5(b) for i, b in enumerate(data) if any(2 * len(coder(a, b)) <= len(b) for a in data[:i])}
    d = frame(spark, data)
    got = {x.fp: x for x in resemblance.bases(d, d, 0.5, coder).collect()}
    place, body = {md5(b): i for i, b in enumerate(data)}, {md5(b): b for b in data}
    assert len(near) > 60 and len(near & set(got)) >= 0.9 * len(near)
    for fp, x in got.items():
        assert place[x.t_fp] < place[fp] and bytes(x.record) == coder(body[x.t_fp], body[fp]) and x.rec_len == len(x.record)


def test_candidates_are_the_first_of_each_bucket(spark):
    data = family(12, 6, 5)
    want, first = {}, {}
    for b in data:
        f = resemblance.features(b)
        for g in range(resemblance.GROUPS):
            key = (g, tuple(f[g * resemblance.EACH : (g + 1) * resemblance.EACH]))
            head = first.setdefault(key, md5(b))
            if head != md5(b):
                want[md5(b), head] = want.get((md5(b), head), 0) + 1
    d = frame(spark, data)
    got = resemblance.candidates(resemblance.super_features(d), d).collect()
    assert {(x.fp, x.t_fp): x.matches for x in got} == want


def test_a_bucket_of_very_many_chunks_gives_a_candidate_each(spark):
    stem = b"the same long beginning of very many chunks, again and again and again and again, " * 3
    data = [stem + b"%05d" % i for i in range(3000)]
    d = frame(spark, data)
    found = resemblance.candidates(resemblance.super_features(d), d)
    assert found.count() <= resemblance.GROUPS * len(data) and found.select("fp").distinct().count() >= 0.95 * len(data)


def test_empty_chunks_and_tables(spark):
    d = frame(spark, [b"", b"x"])
    assert resemblance.features(b"") == [] and resemblance.bases(d, d, 0.5).count() == 0
    none = d.filter("false")
    assert resemblance.bases(none, none, 0.5).count() == 0


def test_wrong_records_are_counted(spark):
    a, b = b"0123456789" * 20, b"0123456789" * 19 + b"something else"
    d = frame(spark, [a, b])
    good = codec.encode_words(a, b)
    rows = [(md5(b), md5(a), len(b), bytearray(good)), (md5(b), md5(a), len(b) + 1, bytearray(good))]
    records = spark.createDataFrame(rows, "fp string, t_fp string, raw_len int, record binary")
    assert delta.wrong_records(records, d).collect()[0].wrong == 1
    assert delta.wrong_records(records.filter(F.col("raw_len") == len(b)), d).collect()[0].wrong == 0
