"""Line dedup, WARC, quality, fingerprints, near-duplicates: against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from chunkloom.llm import fingerprints, lines, neardup, quality, warc
from chunkloom.llm.words import encoded

from .conftest import DOCS, doc, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_line_dedup(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    last = 2**63  # an id behind all others
    owners = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                owners[key(line)].add(last if d is None else d)
    out = []
    for d, t in rows:
        all_ = (t or "").split("\n")
        keep = [x for x in all_ if not (len(key(x)) >= 10 and len(owners[key(x)]) > 1 and min(owners[key(x)]) != (last if d is None else d))]
        out.append((d, len(all_), len(all_) - len(keep), sha("\n".join(keep))))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_line_dedup_matches_plain_python(spark, awkward, empty, awkward_rows):
    r = random.Random(2)
    pool = [words(100 + i, 4) for i in range(40)] + ["short", "", "  ", "\t" + words(100, 4).upper() + " \r"]
    rows = [doc(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12)))) for i in range(80)] + awkward_rows
    rows += [doc(2**63 - 1, "a line of the last id and of none\nx"), doc(None, "A line of the last id and of none"), doc(None, "a line of the null id twice\na line of the null id twice")]
    rows += [doc(None, "one line for null\nand the null id again and again"), doc(None, "and the null id again and again"), doc(-(2**63), "a line of the last id and of none")]
    got = [tuple(x) for x in lines.line_digest(spark.createDataFrame(rows, DOCS)).collect()]
    assert order(got) == order(plain_line_dedup([(x[0], x[1]) for x in rows]))
    assert lines.line_digest(empty).count() == 0
    out = lines.line_dedup(awkward)
    assert out.columns == awkward.columns and out.count() == len(awkward_rows)
    assert all(x.n_chars == len(x.text) and x._did == 7 and x.row == "r" for x in out.collect())


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        h1, h2 = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, n).astype(np.uint64)
        at = lines.PerfectHash.build(h1, h2).slots(h1, h2)
        assert sorted(at.tolist()) == list(range(n))


def test_shards_smaller_than_the_data(spark, monkeypatch, awkward_rows):
    monkeypatch.setattr(lines, "SHARD", 3)
    rows = awkward_rows + [doc(100 + i, "a very common line\n" + words(i, 5)) for i in range(300)]
    rows += [doc(2**63 - 1, "a line of the last id and of none\nx"), doc(None, "A line of the last id and of none"), doc(None, "a line of the null id twice\na line of the null id twice")]
    rows += [doc(None, "one line for null\nand the null id again and again"), doc(None, "and the null id again and again"), doc(-(2**63), "a line of the last id and of none")]
    got = [tuple(x) for x in lines.line_digest(spark.createDataFrame(rows, DOCS)).collect()]
    assert order(got) == order(plain_line_dedup([(x[0], x[1]) for x in rows]))


PAGES = "page_id long, url string, html string, _id long, _sha string, bundle string"


def page_rows():
    a, b = "<p>" + words(1, 300), "<p>" + words(2, 400)
    return [(1, "http://a/ b\r\nc", a, 1, "", ""), (2, None, a, 1, "", ""), (5, "u", a, 1, "", ""), (3, "u", b, 1, "", ""), (3, "u", b, 1, "", ""), (4, "u", "tiny", 1, "", ""), (6, "u", "tiny", 1, "", ""), (7, "u", None, 1, "", ""), (8, "u", "", 1, "", ""), (None, "u", b, 1, "", ""), (9, "u", "é" * 400_000, 1, "", ""), (10, "é", "x\r\n\r\nWARC/1.1\r\n", 1, "", "")]


def test_archives_round_trip(spark, tmp_path):
    rows = page_rows()
    df = spark.createDataFrame(rows, PAGES)
    archives = warc.write_archives(df)
    got = [tuple(x) for x in warc.read_archives(archives).collect()]
    keeper = defaultdict(lambda: -1)
    for p, _, h, *_ in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000:
            keeper[raw] = max(keeper[raw], -1 if p is None else p)
    want = []
    for p, _, h, *_ in rows:
        raw = (h or "").encode()
        k = keeper.get(raw)
        again = k is not None and (-1 if p is None else p) < k
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", k if again else None))
    assert order(got) == order(want)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    warc.export_bundles(archives, f"file://{tmp_path}")
    # a single record by its frame and offset, from the file
    row = archives.collect()[0]
    data = (tmp_path / f"{row.bundle}.warc.zst").read_bytes()
    assert data == bytes(row.data)
    table = warc.seek_table(data)
    for rid, f, o in zip(row.record_ids, row.frames, row.offsets, strict=True):
        head, *_ = warc.read_record(warc.frame_of(data, table[f]), o)
        assert head["WARC-Record-ID"] == rid
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == len(row.record_ids)


def test_a_damaged_payload_is_noticed():
    record = warc.write_record(1, "u", b"hello", None)
    w = warc.Writer()
    w.add("<urn:page:1>", record.replace(b"hello", b"jello"))
    import pyarrow as pa

    data = w.finish()
    batch = pa.RecordBatch.from_pylist([{"bundle": "b", "data": data, "record_ids": w.ids, "frames": w.frames, "offsets": w.offsets}], warc.BUNDLE)
    with pytest.raises(ValueError, match="digest"):
        list(warc.unpack([batch]))


def quality_rows():
    r = random.Random(1)
    known = words(1, 80).split()
    good = [doc(i, " ".join(r.choice(known) for _ in range(60)), "en" if i % 2 else "de") for i in range(60)]
    bad = [doc(100 + i, "".join(chr(33 + (i * 7 + j * 13) % 90) for j in range(300))) for i in range(10)]
    return good + bad


@pytest.mark.parametrize("bound", [quality.TRUSTED, 0])
def test_perplexities_match_the_recursive_definition(spark, awkward_rows, bound):
    rows = quality_rows() + awkward_rows
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(41, 0, 0), (42, 1, 1), (None, 1, 0), (43, None, None)], "doc_id long, quality int, toxic int")
    counts = quality.gram_counts(docs, labels, bound)
    got = sorted((x.doc_id is None, x.doc_id or 0, math.exp(x.nats) if x.nats is not None else -1.0) for x in quality.perplexities(docs, counts).collect())
    trusted = [encoded(r[1]) for r in rows if r[0] is not None and r[0] < 40 and r[1]]
    few = [(r[0], encoded(r[1])) for r in rows if len(r[1] or "") < 5000]
    want = sorted((d is None, d or 0, p if p == p else -1.0) for (d, _), p in zip(few, quality.brute_force([t for _, t in few], trusted), strict=True))
    got = [g for g in got if g[1] != 10 or g[0]]
    want = [w for w in want if w[1] != 10 or w[0]]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-3)


def test_quality_keeps_good_and_drops_bad(spark, awkward, empty):
    r = random.Random(1)
    known = words(1, 25).split()
    good = [doc(i, " ".join(r.choice(known) for _ in range(60)), "en" if i % 2 else "de") for i in range(400)]
    bad = [doc(1000 + i, "".join(chr(33 + (i * 7 + j * 13) % 90) for j in range(300))) for i in range(10)]
    docs = spark.createDataFrame(good + bad, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.keep for x in quality.quality(docs, labels).collect()}
    assert sum(got[i] for i in range(300)) >= 297 and sum(got[i] for i in range(300, 400)) >= 95 and not any(got[1000 + i] for i in range(10))
    none = quality.quality(awkward, labels.limit(0)).collect()
    assert {(x.keep, x.perplexity) for x in none if x.doc_id in (6, 7)} == {(False, None)} and all(x.keep for x in none if x.doc_id == 1)
    assert quality.quality(empty, labels).count() == 0


def plain_quality(rows, labels):
    """Thresholds and decisions from the recursive definition's perplexities."""
    good = {d for d, q, t in labels if d is not None and q == 1 and not t}
    trusted = [encoded(t) for d, t, _ in rows if d in good and t]
    nats = [math.log(p) if p == p else None for p in quality.brute_force([encoded(t) for _, t, _ in rows], trusted)]
    known = [(lang, round(n, 3)) for (d, _, lang), n in zip(rows, nats, strict=True) if d in good and n is not None]
    limit = lambda x: sorted(x)[math.ceil(len(x) * quality.QUANTILE) - 1] + quality.MARGIN
    own = {lang: limit([n for k, n in known if k == lang]) for lang in {k for k, _ in known}}
    return [(d, lang, own.get(lang, limit([n for _, n in known])), n) for (d, _, lang), n in zip(rows, nats, strict=True)]


def test_thresholds_and_decisions_match_plain_python(spark):
    """Null and empty languages apart, trusted texts that are null or empty, repeated rows and ids, a language without trusted texts."""
    r = random.Random(8)
    pools = {k: words(20 + i, 30).split() for i, k in enumerate(["en", None, "", "xx"])}
    rows = [(i, " ".join(r.choice(pools[lang]) for _ in range(r.randint(3, 25))), lang) for i in range(120) for lang in [("en", None, "", "xx")[i % 4]]]
    rows += [(200 + i, t, lang) for i, (t, lang) in enumerate([(None, "en"), ("", "en"), (None, None), ("", ""), ("?" * 40, None), ("?" * 40, "")] * 5)] + rows[:8]
    labels = [(i, 1, 0) for i in range(230) if i % 4 != 3] + [(None, 1, 0), (5, 1, 0)]
    docs = spark.createDataFrame([doc(*x) for x in rows], DOCS)
    got = quality.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    key = lambda d, lang, p: (d, str(lang), lang is None, round(p or 0.0, 2))
    found = sorted((*key(x.doc_id, x.lang, x.perplexity), x.threshold, x.keep) for x in got)
    want = sorted((*key(d, lang, n and math.exp(n)), math.exp(limit), n) for d, lang, limit, n in plain_quality(rows, labels))
    assert len(found) == len(want) and len({f[4] for f in found}) >= 3
    for f, w in zip(found, want, strict=True):
        assert f[:3] == w[:3] and abs(f[4] - w[4]) <= 0.003 * w[4]
        if w[5] is None:
            assert f[3:6:2] == (0.0, False)
        elif abs(math.exp(w[5]) - w[4]) > 0.01 * w[4]:
            assert f[5] == (math.exp(w[5]) <= w[4])


def multiset_similarity(a, b):
    a, b = Counter(WORD.findall(a.lower())), Counter(WORD.findall(b.lower()))
    return sum((a & b).values()) / (sum((a | b).values()) or 1) if a or b else 1.0


def test_fingerprints_estimate_generalised_jaccard(spark, awkward, empty, awkward_rows):
    r = random.Random(4)
    base = [f"w{i}" for i in range(50)]
    rows = [(i * 3, " ".join(r.choice(base[: r.randint(2, 50)]) for _ in range(r.randint(1, 80)))) for i in range(600)] + [(5000, ""), (5001, None), (5002, "!!")]
    got = {x.doc_id: x for x in fingerprints.fingerprint_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort(reverse=True)
    texts = [t or "" for _, t in rows]
    off, off_next = [], []
    for i, (d, _) in enumerate(rows):
        t, nxt = texts[i], texts[(i + 1) % len(rows)]
        k = len(t) // 3
        edit = t[: len(t) - k] + nxt[:k]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == sha(edit)
        off.append(got[d].near_edited - multiset_similarity(t, edit))
        off_next.append(got[d].near_next - multiset_similarity(t, nxt))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.09 and abs(np.mean(off_next)) < 0.01 and np.std(off_next) < 0.09
    assert got[5000].fingerprint == got[5001].fingerprint == got[5002].fingerprint and got[5002].near_next == 1.0
    out = fingerprints.fingerprint_digest(awkward).collect()
    assert len(out) == len(awkward_rows) and len({x.fingerprint for x in out if x.doc_id in (1, 2)}) == 1
    assert fingerprints.fingerprint_digest(empty).count() == 0
    one = fingerprints.fingerprint_digest(awkward.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_of_any_ids_equal_plain_python(spark, monkeypatch):
    """64-bit, negative, null, repeated and lone outlying ids: fingerprints sample by sample, edited texts, and ranges of about equal size."""
    monkeypatch.setattr(fingerprints, "RANGE", 16)
    r = random.Random(3)
    ids = [-(2**63), -(2**62), 2**63 - 1, None, None, 0, 5, 5] + [r.randrange(-(2**63), 2**63) for _ in range(150)] + list(range(1000, 1200))
    rows = [(d, " ".join(r.choice("abcdef Gh É ö w1 w2".split()) for _ in range(r.randint(0, 12)))) for d in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fingerprints.fingerprint_digest(df).collect()
    ours = Counter((x.doc_id, x.n_chars, x.fingerprint) for x in out)
    assert ours == Counter((d, len(t), fingerprints.brute_force(t)) for d, t in rows)
    got, times = {x.doc_id: x for x in out}, Counter(ids)
    falling = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    for k, (d, t) in enumerate(falling):
        n, nxt = falling[(k + 1) % len(falling)]
        if times[d] == times[n] == 1:
            assert got[d].edited_sha256 == sha(t[: len(t) - len(t) // 3] + nxt[: len(t) // 3])
    sizes = fingerprints.ordered(df).groupBy(fingerprints.range_of(fingerprints.bounds(fingerprints.ordered(df))).alias("p")).count().collect()
    assert max(x["count"] for x in sizes) <= 32


def test_fingerprints_use_no_python(spark, awkward):
    plan = fingerprints.fingerprint_digest(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def near_rows():
    r = random.Random(9)
    rows, i = [], 0
    for g in range(25):
        base = words(1000 + g, r.choice([6, 20, 80, 200])).split()
        for _ in range(r.randint(1, 6)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                t[r.randrange(len(t))] = f"e{r.randrange(9)}"
            rows.append((i, " ".join(t)))
            i += 1
    return rows


def near_found(spark, rows):
    return {x.doc_id: x.class_id for x in neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}


@pytest.mark.parametrize("common", [neardup.COMMON, 2])
def test_near_classes_match_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(neardup, "COMMON", common)
    monkeypatch.setattr(neardup, "BLOCK", 3000)  # several blocks a task
    rows = near_rows()
    assert near_found(spark, rows) == neardup.brute_force(rows)


def test_large_groups_match_brute_force(spark):
    """Two groups of over 200 loosely and closely similar versions of texts that are like each other, and others: no link is lost."""
    r = random.Random(12)
    base = words(77, 90).split()
    other = base[:66] + words(78, 24).split()
    rows = [(i, words(5000 + i, 60)) for i in range(200)]
    for i in range(430):
        t = list(base if i % 2 else other)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 3, 4])):
            t[r.randrange(len(t))] = f"e{r.randrange(40)}"
        rows.append((1000 + i, " ".join(t)))
    assert near_found(spark, rows) == neardup.brute_force(rows)


def test_chains_in_one_bucket_stay_whole(spark, monkeypatch):
    """Six families of drifting versions, neighbours over 0.8 and others below, all in one bucket: each is one class."""

    sizes = neardup.F.lit(0).cast("long")
    members = neardup.bucket_members
    monkeypatch.setattr(neardup, "bucket_members", lambda texts, threshold: members(texts.withColumn("keys", neardup.F.array(sizes)), threshold))
    monkeypatch.setattr(neardup, "TURNS", 2)
    r, texts = random.Random(1), []
    for g in range(6):
        t = words(510 + g, 60).split()
        for at in r.sample(range(5, 55), 7):
            texts.append((g, " ".join(t)))
            t[at] = f"e{at}"
    r.shuffle(texts)
    rows = [(i, t) for i, (_, t) in enumerate(texts)]
    assert near_found(spark, rows) == neardup.brute_force(rows)


def test_packets_round_trip():
    for arrays in ([np.arange(5, dtype=np.uint64), np.array([7], np.uint32)], [np.empty(0, np.uint64)]):
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, neardup.unpacked(neardup.packed(*arrays)), strict=True))
    assert neardup.runs(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_near_classes_of_awkward_rows(spark, awkward, empty, awkward_rows):
    got = Counter((x.doc_id, x.class_id) for x in neardup.near_classes(awkward).collect())
    assert sum(got.values()) == len(awkward_rows) and got[3, 1] == 2 and got[2, 1] == 1 and got[7, 6] == 1 and got[13, 12] == 1 and got[None, None] == 1
    kept = neardup.near_dedup(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((x.doc_id is None, x.doc_id) for x in kept.select("doc_id").collect())
    assert ids == sorted((i is None, i) for i in [1, 4, 5, 6, 8, 9, 9, None, 10, 11, 12])
    assert neardup.near_classes(empty).count() == 0 and neardup.near_dedup(empty).count() == 0


def test_near_classes_with_null_and_largest_ids(spark):
    """The largest id is an id; a class without ids has none and keeps one row; equal ids of like texts keep one row."""
    near = lambda seed, at: " ".join("zz" if i == at else w for i, w in enumerate(words(seed, 120).split()))
    big = 2**63 - 1
    rows = [(5, near(1, 0)), (None, near(1, 9)), (big, near(1, 9)), (None, near(2, 0)), (None, near(2, 5)), (None, near(2, 5)), (big, near(3, 0)), (big, near(3, 7)), (big, near(3, 7)), (-(2**63), near(4, 0)), (None, None), (None, "")]
    docs = spark.createDataFrame([doc(*x) for x in rows], DOCS)
    got = Counter((x.doc_id, x.class_id) for x in neardup.near_classes(docs).collect())
    assert got == Counter({(5, 5): 1, (None, 5): 1, (big, 5): 1, (None, None): 5, (big, big): 3, (-(2**63), -(2**63)): 1})
    kept = neardup.near_dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter({5: 1, None: 2, big: 1, -(2**63): 1})


def test_collision_rate_is_weighted_jaccard():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 2**63, 40).astype(np.uint64)
    a, b = rng.uniform(0.1, 5, 40), rng.uniform(0.1, 5, 40)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    zero = np.array([0])
    hit = np.mean([neardup.samples(s, np.log(a).astype(np.float32), zero, k)[0] == neardup.samples(s, np.log(b).astype(np.float32), zero, k)[0] for k in range(4000)])
    assert abs(hit - true) < 0.03


def test_document_frequencies_are_exact(spark, monkeypatch):
    """Weights of shared shingles by the frequencies over all rows, repeated texts and common shingles included."""
    common = "this passage stands in very many of the texts here"
    rows = [(i, f"{words(i % 90, 3)} {common if i % 2 else words(i, 2)} {common}") for i in range(200)]
    monkeypatch.setattr(neardup, "COMMON", 3)
    monkeypatch.setattr(neardup, "BLOCK", 900)
    got = neardup.signatures(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 0.1).collect()
    df = Counter(g for _, t in rows for g in set(neardup.shingle_counts([encoded(t)])[0].tolist()))
    texts = {hashlib.md5(encoded(t)).hexdigest(): t for _, t in rows}
    assert sorted(x.id for x in got) == list(range(200)) and {x.h for x in got if x.keys} == set(texts)
    for x in got:
        if x.keys:
            s, n = neardup.shingle_counts([encoded(texts[x.h])])[:2]
            w = dict(zip(s.tolist(), (n * neardup.idf(200, np.array([df[g] for g in s.tolist()]))).tolist(), strict=True))
            assert math.isclose(x.total, sum(w.values()))
            assert {h % 2**64: round(v, 9) for h, v in zip(x.hs, x.ws, strict=True)} == {h: round(v, 9) for h, v in w.items() if df[h] > 1}
