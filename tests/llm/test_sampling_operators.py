"""Fill-in-the-middle, SimHash and importance resampling: against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from chunkloom.llm import fim, importance, simhash

from .conftest import DOCS, doc, words
from .test_corpus_operators import order, sha

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def plain_fim(doc_id, text):
    text, digits = text or "", "" if doc_id is None else str(doc_id)
    h = [int(hashlib.sha256(f"1:{digits}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, m, s = text[:a], text[a:b], text[b:]
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h[3] % 100 < 20 else "psm", a, b - a, sha(out), sha(text)


def test_fill_in_middle_matches_plain_python(spark, empty, awkward_rows):
    r = random.Random(11)
    rows = [doc(100 + i, "".join(r.choice("aé漢😀 \n") for _ in range(r.randint(0, 90)))) for i in range(200)]
    rows += [doc(900, "a <M> b"), doc(901, "<P"), doc(902, "<S"), doc(903, "<P<P<S<"), doc(-5, "é😀" * 50_000), doc(2**63 - 1, "last"), doc(2**63 - 1, "last")]
    rows += [doc(1000 + i, "<P<S<M" * 3) for i in range(40)] + awkward_rows
    got = fim.fim_digest(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert order(tuple(x) for x in got.collect()) == order(plain_fim(x[0], x[1]) for x in rows)
    assert fim.fim_digest(empty).count() == 0 and {x[1] for x in got.dtypes if x[0] in ("n", "prefix_chars")} == {"bigint"}


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_checkpoints_find_every_unit(unit):
    r = random.Random(3)
    starts = {
        "char": lambda t: range(len(t)),
        "word": lambda t: [m.start() for m in re.finditer(r"[^ \t-\r]+", t)],
        "line": lambda t: [0] * bool(t) + [m.end() for m in re.finditer("\n", t) if m.end() < len(t)],
    }[unit]
    for size, every, block in itertools.product((0, 1, 7, 200, 700), (1, 3, 64), (1, 5, 1000)):
        text = "".join(r.choice("aé漢😀  \n\t") for _ in range(size))
        data, at = text.encode(), list(starts(text))
        index = fim.Checkpoints(np.frombuffer(data, np.uint8), unit, every, block)
        assert (index.n, index.chars) == (len(at), len(text)) and len(index.bytes) == -(-len(at) // every)
        for k, c in enumerate([*at, len(text)]):
            assert index.cut(k) == (len(text[:c].encode()), c)


def test_fill_in_middle_in_other_units_and_marks(spark, awkward):
    marks = ("[pre]", "[suf]", "[mid]")
    for unit in ("word", "line"):
        out = fim.fill_in_middle(awkward, unit=unit, every=2, cut=100, spm=50, seed=9, marks=marks)
        assert out.columns == ["doc_id", *(c for c in awkward.columns if c not in ("doc_id", "text")), "n", "form", "prefix_chars", "middle_chars", "output"]
        back = out.withColumn("text", fim.restore(out.output, out.form, marks)).select("doc_id", "text", "_did", "part")
        assert order(map(tuple, back.collect())) == order((x.doc_id, x.text or "", 7, "p") for x in awkward.collect())
        assert {x.form for x in out.collect()} == {"plain", "psm", "spm"}
    for bad in ({"unit": "page"}, {"marks": ("<P>", "<P>", "<M>")}, {"marks": ("a<", "<b", "c")}, {"marks": ("", "b", "c")}):
        with pytest.raises(ValueError):
            fim.fill_in_middle(awkward, **bad)


def plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def plain_components(rows, distance=2):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{fp:016x}", least.get(find(i))) for i, (d, fp) in enumerate(rows)]


def test_simhash_matches_plain_python(spark, empty, awkward_rows):
    r = random.Random(5)
    rows = list(awkward_rows)
    for g in range(12):
        base = words(50 + g, r.randint(3, 400)).split()
        for k in range(8):
            copy = list(base)
            for _ in range(k % 4):
                copy[r.randrange(len(copy))] = "new"
            rows.append(doc(1000 + 10 * g + k, r.choice([" ", "\n", "\t "]).join(copy).upper() if k % 2 else " ".join(copy)))
    rows += [doc(5000, "É é ÀB"), doc(5001, "  x"), doc(None, None), doc(None, words(6, 40)), doc(2**63 - 1, "a b"), doc(-3, "A  B")]
    got = simhash.simhash_digest(spark.createDataFrame(rows, DOCS)).collect()
    want = plain_components([(x[0], plain_simhash(x[1])) for x in rows])
    assert order(map(tuple, got)) == order(want)
    assert len({x[2] for x in want}) < len({x[1] for x in want})  # some link without being equal
    assert simhash.simhash_digest(empty).count() == 0


def test_a_text_in_pieces_has_the_same_simhash(monkeypatch):
    texts = ["", " ", "one", "one two", "One TWO three", words(1, 500), "x" * 300 + " " + words(2, 5), "é\n" * 99]
    want = [plain_simhash(t) for t in texts]
    assert [simhash.simhash(t.encode()) for t in texts] == want
    whole = simhash.pieces
    monkeypatch.setattr(simhash, "pieces", lambda data: whole(data, 7))
    monkeypatch.setattr(simhash, "HASHES", 3)
    assert [simhash.simhash(t.encode()) for t in texts] == want


@pytest.mark.parametrize(("distance", "segments", "bucket"), [(2, 5, 256), (2, 5, 2), (2, 3, 16), (1, 3, 2), (0, 2, 2)])
def test_links_connect_what_all_pairs_do(spark, distance, segments, bucket):
    """Clusters whose members differ in one segment only, so that buckets are full; chains of single flips; fingerprints at three bits."""
    r = random.Random(distance * 10 + segments)
    fps = {0, 1, 3, 7, 15, 2**64 - 1, 2**63}
    for low_bit, high in ((0, 64), (0, 12), (40, 64), (20, 33)):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(120):
            y = r.choice(sorted(fps)) if r.random() < 0.2 else x
            for _ in range(r.randint(1, 3)):
                y ^= 1 << r.randrange(low_bit, high)
            fps.add(y)
    fps = sorted(fps)
    table = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    got = simhash.links(table, distance, segments, bucket).collect()
    back = {simhash.signed(x): i for i, x in enumerate(fps)}
    root = simhash.forest(*(np.array([back[x[k]] for x in got], np.int64) for k in (0, 1)), len(fps))
    want = plain_components(list(enumerate(fps)), distance)
    assert root.tolist() == [x[2] for x in want]


def test_chains_keep_every_pair_within_the_distance():
    plan, r = simhash.chains(2, 5), random.Random(1)
    assert [[b for _, b in p] for p in plan] == [[0, 1, 1, 2]] * 5 and all(p[-1][0] == 2**64 - 1 for p in plan)
    for _ in range(3000):
        d = 0
        for _ in range(r.randint(0, 3)):
            d ^= 1 << r.randrange(64)
        kept = any(all((d & m).bit_count() <= b for m, b in p) for p in plan)
        assert kept == (d.bit_count() <= 2)
    with pytest.raises(ValueError):
        simhash.links(None, 3)


def plain_resample(docs, target):
    def features(text):
        w = WORD.findall(low(text))
        return len(w), w + [f"{a} {b}" for a, b in itertools.pairwise(w)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)}
    out = []
    for d, text in docs:
        n, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n, text or ""])
    enough = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    for k, x in enumerate(enough[: 25 * len(enough) // 100]):
        x[4] = k + 1
    return [tuple(x[:5]) for x in out]


def test_resampling_matches_plain_python(spark, empty, awkward_rows, monkeypatch):
    monkeypatch.setattr(importance, "RANGE", 7)
    monkeypatch.setattr(importance, "COPIES", 4)
    r = random.Random(13)
    rows = list(awkward_rows) + [doc(100 + i, words(i, r.randint(0, 60)).title() + " École ÉCOLE x1") for i in range(90)]
    rows += [rows[-1]] * 25 + [doc(None, words(77, 30))] * 9 + [doc(2**63 - 1, words(3, 25)), doc(-1, words(3, 19)), doc(-2, words(3, 20))]
    target = [words(i, 12) for i in range(0, 90, 9)] + [None, "", "?!"]
    items = lambda t: spark.createDataFrame([(i, x, 1) for i, x in enumerate(t)], "item_id long, text string, bucket int")
    docs = spark.createDataFrame(rows, DOCS)
    got = importance.resample_digest(docs, items(target))
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert order(map(tuple, got.collect())) == order(plain_resample([(x[0], x[1]) for x in rows], target))
    assert order(map(tuple, importance.resample_digest(docs, items([])).collect())) == order(plain_resample([(x[0], x[1]) for x in rows], []))
    assert importance.resample_digest(empty, items(target)).count() == 0


def test_resampling_stays_within_generated_code(spark, awkward):
    plan = importance.features(awkward, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
