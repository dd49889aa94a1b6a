"""Reuse distances, ordered scans, blocks at any offset, best recipes, local maxima: against plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from chunkloom.functions.gear import maximum_spans
from chunkloom.operators import containment, overlap, reuse, scan


def test_counts_of_smaller_values_before():
    r = random.Random(1)
    for n in (0, 1, 2, 63, 64, 65, 300, 1000):
        v = np.array([r.randint(0, max(1, n // 2)) for _ in range(n)], np.int64)
        assert reuse.smaller_before(v).tolist() == [int((v[:i] < v[i]).sum()) for i in range(n)]


@pytest.mark.parametrize("ranges", [1, 3, 17])
def test_reuse_distances_are_those_of_a_replayed_cache(spark, ranges):
    """A hot key with a third of all accesses, streams of one access, ids far apart and negative."""
    r = random.Random(ranges)
    rows = [(lang, r.choice([5, r.randint(0, 40), r.randint(0, 40)]), o * 10**15 - 7) for lang, n in (("a", 400), ("b", 90), ("c", 1), (None, 12)) for o in range(n)]
    want, stacks = {}, defaultdict(list)
    for lang, key, o in rows:
        s = stacks[lang]
        want[lang, o] = s.index(key) if key in s else None
        if key in s:
            s.remove(key)
        s.insert(0, key)
    shuffled = r.sample(rows, len(rows))
    got = reuse.distances(spark.createDataFrame(shuffled, "lang string, key int, ord long"), ["lang"], "ord", "key", ranges).collect()
    assert {(x.lang, x.ord): x.distance for x in got} == want and len(got) == len(rows)


def test_running_sums_over_ranges(spark):
    rows = [("a" if i % 3 else "b", i * 7 % 101, i % 5) for i in range(101)]
    parts = scan.in_ranges(spark.createDataFrame(rows, "lang string, ord long, len long"), ["lang"], ["ord"], 7)
    got = {(x.lang, x.ord): (x.rn, x.total) for x in scan.running(parts, ["lang"], ["ord"], "rn", total="len").collect()}
    seen, total = Counter(), Counter()
    for lang, o, n in sorted(rows):
        seen[lang] += 1
        total[lang] += n
        assert got[lang, o] == (seen[lang], total[lang])
    plan = scan.running(parts, ["lang"], ["ord"], "rn")._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(part" in plan or "windowspecdefinition(lang" in plan and "part" in plan


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_blocks_are_found_at_any_offset(spark, monkeypatch, piece):
    monkeypatch.setattr(containment, "PIECE", piece)
    r = random.Random(7)
    make = lambda n: bytes(r.choice(b"ab") for _ in range(n))
    bodies = [make(r.randint(0, 300)) for _ in range(60)] + [b"", None, b"a" * 500]
    needles = [make(16) for _ in range(40)] + [b[5:21] for b in bodies[:20] if b and len(b) > 21] + [b"a" * 16]
    blocks = spark.createDataFrame([(f"{n.hex()}", n) for n in needles], "x string, bytes binary").selectExpr("md5(bytes) AS fp", "bytes")
    files = spark.createDataFrame(list(enumerate(bodies)), "file_id long, body binary")
    got = {x.fp: (x.files, x.places, x.first_file) for x in containment.found_anywhere(blocks, files, 16).collect()}
    want = {}
    for n in set(needles):
        at = {i: sum((b or b"")[k : k + 16] == n for k in range(len(b or b""))) for i, b in enumerate(bodies)}
        held = [i for i, c in at.items() if c]
        if held:
            import hashlib

            want[hashlib.md5(n).hexdigest()] = (len(held), sum(at.values()), held[0])
    assert got == want and len(want) > 15
    assert containment.found_anywhere(blocks.limit(0), files, 16).count() == 0
    with pytest.raises(ValueError):
        containment.found_anywhere(blocks, files, 12)


def all_pairs(rows):
    sets = defaultdict(set)
    for f, c in rows:
        sets[f].add(c)
    out = {}
    for x in sorted(sets):
        best = max(((len(sets[x] & sets[y]), -y) for y in sets if y < x), default=(0, 0))
        if best[0]:
            out[x] = (-best[1], best[0])
    return out


def best(spark, rows):
    return {x.file_id: (x.recipe_of, x.overlap) for x in overlap.best_recipes(spark.createDataFrame(rows, "file_id long, fp string")).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_best_recipes_are_those_of_all_pairs(spark, seed):
    r = random.Random(seed)
    pool = [f"c{i}" for i in range(30)]
    rows = [(f * 10**13 - 50, c) for f in range(90) for c in r.choices(pool, weights=[1 / (i + 1) for i in range(30)], k=r.randint(1, 8))]
    rows += [(f * 10**13 - 50, f"u{f}") for f in range(90) if f % 2] + [(10**16 + i, c) for i in range(5) for c in ("c0", "c3", "c7")]
    assert best(spark, rows) == all_pairs(rows)


def test_a_chunk_in_very_many_files_makes_no_pairs(spark):
    rows = [(i, "common") for i in range(1200)] + [(i, f"pair{i // 2}") for i in range(1200)]
    files, sets = overlap.nodes_of(spark.createDataFrame(rows, "file_id long, fp string"))
    assert {x.file_id: (x.recipe_of, x.overlap) for x in overlap.best_recipes(spark.createDataFrame(rows, "file_id long, fp string")).collect()} == {i: (i - 1, 2) if i % 2 else (0, 1) for i in range(1, 1200)}
    assert files.count() == 1200 and sets.filter("df > 2").count() == 600  # copies are one node, so their chunk isn't shared


def test_local_maxima():
    r = random.Random(5)
    for n, w in ((0, 3), (1, 3), (6, 3), (7, 3), (300, 3), (300, 5), (500, 1), (400, 64)):
        body = bytes(r.randint(0, 255) for _ in range(n))
        ends = [i + 1 for i in range(w, n - w) if body[i] > max(body[i - w : i]) and body[i] > max(body[i + 1 : i + w + 1])]
        ends += [n] if n and (not ends or ends[-1] < n) else []
        assert maximum_spans(body, w) == [(a, b - a) for a, b in zip([0, *ends], ends, strict=False)]
