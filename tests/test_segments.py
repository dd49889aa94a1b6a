"""SiLo without order: against plain Python."""

import random

import pytest

from chunkloom.operators import indexes

SCHEMA = "file_id long, seq int, ord long, fp string, len long"


def plain(rows, size):
    """found, false_neg, stored, entries, reads by walking the chunks in order."""
    segs, first = {}, {}
    for f, q, o, fp, n in sorted(rows, key=lambda r: r[2]):
        segs.setdefault((f, q // size), []).append((o, fp, n))
        first.setdefault(fp, o)
    heads, found, missed, stored, reads = {}, 0, 0, 0, 0
    for key in sorted(segs, key=lambda k: segs[k][0][0]):
        rep = min(fp for _, fp, _ in segs[key])
        head = heads.setdefault(rep, key)
        reads += head != key
        at = [x for k in (-1, 0, 1) for x in segs.get((head[0], head[1] + k), [])] if head != key else []
        for o, fp, n in segs[key]:
            if any(p == fp and q < o for q, p, _ in [*at, *segs[key]]):
                found += 1
            else:
                stored += n
                missed += first[fp] < o
    return found, missed, stored, len(heads), reads


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_are_those_of_a_plain_walk(spark, seed):
    """A third of all files are copies of one; others take runs of chunks from each other; single and repeated chunks."""
    r, rows = random.Random(seed), []
    hot = [f"h{i}" for i in range(11)]
    for f in range(45):
        fps = hot if f % 3 == 0 else [f"c{(f // 4 * 5 + k) % 70 + r.choice([0, 0, 0, 900])}" for k in range(r.randint(1, 14))]
        rows += [(f * 10, k, f * 1000 + k, fp, 10 + len(fp)) for k, fp in enumerate(fps)]
    shuffled = r.sample(rows, len(rows))
    got = {x.segment_chunks: (x.found, x.false_neg, x.stored, x.entries, x.reads) for x in indexes.segmented(spark.createDataFrame(shuffled, SCHEMA), [2, 4, 16]).collect()}
    assert got == {n: plain(rows, n) for n in (2, 4, 16)} and all(x[1] for x in got.values())


def test_no_chunks(spark):
    assert indexes.segmented(spark.createDataFrame([], SCHEMA), [4]).count() == 0
