"""Sparse containers inherited from session to session: against a plain replay."""

import random
from collections import defaultdict

from chunkloom.operators import rewriting

SCHEMA = "session int, file_id long, seq int, fp string, len long"


def replay(rows, capacity, threshold):
    """(session, fp) to (home, container, written, again), session by session, with the whole state in a dictionary."""
    out, newest, used, bad = {}, {}, defaultdict(int), set()
    for now in sorted({r[0] for r in rows}):
        here = {}
        for _, file_id, seq, fp, n in sorted(r for r in rows if r[0] == now):
            here.setdefault(fp, n)
        up, live = 0, defaultdict(int)
        for fp, n in here.items():
            again = newest.get(fp) in bad
            if fp not in newest or again:
                newest[fp] = (now, up // capacity)
                used[newest[fp]] += n
                up += n
                out[now, fp] = (*newest[fp], True, again)
            else:
                out[now, fp] = (*newest[fp], False, False)
            live[newest[fp]] += n
        bad = {c for c, n in live.items() if n < used[c] * threshold}
    return out


def sessions(seed):
    """Sessions with gaps between; files that drop and take back chunks; one chunk in every file and several times within."""
    r, rows = random.Random(seed), []
    size = {f"c{i}": r.randint(1, 40) for i in range(60)} | {"hot": 25}
    for s in (-3, 0, 1, 9, 10):
        for f in r.sample(range(8), 5):
            names = ["hot", *(f"c{(f * 7 + k) % 60}" for k in range(12) if r.random() < 0.6), "hot"]
            rows += [(s, f * 10**12, k, x, size[x]) for k, x in enumerate(names)]
    return rows


def test_rewriting_is_a_plain_replay(spark):
    rows = sessions(4)
    want = replay(rows, 100, 0.7)
    assert sum(x[3] for x in want.values()) > 5
    shuffled = random.Random(1).sample(rows, len(rows))
    got = rewriting.rewritten(spark.createDataFrame(shuffled, SCHEMA), 100, 0.7).collect()
    assert {(x.session, x.fp): (x.home, x.container, x.written, x.again) for x in got} == want and len(got) == len(want)


def test_without_rewriting_a_chunk_stays_where_it_was_put(spark):
    rows = sessions(5)
    want = {k: v[:2] for k, v in replay(rows, 100, 0.0).items()}
    got = rewriting.unmoved(spark.createDataFrame(rows, SCHEMA), 100).collect()
    assert {(x.session, x.fp): (x.home, x.container) for x in got} == want


def test_no_sessions(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rewriting.rewritten(none, 100).count() == rewriting.unmoved(none, 100).count() == 0


def test_runs_move_together_and_are_cut_where_containers_end(spark, monkeypatch):
    """Contents with chunks of their own and shared ones, backed up by several files: few rows a session, the same as the replay by chunks."""
    monkeypatch.setattr(rewriting, "RUN", 8)
    monkeypatch.setattr(rewriting, "RANGE", 5)
    r = random.Random(6)
    size = {f"{c}-{k}": r.randint(1, 40) for c in range(12) for k in range(20)} | {f"s{k}": r.randint(1, 250) for k in range(9)}
    contents = {c: [f"{c}-{k}" for k in range(10)] + [f"s{k}" for k in range(c % 3 * 3, c % 3 * 3 + 3)] + [f"{c}-{k}" for k in range(10, 20)] + [f"{c}-3"] for c in range(12)}
    contents[11] = contents[2]
    chunks = [(c, k, x, size[x]) for c, names in contents.items() for k, x in enumerate(names)] + [(99, 0, "unused", 7)]
    uses = [(s, f, (f + s // 3) % 12) for s in (-2, 0, 1, 3, 4, 7, 8) for f in r.sample(range(30), 9)]
    rows = [(s, f, k, x, n) for s, f, c in uses for d, k, x, n in chunks if d == c]
    want = replay(rows, 100, 0.7)
    assert sum(x[3] for x in want.values()) > 5
    found = rewriting.runs(spark.createDataFrame(chunks, "content long, seq int, fp string, len long"), spark.createDataFrame(uses, "session int, file_id long, content long"), members=True)
    moves, places = rewriting.replayed(found, 100, 0.7)
    got = rewriting._by_chunk(moves, found, *rewriting.HOME, "written", "again").collect()
    assert {(x.session, x.fp): (x.home, x.container, x.written, x.again) for x in got} == want and len(got) == len(want)
    assert all(x.len == size[x.fp] for x in got)
    assert found.count() * 3 < len({x[3] for x in rows}) and moves.count() * 2 < len(want)
    live = defaultdict(int)
    for (s, x), (home, c, *_) in want.items():
        live[s, home, c] += size[x]
    assert {(x.session, x.home, x.container): x.live for x in places.collect()} == live
