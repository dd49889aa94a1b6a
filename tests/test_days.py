"""Tables of more days than thirty, or than a word has bits, and of none: queries over days against their SQL."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from chunkloom import catalog
from tests.test_queries import rows

BY_DAY = ["holes_by_day", "live_chunks_by_day", "gc_log", "month_report", "retention_due_list", "retention_due_capped", "event_log", "restore_samples", "moved_files", "retention_stream"]


def tables(path, events):
    """documents and events (user, day) as Parquet, and DuckDB views of them."""
    r = random.Random(8)
    words = [f"word{i}" for i in range(50)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    for i in range(40):
        text = " ".join(r.choice(words) for _ in range(r.choice([20, 200, 400])))
        c.execute("INSERT INTO documents VALUES (?, ?, 'en', 's', ?)", [i, None if i == 7 else text, len(text)])
    c.execute("CREATE TABLE events (user_id BIGINT, ts TIMESTAMP)")
    for user, day in events:
        c.execute("INSERT INTO events VALUES (?, ?)", [user, datetime(2024, 1, 1, 5) + timedelta(days=day)])
    for t in ("documents", "events"):
        c.execute(f"COPY {t} TO '{path}/{t}.parquet' (FORMAT parquet)")
    return c


@pytest.fixture(scope="module")
def hundred(tmp_path_factory):
    """A hundred days with gaps; one file has an event on each of them."""
    r, path = random.Random(9), tmp_path_factory.mktemp("hundred")
    events = [(0, d) for d in range(100)] + [(u, d) for d in range(100) if not 40 <= d < 52 for u in r.sample(range(1, 12), 4)]
    return path, tables(path, events)


@pytest.mark.parametrize("name", BY_DAY)
def test_a_hundred_days(spark, hundred, name):
    path, duck = hundred
    got = catalog.QUERIES[name](spark, str(path))
    want = duck.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE[name]})").fetchall()
    assert rows(got.collect()) == rows(want) and want
    if name == "gc_log":
        assert len(want) == 100


def test_no_days(spark, tmp_path):
    tables(tmp_path, [])
    for name in [*BY_DAY, "rewriting_by_day"]:
        if name != "month_report":
            assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0, name
    assert catalog.QUERIES["month_report"](spark, str(tmp_path)).first()["days"] == 0
