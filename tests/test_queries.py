"""Every query against its SQL, and the driver's entry points."""

import os
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__ as entry
from chunkloom import catalog

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(found):
    return sorted(tuple("null" if v is None else repr(float(v)) if isinstance(v, (int, float, Decimal)) else str(v) for v in r) for r in found)


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    found = got.collect()
    if name in catalog.ORACLE:
        want = duck.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE[name]})").fetchall()
        assert rows(found) == rows(want)
    else:
        assert found


def test_recipes_with_a_chunk_in_very_many_files_are_matched(spark, monkeypatch):
    from chunkloom.plans import dedup

    rows = [(i, "common") for i in range(1200)] + [(5, "a"), (6, "a")]
    monkeypatch.setattr(dedup, "blocks", lambda spark, sf_dir: spark.createDataFrame(rows, "file_id long, fp string"))
    got = {x.file_id: (x.recipe_of, x.overlap) for x in dedup.recipe_match(spark, "").collect()}
    assert got == {i: (0, 1) for i in range(1, 1200)}


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_alone(tmp_path):
    """Without the corpus operators and their pipeline the entry still imports and has the other queries."""
    import shutil

    root = Path(entry.__file__).parent
    shutil.copytree(root / "chunkloom", tmp_path / "chunkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op1') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_corpus_operators():
    root = Path(entry.__file__).parent / "chunkloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "chunkloom.llm" in p.read_text()]
