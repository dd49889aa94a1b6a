"""The pipeline's stages one after another against plain Python, and the registry."""

import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from chunkloom.llm import decontaminate, neardup, toxicity
from chunkloom.llm.registry import QUERIES, model_path

from .conftest import doc, words
from .test_corpus_operators import sha

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r, at = random.Random(6), tmp_path_factory.mktemp("sf")
    rows = []
    for i in range(150):
        text = words(i, r.randint(5, 80))
        if i % 10 == 3:
            text += "\nthe same line in many documents"
        if i % 10 == 4:
            text += " vile " + words(3000 + i, 3) + " nasty"
        if i % 25 == 6:
            text = rows[-3][1]
        rows.append((i, text, "en", "s", len(text)))
    items = [(0, " ".join(rows[20][1].split()[:12])), (1, words(9999, 20))]
    labels = [(i, 1, int(i % 10 == 4)) for i in range(120)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows, items


def test_stages_match_plain_python(spark, sf_dir):
    at, rows, items = sf_dir
    docs = spark.read.parquet(f"{at}/documents.parquet")
    chain = toxicity.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    left = [(d, t) for d, t, *_ in rows if chain.score([t.encode()])[0, 0] < toxicity.CUT]
    assert {d for d, *_ in rows} - {d for d, _ in left} == {d for d, *_ in rows if d % 10 == 4 and d % 25 != 6} | {d for d, t, *_ in rows if "vile" in t.split()}
    owner = {}
    for d, t in left:
        for line in t.split("\n"):
            owner.setdefault(line, set()).add(d)
    left = [(d, "\n".join(x for x in t.split("\n") if len(x) < 10 or len(owner[x]) < 2 or min(owner[x]) == d)) for d, t in left]
    classes = neardup.brute_force(left)
    left = [(d, t) for d, t in left if classes[d] == d]
    hit = {d for d, _ in decontaminate.brute_force(left, items)}
    left = [(d, t) for d, t in left if d not in hit]
    assert hit
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = {(d, len(i := lib.encode(t)), sha(",".join(map(str, i))), sha(lib.decode(i))) for d, t in left}
    got = {tuple(x) for x in corpus_pipeline.run(spark, at).collect()}
    assert got == want


def test_all_stages_but_the_last_return_documents(spark, sf_dir):
    at, *_ = sf_dir
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]


def test_awkward_rows_pass_through_all_stages(spark, tmp_path, awkward, awkward_rows):
    """Null and empty texts, null, tied and largest ids, repeated rows, clashing columns; and tables without rows."""
    extra = [doc(2**63 - 1, words(300, 40)), doc(None, None), doc(None, None), doc(20, "clean " + words(301, 30)), doc(20, "clean " + words(302, 30))]
    docs = awkward.unionByName(spark.createDataFrame(extra, awkward.schema))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(0, None), (1, ""), (2, words(301, 30)), (2, words(301, 30)), (None, words(999, 20))], "item_id long, text string")
    for name, tables in {"rows": (docs, items, labels), "none": (docs.limit(0), items.limit(0), labels.limit(0)), "bare": (docs, items.limit(0), labels.limit(0))}.items():
        for t, df in zip(("documents", "benchmark", "labels"), tables, strict=True):
            df.write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        got = sorted((x.doc_id is None, x.doc_id or 0) for x in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect())
        # the second copy of text 1 loses its only line and heads the empty texts; unlike texts with one id each stay; the item's text goes
        ids = [1, 2, 4, 5, 8, 9, 9, 10, 11, 12, 20, 20, 2**63 - 1]
        want = [] if name == "none" else sorted([(False, i) for i in (ids[:-2] if name == "rows" else ids[:-1]) + [2**63 - 1]] + [(True, 0)])
        assert got == want, name


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_sql_agrees(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in entry.oracle_sql().items():
        if name in QUERIES:
            got = QUERIES[name](spark, sf)
            want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)), name

