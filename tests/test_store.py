"""Index strategies, containers, lifecycle, delta chains, streaming: on small streams told by hand or replayed."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chunkloom.config import DedupConfig
from chunkloom.operators import chunking, dedup, delta, indexes, lifecycle, store
from chunkloom.sources import generate
from chunkloom.streaming import ingest


def stream(*files):
    return pd.DataFrame([(f, f * 100 + i, fp, 10) for f, fps in enumerate(files) for i, fp in enumerate(fps)], columns=["file_id", "ord", "fp", "len"])


def test_full_hash_sees_every_duplicate():
    r = indexes.replay(stream("abc", "abd"), DedupConfig())
    assert (r["fresh"], r["dups"], r["false_neg"], r["index_ram"]) == (4, 2, 0, 4 * 24)


def test_what_other_streams_stored_is_known():
    frame = stream("abc", "abd").assign(first=-1)  # all of it was stored before
    whole, eb = (indexes.replay(frame, DedupConfig(index_kind=x)) for x in ("hash", "eb"))
    assert (whole["dups"], whole["fresh"], whole["false_neg"], whole["index_ram"]) == (6, 0, 0, 0)
    assert eb["dups"] + eb["false_neg"] == 6 and eb["fresh"] == eb["false_neg"]


def test_extreme_binning_links_by_first_chunk():
    r = indexes.replay(stream("abc", "abd", "xbc"), DedupConfig(index_kind="eb"))
    # the second file links to the first by a; the third has no representative in common, so b and c are missed
    assert (r["dups"], r["false_neg"], r["disk_reads"], r["seq_reads"], r["index_entries"], r["index_ram"]) == (2, 2, 1, 3, 2, 3 * 24)


def test_extreme_binning_own_first_chunk_links_to_itself():
    r = indexes.replay(stream("aab"), DedupConfig(index_kind="eb"))
    assert (r["dups"], r["disk_reads"], r["fresh"]) == (1, 1, 2)


def test_extreme_binning_by_least_fingerprint():
    r = indexes.replay(stream("cab", "bca"), DedupConfig(index_kind="eb", eb_representative="min"))
    assert r["disk_reads"] == 1 and r["false_neg"] == 2  # b and c come before the representative a


def test_silo_reads_segments():
    r = indexes.replay(stream("abcd", "abxd"), DedupConfig(index_kind="silo", segment_chunks=4))
    # a fetches the segment, b and d are at hand then
    assert (r["dups"], r["disk_reads"], r["seq_reads"], r["false_neg"], r["index_entries"]) == (3, 1, 4, 0, 2)


def test_silo_misses_beyond_segments():
    r = indexes.replay(stream("abcd", "bcd"), DedupConfig(index_kind="silo", segment_chunks=2))
    # segments ab and cd: b is no representative and is missed, c fetches cd
    assert (r["false_neg"], r["disk_reads"]) == (1, 1)


def test_pack_is_next_fit(spark):
    rows = [(0, i, n) for i, n in enumerate([6, 6, 4, 11, 1, 10])]
    got = store.pack(spark.createDataFrame(rows, "shard long, chunk_id long, rec_len long"), 10, "shard").orderBy("chunk_id").collect()
    assert [(x.container, x.coff) for x in got] == [(0, 0), (1, 0), (1, 6), (2, 0), (3, 0), (4, 0)]


def test_restore_notices_loss_and_length(spark):
    files = spark.createDataFrame([(1, b"abcdef"), (2, b"abc"), (3, b"")], "file_id long, body binary")
    recipe = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (2, 0, 10), (2, 1, 12)], "file_id long, seq int, chunk_id long")
    payload = spark.createDataFrame([(10, b"abc"), (11, b"def")], "chunk_id long, bytes binary")
    got = {x.file_id: x for x in store.restore(recipe, payload, files.filter("file_id < 3")).collect()}
    assert got[1].verified and not got[2].verified and got[2].missing == 1


def test_doubling_all_files_adds_no_unique_chunk(spark):
    f = generate.dataset(spark, 6, 16, versions=1).select("file_id", "body")
    c = chunking.cdc_chunks(f, DedupConfig(bits=9))
    twice = c.unionByName(c.withColumn("ord", F.col("ord") + 10**12))
    a, b = dedup.totals(dedup.occurrences(c)).first(), dedup.totals(dedup.occurrences(twice)).first()
    assert (a.uniques, 2 * a.chunks, a.written) == (b.uniques, b.chunks, b.written)
    assert dedup.new_chunks(twice, c).count() == 0


def test_near_exact_verified_is_exact(spark):
    f = generate.dataset(spark, 8, 16).select("file_id", "version", "body")
    c = chunking.cdc_chunks(f, DedupConfig(bits=9)).withColumn("ord", F.col("ord") * 2 + F.col("version"))
    exact, short, blind = (dedup.near_exact(c, *a).first() for a in ((0, True), (4, True), (4, False)))
    assert exact.ratio == short.ratio and short.index_ram < exact.index_ram and short.false_hits == 0
    assert blind.false_hits > 0 and blind.ratio > exact.ratio


def test_copies_expire_on_the_day_after_keep(spark):
    b = spark.createDataFrame([(0, 1), (5, 1)], "day int, file_id long")
    assert [tuple(x) for x in lifecycle.expiries(b, 7, 12).collect()] == [(0, 1, 8)]


def replay_collections(refs, days, keep, threshold, container):
    """Chunk by chunk and day by day; the disk is whole containers."""
    there, out = {}, []
    for t in range(days):
        wrote = 0
        for d, fp, n in refs:
            if d == t and fp not in there:
                there[fp] = n
                wrote += n
        live = {fp for d, fp, _ in refs if t - keep <= d <= t}
        holes = sum(n for fp, n in there.items() if fp not in live)
        disk = -(-sum(there.values()) // container) * container
        gc = bool(there) and holes / disk > threshold
        if gc:
            there = {fp: n for fp, n in there.items() if fp in live}
        out.append((t, wrote, sum(there.values()), gc))
    return out


@pytest.mark.parametrize(("container", "days"), [(1, 30), (500, 30), (1 << 18, 30), (1, 100), (500, 100)])
def test_collections_match_a_replay(spark, container, days):
    """Also for more days than a word has bits."""
    r = random.Random(3)
    size = {f"f{i}": r.randint(1, 100) for i in range(60)}
    refs = sorted({(d, f"f{(d * 2 + r.randint(0, 12)) % 60}") for d in range(days) for _ in range(6)})
    refs = [(d, fp, size[fp]) for d, fp in refs]
    lists = lifecycle.day_lists(spark.createDataFrame(refs, "day int, fp string, len long"))
    got = [(x.day, x.written, x.used, x.gc > 0) for x in lifecycle.collections(spark, lists, days, 7, 0.25, container).orderBy("day").collect()]
    want = replay_collections(refs, days, 7, 0.25, container)
    assert [g[:3] for g in got] == [w[:3] for w in want] and (sum(w[3] for w in want) > 0 or container > 500)


def test_changes_by_day_are_those_of_a_replay(spark):
    """Days without references, a chunk met once, one met each day; days that begin late and count from a later day on."""
    refs = [(0, "a", 5), (0, "a", 5), (3, "a", 5), (90, "a", 5), (70, "b", 7), (2, "c", 1), *((d, "hot", 11) for d in range(95))]
    lists = lifecycle.day_lists(spark.createDataFrame(refs, "day int, fp string, len long"))
    for low, first, keep in ((0, 0, 7), (60, 65, 7), (0, 0, 0), (80, 96, 3)):
        got, sums = {r.day: r for r in lifecycle.changes(lists, low, first, keep).collect()}, [0, 0, 0]
        for t in range(first, 105):
            r = got.get(t)
            if r:
                sums = [a + b for a, b in zip(sums, (r.live, r.live_n, r.used), strict=True)]
            alive = {fp: n for d, fp, n in refs if max(low, t - keep) <= d <= t}
            there = {fp: n for d, fp, n in refs if low <= d <= t}
            assert sums == [sum(alive.values()), len(alive), sum(there.values())], (t, low)
            assert (r.written if r else 0) == sum(n for fp, n in there.items() if t == min(d for d, f, _ in refs if f == fp and d >= low))


def month(days=20, files=4, churn=0.4, seed=1):
    r, rows = random.Random(seed), []
    bodies = {f: generate.pool(8192, seed * 50 + f) for f in range(files)}
    for d in range(days):
        for f in list(bodies):
            if r.random() < churn:
                bodies[f] = generate.next_version(bodies[f], 0.12, d * 100 + f)
            if r.random() < 0.05:
                bodies[f] = generate.pool(8192, d * 1000 + f)
            rows.append((d, f, bodies[f]))
    return pd.DataFrame(rows, columns=["day", "file_id", "body"])


@pytest.mark.parametrize("kind", ["hash", "eb", "silo"])
@pytest.mark.parametrize("pick", [None, "index", "recent"])
def test_every_live_copy_restores(kind, pick):
    cfg = DedupConfig(bits=9, container_bytes=16384, index_kind=kind, retention=3, delta=pick is not None, delta_pick=pick or "index", delta_min=64)
    series, report = lifecycle.live_through(month(), cfg, 20)
    assert len(report) == 4 * 4 and report["verified"].all() and (report["broken"] == 0).all()
    assert series["gc_runs"].sum() > 0 and (series["logical"] >= 0).all() and (series["broken_links"] == 0).all()
    assert series["logical"].sum() > series["written"].sum() + series["gc_written"].sum() - series["gc_written"].sum()
    if pick:
        assert series["delta_chunks"].sum() > 0 and series["delta_bytes"].sum() < series["delta_raw"].sum()


def test_without_a_guard_chains_break():
    on, off = (DedupConfig(bits=9, container_bytes=8192, retention=2, delta=True, delta_min=64, gc_threshold=0.05, chain_guard=g) for g in ("expand", "off"))
    a, ra = lifecycle.live_through(month(churn=0.9), on, 20)
    b, rb = lifecycle.live_through(month(churn=0.9), off, 20)
    assert ra["verified"].all() and not rb["verified"].all()
    assert a["guard_written"].sum() > 0 == b["guard_written"].sum()


def test_unverified_short_keys_corrupt_restores():
    good, bad = (DedupConfig(bits=8, fp_bits=6, fp_verify=v) for v in (True, False))
    a, ra = lifecycle.live_through(month(days=5), good, 5)
    b, rb = lifecycle.live_through(month(days=5), bad, 5)
    assert ra["verified"].all() and a["false_pos"].sum() == 0
    assert not rb["verified"].all() and b["false_pos"].sum() > 0 and b["written"].sum() < a["written"].sum()


def test_collected_chunks_come_back_as_new():
    body = generate.pool(3000, 1)
    other = generate.pool(3000, 2)
    rows = [(d, 0, body if d in (0, 9) else other) for d in range(10)]
    series, report = lifecycle.live_through(pd.DataFrame(rows, columns=["day", "file_id", "body"]), DedupConfig(bits=9, container_bytes=4096, retention=2), 10)
    assert series["gc_runs"].sum() > 0 and series["uniques"].iloc[9] > 0 and report["verified"].all()


def test_simulate_sums_shards(spark):
    m = month(days=6)
    df = spark.createDataFrame([(f % 2, d, f, b) for d, f, b in m.itertuples(index=False)], "shard long, day int, file_id long, body binary")
    got = lifecycle.simulate(df, DedupConfig(bits=9), 6).orderBy("day").toPandas()
    want = sum(lifecycle.live_through(m[m.file_id % 2 == s], DedupConfig(bits=9), 6)[0]["written"] for s in (0, 1))
    assert got["written"].tolist() == want.tolist()
    assert lifecycle.restores(df, DedupConfig(bits=9), 6).filter("not verified").count() == 0


def test_chain_depths_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000)], "node long, target long")
    got = {x.node: (x.depth, x.root) for x in delta.chain_depths(edges).collect()}
    assert all(got[i] == (i, 0) for i in range(300)) and all(got[i][1] is None for i in (1000, 1001, 1002))


def test_chain_depths_and_broken_links(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (9, None)], "node long, target long")
    got = {x.node: (x.depth, x.root) for x in delta.chain_depths(edges).collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (2, 1), 4: (3, 1), 5: (4, 1), 9: (0, 9)}
    live = spark.createDataFrame([(2,), (4,), (5,)], "node long")
    assert sorted(tuple(x) for x in delta.broken_links(edges, live).collect()) == [(2, 1), (4, 3)]


def test_streamed_chunks_equal_batch_chunks(spark, tmp_path):
    cfg, r = DedupConfig(bits=7), random.Random(2)
    bodies = {f: generate.pool(r.randint(0, 3000), f) for f in range(5)}
    n, at = 0, dict.fromkeys(bodies, 0)
    part = dict.fromkeys(bodies, 0)
    while any(at[f] <= len(b) for f, b in bodies.items()):
        rows = []
        for f, b in bodies.items():
            if at[f] <= len(b):
                step = r.randint(1, 900)
                rows.append((f, part[f], b[at[f] : at[f] + step], at[f] + step > len(b)))
                at[f] += step
                part[f] += 1
        spark.createDataFrame(rows, "file_id long, part int, data binary, last boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        n += 1
    pieces = spark.readStream.schema("file_id long, part int, data binary, last boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = ingest.chunk_stream(pieces, cfg).writeStream.format("memory").queryName("chunks_seen").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(x) for x in spark.table("chunks_seen").collect())
    batch = chunking.cdc_chunks(spark.createDataFrame(list(bodies.items()), "file_id long, body binary"), cfg)
    assert got == sorted(tuple(x) for x in batch.select("file_id", "seq", "off", "len", "fp").collect())


def test_inline_ingestion_equals_offline(spark, tmp_path):
    f = generate.dataset(spark, 6, 8, versions=2).select("file_id", "version", "body")
    c = chunking.cdc_chunks(f, DedupConfig(bits=8)).select("fp", "len", "ord")
    for i in range(3):
        c.filter(F.col("ord") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest.ingest_batches(s, f"{tmp_path}/store", f"{tmp_path}/cp").awaitTermination(120)
    stored = spark.read.parquet(f"{tmp_path}/store")
    assert stored.count() == c.select("fp").distinct().count() == stored.select("fp").distinct().count()


def test_stream_windows(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    import os

    if not os.path.exists(src):
        pytest.skip("no test tables")
    e = spark.read.parquet(src)
    e.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    q = ingest.daily_totals(s).writeStream.format("memory").queryName("days_seen").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = e.groupBy(F.to_date("ts"), "event_type").count().count()
    assert spark.table("days_seen").count() == want


def test_population_keeps_its_rules():
    cfg = DedupConfig(deaths_per_day=2, births_per_day=1)
    p = lifecycle.population(cfg, 20, 40, 0.1)
    there = p[p.event.fillna("") != "death"]
    assert (there.groupby("day").size() >= 10).all() and (there[there.day == 0].version == 0).all() and set(p.event.dropna()) == {"death", "birth", "change"}
    births = p[p.event == "birth"]
    assert (births.born == births.day).all() and (births.version == 0).all()
    assert lifecycle.population(cfg, 20, 40, 0.1).equals(p)


def test_generated_month_lives_and_restores(spark):
    cfg = DedupConfig(bits=10, container_bytes=64 * 1024, delta=True)
    b = lifecycle.generated_backups(spark, cfg, files=6, kilobytes=16, days=15)
    s = lifecycle.simulate(b, cfg, 15).orderBy("day").toPandas()
    assert s["written"].iloc[0] > s["written"].iloc[-1] and (s["logical"] > 0).all()
    assert lifecycle.restores(b, cfg, 15).filter("not verified").count() == 0


def test_sql_functions(spark):
    from chunkloom.functions import sql

    sql.register(spark)
    body = generate.pool(5000, 1)
    spark.createDataFrame([(1, body, body[:2000] + b"x" + body[2000:]), (2, b"", b"q"), (3, None, b"z")], "id long, a binary, b binary").createOrReplaceTempView("pairs")
    got = spark.sql("SELECT id, delta_apply(a, delta_encode(a, b), octet_length(b)) = b AS same, first_diff(a, b) AS d, size(cdc_cuts(a, 8)) AS n FROM pairs ORDER BY id").collect()
    assert [x.same for x in got] == [True] * 3 and got[0].d == 2000 and got[1].d == 0
    parts = spark.sql("SELECT p.id, c.* FROM pairs p, LATERAL chunk_bytes(p.a, 8) c WHERE p.id = 1").collect()
    assert len(parts) == got[0].n and sum(x.len for x in parts) == 5000
    ops = spark.sql("SELECT o.op FROM pairs p, LATERAL parse_record(delta_encode(p.a, p.b)) o WHERE p.id = 1 ORDER BY o.k").collect()
    assert [x.op for x in ops] == ["copy", "insert", "copy"]


def test_files_and_store_on_disk(spark, tmp_path):
    from chunkloom.sources.tables import binary_files

    for i in range(3):
        (tmp_path / f"f{i}.bin").write_bytes(generate.pool(3000, i // 2))
    f = binary_files(spark, str(tmp_path))
    c = chunking.fixed_chunks(f.select("file_id", "body"), 512, keep=True)
    new = c.groupBy("fp").agg(F.min("ord").alias("chunk_id"), F.min_by("bytes", "ord").alias("bytes"))
    packed = store.pack(new.select(F.lit(0).alias("shard"), "chunk_id", (F.octet_length("bytes") + 1).cast("long").alias("rec_len")), 2048, "shard")
    store.write_store(packed, new, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 12


def test_report_functions(spark):
    from chunkloom.functions import report

    r = spark.createDataFrame([(0, [10.0, 10.0]), (127, []), (128, []), (16384, [])], "n long, v array<double>").select("n", report.varint_length(F.col("n")).alias("len"), report.smoothed(F.col("v")).alias("s"), report.bit(F.col("n"), 7).alias("b"), report.split_key(report.mark_key(F.col("n"), F.lit(3))).alias("k"), report.padded_range(F.lit(0.0), F.lit(100.0)).alias("p")).orderBy("n").collect()
    assert [x.len for x in r] == [1, 1, 2, 3] and abs(r[0].s - 1.9) < 1e-9 and [x.b for x in r] == [0, 0, 1, 0] and r[2].k.file_id == 128 and r[2].k.day == 3 and r[0].p.high == 118.0


def test_restore_tells_where_bodies_differ_without_python(spark):
    body = bytes(range(256)) * 40
    bodies = {0: body, 1: body, 2: body, 3: body + b"x", 4: b"", 5: body[:-1], 6: b"a" + body[1:], 7: body[:5000] + b"?" + body[5001:]}
    pieces = {f: [(f, k, k) for k in range(40)] for f in bodies if f != 4}
    pieces[1] = pieces[1][:7] + [(1, 7, 99)] + pieces[1][8:]  # a chunk that isn't stored
    pieces[2] = pieces[2][::-1]  # in any order
    recipe = spark.createDataFrame([r for p in pieces.values() for r in p], "file_id long, seq int, chunk_id long")
    payload = spark.createDataFrame([(k, body[k * 256 : k * 256 + 256]) for k in range(40)], "chunk_id long, bytes binary")
    got = store.restore(recipe, payload, spark.createDataFrame(list(bodies.items()), "file_id long, body binary"))
    assert {x.file_id: (x.bytes, x.chunks, x.missing, x.first_diff, x.verified) for x in got.collect()} == {0: (10240, 40, 0, -1, True), 1: (9984, 40, 1, -1, False), 2: (10240, 40, 0, -1, True), 3: (10240, 40, 0, 10240, False), 4: (0, 0, 0, -1, True), 5: (10240, 40, 0, 10239, False), 6: (10240, 40, 0, 0, False), 7: (10240, 40, 0, 5000, False)}
    assert "InPandas" not in got._jdf.queryExecution().toString()


def test_a_content_is_cut_once_however_many_days_have_it(monkeypatch):
    r = random.Random(8)
    old, new = (bytes(r.randrange(256) for _ in range(6000)) for _ in range(2))
    calls, real = [], lifecycle.cdc_spans
    monkeypatch.setattr(lifecycle, "cdc_spans", lambda body, cfg: calls.append(body) or real(body, cfg))
    by_day = pd.DataFrame([(d, f, old if d < 5 else new) for d in range(10) for f in (1, 2)], columns=["day", "file_id", "body"])
    packed = pd.DataFrame([(f, list(days), b) for f in (2, 1) for days, b in ((range(5), old), (range(5, 10), new))], columns=["file_id", "days", "body"])
    cfg = DedupConfig(bits=9, container_bytes=4096, retention=2, delta=True)
    want = lifecycle.live_through(by_day, cfg, 10)
    assert len(calls) == 2
    got = lifecycle.live_through(packed, cfg, 10)
    assert len(calls) == 4 and all(a.equals(b) for a, b in zip(got, want, strict=True))


def test_several_stores_in_one_pass(spark):
    cfgs = [DedupConfig(bits=9), DedupConfig(bits=9, delta=True), DedupConfig(bits=8)]
    df = spark.createDataFrame(month(days=5).assign(shard=0))
    each = lifecycle.simulate_each(df, cfgs, 5).toPandas()
    for k, cfg in enumerate(cfgs):
        want = lifecycle.simulate(df, cfg, 5).orderBy("day").toPandas()
        assert each[each.k == k].drop(columns="k").sort_values("day", ignore_index=True).equals(want)


def test_restore_check_has_the_files_that_its_sql_has(spark, tmp_path):
    import duckdb

    from chunkloom.plans import store as queries
    from chunkloom.plans.registry import ORACLE

    rows = [(0, "abc" * 300), (1, ""), (2, None), (3, "x"), (None, "abc" * 100), (None, ""), (4, "é" * 128 + "abc" * 300)]
    spark.createDataFrame([(i, t, "en", "web") for i, t in rows], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.restore_check(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE['restore_check']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 3
