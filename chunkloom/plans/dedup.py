"""Queries over chunks, index decisions and their costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.config import ENTRY, DedupConfig
from chunkloom.functions import report
from chunkloom.functions.bloom import gated
from chunkloom.functions.fingerprint import bucket, truncated
from chunkloom.functions.gear import gear_table, probing_spans
from chunkloom.operators import chunking, dedup, indexes
from chunkloom.operators.store import STREAM
from chunkloom.plans.registry import query
from chunkloom.sources.generate import spliced
from chunkloom.sources.storage import stored
from chunkloom.sources.tables import FILES_SQL, blocks_sql, files, table

BLOCK = 256
BLOCKS = f"WITH {FILES_SQL}, {blocks_sql(BLOCK)}"
PLAIN = DedupConfig(bits=8, bounded=False)
FAST = DedupConfig(bits=9)
NORMAL = DedupConfig(bits=9, normalized=True)
RATIO = "round(CASE WHEN {1} > 0 THEN {0}::DOUBLE / {1} ELSE 0 END, 6)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(files(spark, sf_dir), BLOCK)


def gear_sql(bits: int, body: str = "files", seven: bool = False) -> str:
    """DuckDB CTEs: ``hashed`` (file_id, i, the low ``bits`` bits of the rolling hash after byte i, 0-based); ``seven``: by the low seven bits of each byte."""
    table = gear_table().tolist()
    rows = ", ".join(f"('{i:02X}', {table[i & 127 if seven else i]})" for i in range(256))
    total = " + ".join(f"coalesce(lag(g, {k}) OVER w, 0) * {1 << k}" for k in range(bits))
    return f"""gear AS (SELECT * FROM (VALUES {rows}) AS t(hx, g)),
bytes AS (SELECT file_id, i, substr(hx, (2 * i + 1)::BIGINT, 2) AS hx FROM (SELECT file_id, hex(body) AS hx, octet_length(body) AS n FROM {body}), range(n::BIGINT) t(i)),
hashed AS (SELECT file_id, i, (({total}) & {(1 << bits) - 1})::BIGINT AS h FROM bytes JOIN gear USING (hx) WINDOW w AS (PARTITION BY file_id ORDER BY i))"""


def plain_cdc_sql(bits: int, body: str = "files") -> str:
    """DuckDB CTE ``cdc`` of plain content-defined chunks: file_id, seq, off, len, fp."""
    return f"""{gear_sql(bits, body)},
ends AS (SELECT file_id, i + 1 AS e FROM hashed WHERE h = 0 UNION SELECT file_id, octet_length(body) FROM {body} WHERE octet_length(body) > 0),
spans AS (SELECT file_id, coalesce(lag(e) OVER w, 0) AS off, e FROM ends WINDOW w AS (PARTITION BY file_id ORDER BY e)),
cdc AS (SELECT s.file_id, (row_number() OVER (PARTITION BY s.file_id ORDER BY off) - 1)::INT AS seq, off::BIGINT AS off, (e - off)::BIGINT AS len,
               md5(f.body[off + 1 : e]) AS fp, f.lang, f.source FROM spans s JOIN {body} f ON s.file_id = f.file_id)"""


def bounded_cdc_sql(cfg: DedupConfig) -> str:
    """DuckDB CTE ``cdc`` with size bounds (and two masks): the next end is picked from the candidates, file by file."""
    hard, easy = cfg.mask_bits
    mean = 1 << cfg.bits
    return f"""{gear_sql(max(hard, easy))},
cand AS (SELECT file_id, list(i + 1 ORDER BY i) FILTER (h & {(1 << hard) - 1} = 0) AS hard, list(i + 1 ORDER BY i) FILTER (h & {(1 << easy) - 1} = 0) AS easy, max(i) + 1 AS n FROM hashed GROUP BY file_id),
step AS (SELECT file_id, 0::BIGINT AS off, 0::BIGINT AS e, 0 AS k FROM cand UNION ALL
  SELECT s.file_id, s.e, least(c.n,
    coalesce(list_min(list_filter(c.hard, lambda x: x >= s.e + {cfg.min_size} AND x < s.e + {mean})),
             least(s.e + {cfg.max_size}, coalesce(list_min(list_filter(c.easy, lambda x: x >= s.e + {max(mean, cfg.min_size)})), s.e + {cfg.max_size})))), s.k + 1
  FROM step s JOIN cand c ON s.file_id = c.file_id WHERE s.e < c.n),
cdc AS (SELECT s.file_id, (k - 1)::INT AS seq, off, e - off AS len, md5(f.body[off + 1 : e]) AS fp FROM step s JOIN files f ON s.file_id = f.file_id WHERE k > 0)"""


@query(f"""WITH {FILES_SQL}, o AS (SELECT md5(body) AS fp, source, octet_length(body) AS len FROM files),
g AS (SELECT source, fp, count(*) AS n, max(len) AS len FROM o GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS files, count(*) AS uniques, sum(n * len)::BIGINT AS logical, sum(len)::BIGINT AS written, {RATIO.format('sum(n * len)', 'sum(len)')} AS ratio FROM g GROUP BY source""")
def file_dedup_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files as chunks, each source for itself."""
    occ = chunking.whole_files(files(spark, sf_dir)).withColumn("ord", F.col("file_id"))
    t = dedup.totals(dedup.occurrences(occ, "source"), "source")
    return t.select("source", F.col("chunks").alias("files"), "uniques", "logical", "written", "ratio")


TOTALS = f"count(*) AS uniques, sum(n)::BIGINT AS chunks, sum(n - 1)::BIGINT AS dups, sum(n * len)::BIGINT AS logical, sum(len)::BIGINT AS written, (count(*) * {ENTRY})::BIGINT AS index_ram, {RATIO.format('sum(n * len)', 'sum(len)')} AS ratio"


@query(f"{BLOCKS}, g AS (SELECT lang, fp, count(*) AS n, max(len) AS len FROM chunks GROUP BY ALL) SELECT lang, {TOTALS} FROM g GROUP BY lang")
def fixed_chunk_dedup_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed blocks, first occurrence by language."""
    return dedup.totals(dedup.occurrences(blocks(spark, sf_dir), "lang"), "lang")


@query(f"""{BLOCKS}, d AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ord) = 1 AS new FROM chunks)
SELECT lang, source, count(*) AS chunks, count(*) FILTER (new) AS uniques, sum(len)::BIGINT AS logical, coalesce(sum(len) FILTER (new), 0)::BIGINT AS written FROM d GROUP BY ROLLUP (lang, source)""")
def fixed_chunk_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who pays for each chunk, with subtotals."""
    d = dedup.decisions(blocks(spark, sf_dir))
    new = F.col("kind") == "new"
    return d.rollup("lang", "source").agg(F.count("*").alias("chunks"), F.count_if(new).alias("uniques"), F.sum("len").alias("logical"), F.sum(F.when(new, F.col("len")).otherwise(0)).alias("written"))


SCOPES = f"""{BLOCKS}, a AS (SELECT fp, count(*) AS n, max(len) AS len FROM chunks GROUP BY fp), b AS (SELECT source, fp, count(*) AS n, max(len) AS len FROM chunks GROUP BY ALL),
c AS (SELECT file_id, fp, count(*) AS n, max(len) AS len FROM chunks GROUP BY ALL)
SELECT 'global' AS scope, {TOTALS} FROM a UNION ALL SELECT 'source', {TOTALS} FROM b UNION ALL SELECT 'file', {TOTALS} FROM c"""


@query(SCOPES)
def dedup_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dedup across everything, within a source, within a file."""
    c = blocks(spark, sf_dir)
    parts = [dedup.totals(dedup.occurrences(c, *by)).select(F.lit(name).alias("scope"), "*") for name, by in (("global", []), ("source", ["source"]), ("file", ["file_id"]))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def shifted_sql(insert: str) -> str:
    return f"moved AS (SELECT file_id, lang, source, encode('{insert}' || coalesce(text, '')) AS body FROM (SELECT doc_id AS file_id, lang, source, text FROM documents))"


COVER = f"""SELECT c.lang, sum(c.len)::BIGINT AS bytes, coalesce(sum(c.len) FILTER (o.fp IS NOT NULL), 0)::BIGINT AS covered, {RATIO.format('coalesce(sum(c.len) FILTER (o.fp IS NOT NULL), 0)', 'sum(c.len)')} AS coverage
FROM {{0}} c LEFT JOIN (SELECT DISTINCT lang, fp, len FROM {{1}}) o ON c.fp = o.fp AND c.len = o.len AND c.lang = o.lang GROUP BY c.lang"""


@query(f"{BLOCKS}, {shifted_sql('XYZ')}, {blocks_sql(BLOCK, 'moved').replace('chunks AS', 'moved_chunks AS')} {COVER.format('moved_chunks', 'chunks')}")
def fixed_vs_shifted_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a shifted copy fixed blocks find again: next to nothing."""
    f = files(spark, sf_dir)
    moved = f.withColumn("body", F.concat(F.encode(F.lit("XYZ"), "UTF-8"), "body"))
    return dedup.coverage(chunking.fixed_chunks(moved, BLOCK), chunking.fixed_chunks(f, BLOCK), "lang")


@query(f"WITH {FILES_SQL}, {plain_cdc_sql(8)}, {shifted_sql('XYZ')}, {plain_cdc_sql(8, 'moved').replace('gear AS', 'gear2 AS').replace('JOIN gear ', 'JOIN gear2 ').replace('bytes AS', 'bytes2 AS').replace('FROM bytes ', 'FROM bytes2 ').replace('hashed AS', 'hashed2 AS').replace('FROM hashed ', 'FROM hashed2 ').replace('ends AS', 'ends2 AS').replace('FROM ends ', 'FROM ends2 ').replace('spans AS', 'spans2 AS').replace('FROM spans ', 'FROM spans2 ').replace('cdc AS', 'cdc2 AS')} {COVER.format('cdc2', 'cdc')}")
def cdc_shift_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with content-defined chunks: they find their boundaries again."""
    f = files(spark, sf_dir)
    moved = f.withColumn("body", F.concat(F.encode(F.lit("XYZ"), "UTF-8"), "body"))
    return dedup.coverage(chunking.cdc_chunks(moved, PLAIN), chunking.cdc_chunks(f, PLAIN), "lang")


@query(f"WITH {FILES_SQL}, {plain_cdc_sql(8)} SELECT file_id, seq, off, len, fp FROM cdc")
def gear_cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain content-defined chunks of every file."""
    return chunking.cdc_chunks(files(spark, sf_dir), PLAIN).select("file_id", "seq", "off", "len", "fp")


@query(f"WITH {FILES_SQL}, {plain_cdc_sql(8)}, g AS (SELECT lang, fp, count(*) AS n, max(len) AS len FROM cdc GROUP BY ALL) SELECT lang, {TOTALS} FROM g GROUP BY lang")
def gear_cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dedup of content-defined chunks by language."""
    return dedup.totals(dedup.occurrences(chunking.cdc_chunks(files(spark, sf_dir), PLAIN), "lang"), "lang")


@query(f"WITH RECURSIVE {FILES_SQL}, {bounded_cdc_sql(FAST)} SELECT file_id, seq, off, len, fp FROM cdc")
def fastcdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a least and a greatest size."""
    return chunking.cdc_chunks(files(spark, sf_dir), FAST).select("file_id", "seq", "off", "len", "fp")


@query(f"WITH RECURSIVE {FILES_SQL}, {bounded_cdc_sql(NORMAL)} SELECT file_id, seq, off, len, fp FROM cdc")
def normalized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a stricter mask below the mean and a looser one above."""
    return chunking.cdc_chunks(files(spark, sf_dir), NORMAL).select("file_id", "seq", "off", "len", "fp")


def size_stats(chunks: DataFrame, name: str) -> DataFrame:
    """Count, mean and the order statistics at floor(n q) of chunk lengths. By length first, so ranks are sums over a few thousand rows."""
    by_len = chunks.groupBy("len").agg(F.count("*").alias("n"))
    w = Window.orderBy("len")  # one row per distinct length: bounded by the greatest chunk
    up = by_len.select("len", "n", F.sum("n").over(w).alias("up"), F.sum("n").over(Window.partitionBy()).alias("all"))
    at = lambda q: F.min(F.when(F.col("up") > F.floor(F.col("all") * q), F.col("len")))
    return up.agg(F.sum("n").alias("chunks"), F.round(F.sum(F.col("n") * F.col("len")) / F.sum("n"), 6).alias("mean"), at(0.05).alias("p05"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("len").alias("longest")).select(F.lit(name).alias("config"), "*", (F.col("p95") - F.col("p05")).alias("span"))


STATS = "SELECT '{0}' AS config, count(*) AS chunks, round(avg(len), 6) AS mean, {1}[1 + floor(count(*) * 0.05)::INT] AS p05, {1}[1 + floor(count(*) * 0.5)::INT] AS p50, {1}[1 + floor(count(*) * 0.95)::INT] AS p95, max(len) AS longest, {1}[1 + floor(count(*) * 0.95)::INT] - {1}[1 + floor(count(*) * 0.05)::INT] AS span FROM cdc"


@query(f"WITH {FILES_SQL}, {plain_cdc_sql(8)} {STATS.format('plain', 'list(len ORDER BY len)')}")
def chunk_len_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of plain content-defined chunks."""
    return size_stats(chunking.cdc_chunks(files(spark, sf_dir), PLAIN), "plain")


@query(f"WITH RECURSIVE {FILES_SQL}, {bounded_cdc_sql(NORMAL)} {STATS.format('normalized', 'list(len ORDER BY len)')}")
def fastcdc_nc_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes under normalized chunking: a narrower spread."""
    return size_stats(chunking.cdc_chunks(files(spark, sf_dir), NORMAL), "normalized")


SIZES = {f"{b}{' normalized' if n else ''}": DedupConfig(bits=b, normalized=n) for b in (8, 9, 10) for n in (False, True)}


@query(" UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {FILES_SQL}, {bounded_cdc_sql(cfg)} {STATS.format(name, 'list(len ORDER BY len)')})" for name, cfg in SIZES.items()))
def chunk_size_by_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by mean and masks."""
    f = files(spark, sf_dir)
    parts = [size_stats(chunking.cdc_chunks(f, cfg), name) for name, cfg in SIZES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query()
def ae_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes under the hash-less asymmetric extremum."""
    return size_stats(chunking.ae_chunks(files(spark, sf_dir)), "extremum")


@query(f"WITH {FILES_SQL}, {plain_cdc_sql(8)} SELECT least(17, floor(len / {6 * 256} * 18))::INT AS bin, count(*) AS n, min(len) AS shortest, max(len) AS longest FROM cdc GROUP BY bin")
def chunk_len_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighteen bins up to six times the mean."""
    c = chunking.cdc_chunks(files(spark, sf_dir), PLAIN)
    return c.groupBy(F.least(F.lit(17), F.floor(F.col("len") / (6 * 256) * 18)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("len").alias("shortest"), F.max("len").alias("longest"))


@query(f"WITH {FILES_SQL}, {plain_cdc_sql(8)} SELECT round(1 - sum(greatest(least(len, 64) - 32, 0)) / sum(len), 6) AS hashed_share FROM cdc")
def cut_point_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of bytes hashed if the start of each chunk is skipped."""
    return chunking.cdc_chunks(files(spark, sf_dir), PLAIN).agg(chunking.hashed_share(F.col("len"), 64).alias("hashed_share"))


@query(f"{BLOCKS}, u AS (SELECT DISTINCT fp FROM chunks), b AS (SELECT (('0x' || substr(fp, 1, 15))::BIGINT % 1024)::BIGINT AS bucket, count(*) AS n FROM u GROUP BY 1) SELECT bucket, n, n - 1 AS collisions FROM b")
def index_bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and collisions in each bucket of the index."""
    u = blocks(spark, sf_dir).select("fp").distinct()
    return u.groupBy(bucket(F.col("fp")).alias("bucket")).agg(F.count("*").alias("n")).withColumn("collisions", F.col("n") - 1)


def near_sql(bits: int, verify: bool) -> str:
    key = f"('0x' || substr(fp, 1, 15))::BIGINT & {(1 << bits) - 1}" if bits else "fp"
    unique, written, false = ("count(*)", "sum(len)", "0::BIGINT") if verify else ("count(*) FILTER (fo = lead)", "sum(len) FILTER (fo = lead)", "coalesce(sum(n) FILTER (fo <> lead), 0)::BIGINT")
    return f"""SELECT {bits} AS bits, {str(verify).lower()} AS verified, sum(n)::BIGINT AS chunks, {unique}::BIGINT AS uniques, {false} AS false_hits, sum(n * len)::BIGINT AS logical, ({written})::BIGINT AS written,
       (count(DISTINCT key) * {ENTRY})::BIGINT AS index_ram, {RATIO.format('sum(n * len)', f'({written})')} AS ratio
FROM (SELECT *, min(fo) OVER (PARTITION BY key) AS lead FROM (SELECT {key} AS key, fp, count(*) AS n, max(len) AS len, min(ord) AS fo FROM chunks GROUP BY 1, 2))"""


@query(f"{BLOCKS} {near_sql(16, True)}")
def near_exact_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of 16 bits, checked against the whole fingerprint."""
    return dedup.near_exact(blocks(spark, sf_dir), 16, True)


@query(f"{BLOCKS} {near_sql(12, False)}")
def near_exact_unverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of 12 bits, trusted."""
    return dedup.near_exact(blocks(spark, sf_dir), 12, False)


SWEEP = [(b, v) for b in (0, 32, 16, 12, 8, 4) for v in (True, False)]


@query(f"{BLOCKS} {' UNION ALL '.join(near_sql(b, v) for b, v in SWEEP)}")
def near_exact_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All key lengths, verified or not."""
    return dedup.near_exact_grid(blocks(spark, sf_dir), SWEEP)


@query(f"""{BLOCKS}, g AS (SELECT fp, count(*) AS n, max(len) AS len FROM chunks GROUP BY fp), k AS (SELECT unnest([24, 12, 6, 3, 1])::BIGINT AS k)
SELECT k, count(*) FILTER (('0x' || substr(fp, 1, 15))::BIGINT % 24 < k) AS sampled, sum(n - 1)::BIGINT AS duplicates, coalesce(sum(n - 1) FILTER (('0x' || substr(fp, 1, 15))::BIGINT % 24 < k), 0)::BIGINT AS found,
       {RATIO.format("coalesce(sum(n - 1) FILTER (('0x' || substr(fp, 1, 15))::BIGINT % 24 < k), 0)", 'sum(n - 1)')} AS recall FROM g, k GROUP BY k""")
def near_exact_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of a sample of fingerprints: what share of duplicates it still finds."""
    g = dedup.occurrences(blocks(spark, sf_dir)).select(F.pmod(truncated(F.col("fp"), 0), F.lit(24)).alias("m"), F.col("n") - 1).toDF("m", "d").groupBy("m").agg(F.count("*").alias("c"), F.sum("d").alias("d"))
    k = spark.createDataFrame([(x,) for x in (24, 12, 6, 3, 1)], "k long")
    hit = F.col("m") < F.col("k")  # 24 rows by 5
    out = g.crossJoin(F.broadcast(k)).groupBy("k").agg(F.sum(F.when(hit, F.col("c")).otherwise(0)).alias("sampled"), F.sum("d").alias("duplicates"), F.sum(F.when(hit, F.col("d")).otherwise(0)).alias("found"))
    return out.withColumn("recall", dedup.ratio(F.col("found"), F.col("duplicates")))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in streams of consecutive files, each with its fingerprint's first place in the whole store: decided once and stored, as several strategies read them."""
    return stored(dedup.decisions(blocks(spark, sf_dir)).withColumnRenamed("chunk_id", "first").withColumn("shard", F.floor(F.col("file_id") / STREAM)), "streams")


@query()
def strategy_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash table, Extreme Binning and SiLo over the same stream, the best of each cost marked."""
    c = streams(spark, sf_dir)
    parts = [indexes.strategy_totals(c, DedupConfig(index_kind=k, container_bytes=32 * 1024)) for k in ("hash", "eb", "silo")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    every = Window.partitionBy()  # three rows

    def best(name: str, least: bool):
        edge = (F.min if least else F.max)(name).over(every)
        return ((F.col(name) == edge) & (F.count("*").over(Window.partitionBy(name)) == 1)).alias(f"best_{name}")

    return out.select("*", best("index_ram", True), best("disk_reads", True), best("seq_reads", True), best("false_neg", True), best("ratio", False))


@query()
def eb_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extreme Binning by first and by least fingerprint."""
    c = streams(spark, sf_dir)
    a, b = (indexes.strategy_totals(c, DedupConfig(index_kind="eb", eb_representative=r)).withColumn("representative", F.lit(r)) for r in ("first", "min"))
    return a.unionByName(b)


@query()
def silo_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SiLo by segment size."""
    c, out = streams(spark, sf_dir), None
    for n in (4, 16, 64):
        one = indexes.strategy_totals(c, DedupConfig(index_kind="silo", segment_chunks=n)).withColumn("segment_chunks", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


HASH_ROW = f"""{BLOCKS}, g AS (SELECT fp, count(*) AS n, max(len) AS len FROM chunks GROUP BY fp)
SELECT 'hash' AS strategy, sum(n)::BIGINT AS chunks, count(*) AS fresh, sum(n - 1)::BIGINT AS dups, sum(n * len)::BIGINT AS logical, sum(len)::BIGINT AS stored, (count(*) * {ENTRY})::BIGINT AS index_ram, {RATIO.format('sum(n * len)', 'sum(len)')} AS ratio FROM g"""


@query(HASH_ROW)
def hash_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash table's row over the whole store: an aggregation by fingerprint, without streams."""
    t = dedup.totals(dedup.occurrences(blocks(spark, sf_dir)))
    return t.select(F.lit("hash").alias("strategy"), "chunks", F.col("uniques").alias("fresh"), "dups", "logical", F.col("written").alias("stored"), "index_ram", "ratio")


@query(f"{BLOCKS} SELECT file_id, min_by(fp, seq) AS first_rep, min(fp) AS min_rep FROM chunks GROUP BY file_id")
def eb_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's representatives."""
    c = blocks(spark, sf_dir)
    return c.groupBy("file_id").agg(F.min_by("fp", "seq").alias("first_rep"), F.min("fp").alias("min_rep"))


@query(f"""{BLOCKS}, r AS (SELECT file_id, min(fp) AS rep FROM chunks GROUP BY file_id), g AS (SELECT rep, fp, count(*) AS n, max(len) AS len FROM chunks JOIN r USING (file_id) GROUP BY ALL)
SELECT count(DISTINCT rep) AS bins, sum(n)::BIGINT AS chunks, count(*) AS fresh, sum(n * len)::BIGINT AS logical, sum(len)::BIGINT AS stored, {RATIO.format('sum(n * len)', 'sum(len)')} AS ratio FROM g""")
def eb_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extreme Binning without order."""
    return indexes.binned(blocks(spark, sf_dir))


SEGMENTS = [4, 16, 64]


@query(f"""{BLOCKS}, z AS (SELECT unnest({SEGMENTS})::INT AS size), s AS (SELECT size, file_id, seq // size AS seg, ord, fp, len, min(ord) OVER (PARTITION BY fp, size) < ord AS dup FROM chunks, z),
t AS (SELECT *, min(fp) OVER w AS rep, min(ord) OVER w AS b, min(ord) OVER (PARTITION BY size, file_id, seg, fp) < ord AS own FROM s WINDOW w AS (PARTITION BY size, file_id, seg)),
h AS (SELECT size, rep, min(b) AS head, count(DISTINCT b) AS segments FROM t GROUP BY ALL), f AS (SELECT t.*, h.head FROM t JOIN h USING (size, rep)),
hs AS (SELECT DISTINCT size, head, file_id, seg FROM f WHERE b = head), bl AS (SELECT hs.size, hs.head, s.fp, min(s.ord) AS there FROM hs JOIN s ON s.size = hs.size AND s.file_id = hs.file_id AND s.seg BETWEEN hs.seg - 1 AND hs.seg + 1 GROUP BY ALL),
x AS (SELECT f.*, f.own OR (f.head <> f.b AND coalesce(bl.there < f.ord, false)) AS found FROM f LEFT JOIN bl ON bl.size = f.size AND bl.head = f.head AND bl.fp = f.fp),
i AS (SELECT size, count(*) AS entries, sum(segments - 1)::BIGINT AS reads FROM h GROUP BY size),
o AS (SELECT size, count(*) AS chunks, count(*) FILTER (dup) AS dups, count(*) FILTER (found) AS found, count(*) FILTER (dup AND NOT found) AS false_neg, sum(len)::BIGINT AS logical, coalesce(sum(len) FILTER (NOT found), 0)::BIGINT AS stored FROM x GROUP BY size)
SELECT size AS segment_chunks, chunks, dups, found, false_neg, logical, stored, {RATIO.format('logical', 'stored')} AS ratio, {RATIO.format('found', 'dups')} AS recall, entries, entries * {ENTRY} AS index_ram, reads FROM o JOIN i USING (size)""")
def silo_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SiLo without order and over the whole store, by segment size: what share of all duplicates a block's neighbourhood finds."""
    return indexes.segmented(blocks(spark, sf_dir), SEGMENTS)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: ASCII characters that aren't letters or digits. All other scripts are words.
APART = "[\\x01-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Words of a shingle; a shorter text is one shingle.
SHINGLE = 5


def shingles_sql(key: str, rows: str) -> str:
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{APART}'), lambda x: x <> '')"
    runs = f"list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))"
    return f"SELECT DISTINCT {key}, unnest({runs}) AS s FROM (SELECT {key}, {words} AS w FROM {rows}) WHERE len(w) > 0"


#: Hashes of different runs that are broadcast at most (8 bytes each).
KNOWN = 2_000_000
RUN = [f"w{k}" for k in range(SHINGLE)]


def shingles(df: DataFrame, key: str) -> DataFrame:
    """The distinct runs of five words of each ``key``."""
    return shingle_rows(df, key).select(key, run_text()).distinct()


def run_text() -> Column:
    return F.concat_ws(" ", *(F.col("x").getField(n) for n in RUN)).alias("s")


def shingle_rows(df: DataFrame, key: str) -> DataFrame:
    """x, the runs of five words of each row (fewer words are one run), and their hash h."""
    text = F.coalesce("text", F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    words, names = F.array_remove(F.split(low, APART), ""), RUN
    runs = F.arrays_zip(*(F.expr(f"slice(w, {k + 1}, greatest(size(w) - {SHINGLE - 1}, 0))").alias(n) for k, n in enumerate(names)))
    short = F.array(F.struct(*(F.get("w", F.lit(k)).alias(n) for k, n in enumerate(names))))
    each = df.select(key, words.alias("w")).filter(F.size("w") > 0).select(key, F.explode(F.when(F.size("w") >= SHINGLE, runs).otherwise(short)).alias("x"))
    return each.select(key, "x", F.xxhash64(*(F.col("x").getField(n) for n in names)).alias("h"))


@query(f"""WITH p AS ({shingles_sql('item_id', 'benchmark')}), d AS ({shingles_sql('file_id', '(SELECT doc_id AS file_id, text FROM documents)')}),
n AS (SELECT item_id, count(*) AS shingles FROM p GROUP BY item_id), m AS (SELECT item_id, file_id, count(*) AS shared FROM p JOIN d USING (s) GROUP BY ALL)
SELECT item_id, file_id, shingles, shared FROM m JOIN n USING (item_id) WHERE shared >= 0.8 * shingles""")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files hold at least 0.8 of a benchmark passage's runs of five words: coverage as a join on shingles, of any script and length.

    Only runs that an item has leave the documents. Items meet files by their rarest runs: who holds 0.8 of n runs holds one of any n - ceil(0.8 n) + 1 of them.
    """
    benchmark = table(spark, sf_dir, "benchmark")
    items, known = shingles(benchmark, "item_id"), shingle_rows(benchmark, "item_id").select("h").distinct()
    known = F.broadcast(known) if known.limit(KNOWN + 1).count() <= KNOWN else known
    words = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "file_id")
    found = stored(shingle_rows(words, "file_id").join(known, "h", "left_semi").select("file_id", run_text()).distinct(), "shingles")
    df = found.groupBy("s").agg(F.count("*").alias("df"))
    w = Window.partitionBy("item_id")
    runs = items.join(df, "s", "left").select("item_id", "s", F.count("*").over(w).alias("shingles"), F.row_number().over(w.orderBy(F.coalesce("df", F.lit(0)), "s")).alias("rank"))
    rare = runs.filter(F.col("rank") <= F.col("shingles") - F.ceil(F.col("shingles") * 0.8) + 1)
    pairs = rare.join(found, "s").select("item_id", "file_id").distinct()
    shared = pairs.join(runs.select("item_id", "s", "shingles"), "item_id").join(found, ["file_id", "s"]).groupBy("item_id", "file_id", "shingles").agg(F.count("*").alias("shared"))
    return shared.filter(F.col("shared") >= 0.8 * F.col("shingles")).select("item_id", "file_id", "shingles", "shared")


@query(f"{BLOCKS} SELECT lang, count(DISTINCT sha256(fp || 'k')) AS uniques, count(*) AS chunks FROM chunks GROUP BY lang")
def convergent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convergent encryption: the key is the content's hash, so equal chunks have equal ciphertexts and dedup still works."""
    c = chunking.fixed_chunks(files(spark, sf_dir), BLOCK, keep=True)
    key = F.substring(F.sha2("bytes", 256), 1, 32)
    sealed = F.aes_encrypt("bytes", F.encode(key, "UTF-8"), F.lit("ECB"), F.lit("PKCS"))
    return c.groupBy("lang", F.md5(sealed).alias("cipher")).agg(F.count("*").alias("n")).groupBy("lang").agg(F.count("*").alias("uniques"), F.sum("n").alias("chunks"))


@query(f"""{BLOCKS} SELECT 'content key' AS scheme, count(DISTINCT fp) AS uniques, count(*) AS chunks, count(DISTINCT fp) FILTER (fp IN (SELECT fp FROM chunks GROUP BY fp HAVING count(DISTINCT source) > 1)) AS confirmable FROM chunks
UNION ALL SELECT 'user key', count(DISTINCT source || fp), count(*), 0 FROM chunks""")
def key_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content keys against keys with a user's secret: what dedups, and which chunks' presence a second user can confirm."""
    c = blocks(spark, sf_dir)
    per = c.groupBy("fp").agg(F.count("*").alias("n"), F.count_distinct("source").alias("users"))
    content = per.agg(F.count("*").alias("uniques"), F.sum("n").alias("chunks"), F.count_if(F.col("users") > 1).alias("confirmable")).select(F.lit("content key").alias("scheme"), "*")
    user = per.agg(F.sum("users").alias("uniques"), F.sum("n").alias("chunks"), F.lit(0).cast("long").alias("confirmable")).select(F.lit("user key").alias("scheme"), "*")
    return content.unionByName(user)


@query(f"""{BLOCKS}, d AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ord) > 1 AS dup FROM chunks),
e AS (SELECT *, lag(dup) OVER w AS before, lead(dup) OVER w AS after FROM d WINDOW w AS (PARTITION BY file_id ORDER BY seq))
SELECT lang, count(*) FILTER (NOT dup) AS new_chunks, count(*) FILTER (NOT dup AND (coalesce(before, false) OR coalesce(after, false))) AS beside_dup FROM e GROUP BY lang""")
def duplicate_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New chunks beside duplicates: likely similar to their neighbour's neighbours, so worth a delta."""
    d = dedup.decisions(blocks(spark, sf_dir)).withColumn("dup", F.col("kind") == "dup")
    w = Window.partitionBy("file_id").orderBy("seq")
    e = d.select("lang", "dup", F.lag("dup").over(w).alias("before"), F.lead("dup").over(w).alias("after"))
    beside = ~F.col("dup") & (F.coalesce("before", F.lit(False)) | F.coalesce("after", F.lit(False)))
    return e.groupBy("lang").agg(F.count_if(~F.col("dup")).alias("new_chunks"), F.count_if(beside).alias("beside_dup"))


@query(f"""{BLOCKS}, f AS (SELECT file_id, min(md5('1' || fp)) AS a, min(md5('2' || fp)) AS b, min(md5('3' || fp)) AS c FROM chunks GROUP BY file_id)
SELECT md5(a || b || c) AS super_feature, count(*) AS files, min(file_id) AS first_file FROM f GROUP BY 1 HAVING count(*) > 1""")
def superfeature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files alike by super-feature: the least of three transforms of their fingerprints."""
    f = blocks(spark, sf_dir).groupBy("file_id").agg(*(F.min(F.md5(F.concat(F.lit(str(i)), "fp"))).alias(x) for i, x in ((1, "a"), (2, "b"), (3, "c"))))
    return f.groupBy(F.md5(F.concat("a", "b", "c")).alias("super_feature")).agg(F.count("*").alias("files"), F.min("file_id").alias("first_file")).filter("files > 1")


@query(f"""{BLOCKS}, s AS (SELECT DISTINCT file_id, fp FROM chunks), r AS (SELECT fp, min(file_id) AS owner FROM s GROUP BY fp HAVING count(*) BETWEEN 2 AND 1000),
m AS (SELECT s.file_id, r.owner, count(*) AS overlap FROM s JOIN r USING (fp) WHERE s.file_id <> r.owner GROUP BY ALL)
SELECT file_id, arg_min(owner, (-overlap, owner)) AS recipe_of, max(overlap) AS overlap FROM m GROUP BY file_id""")
def recipe_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier recipe each file has most in common with, by chunks' first owners: a chunk counts for the first file that has it only."""
    s = blocks(spark, sf_dir).select("file_id", "fp").distinct()
    r = s.groupBy("fp").agg(F.min("file_id").alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n")
    m = s.join(r, "fp").filter("file_id <> owner").groupBy("file_id", "owner").agg(F.count("*").alias("overlap"))
    return m.groupBy("file_id").agg(F.min_by("owner", F.struct((-F.col("overlap")).alias("o"), "owner")).alias("recipe_of"), F.max("overlap").alias("overlap"))


@query(f"""WITH {FILES_SQL}, h AS (SELECT file_id, source, md5(body) AS fp, octet_length(body) AS len FROM files), g AS (SELECT fp, min(file_id) AS first FROM h GROUP BY fp)
SELECT source, count(*) AS files, count(*) FILTER (file_id <> first) AS skipped, coalesce(sum(len) FILTER (file_id <> first), 0)::BIGINT AS bytes_not_chunked FROM h JOIN g USING (fp) GROUP BY source""")
def identical_file_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files equal to an earlier one needn't be chunked."""
    h = chunking.whole_files(files(spark, sf_dir))
    d = h.join(h.groupBy("fp").agg(F.min("file_id").alias("first")), "fp")
    later = F.col("file_id") != F.col("first")
    return d.groupBy("source").agg(F.count("*").alias("files"), F.count_if(later).alias("skipped"), F.sum(F.when(later, F.col("len")).otherwise(0)).alias("bytes_not_chunked"))


@query(f"""{BLOCKS}, p AS (SELECT max(source) AS source FROM documents), b AS (SELECT DISTINCT fp FROM chunks WHERE source = (SELECT source FROM p)), s AS (SELECT DISTINCT fp FROM chunks WHERE source <> (SELECT source FROM p))
SELECT count(*) AS asked, count(s.fp) AS stored, 0::BIGINT AS missed, true AS few_passed FROM b LEFT JOIN s USING (fp)""")
def bloom_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last source's chunks against a filter over the other sources': how many are stored, how many of these the filter missed
    (none may be), and whether it let at most one in twenty of the others through to the index."""
    c = blocks(spark, sf_dir)
    last = F.broadcast(files(spark, sf_dir).agg(F.max("source").alias("last")))  # one row
    c = c.crossJoin(last)
    store, batch = c.filter("source <> last"), c.filter("source = last")
    there = store.select("fp").distinct().withColumn("there", F.lit(True))
    r = gated(batch, store, "fp").join(there, "fp", "left").select("maybe", F.coalesce("there", F.lit(False)).alias("there"))
    return r.agg(F.count("*").alias("asked"), F.count_if("there").alias("stored"), F.count_if(F.col("there") & ~F.col("maybe")).alias("missed"), (F.count_if(~F.col("there") & F.col("maybe")) * 20 <= F.count("*")).alias("few_passed"))


def probing_sql(bits: int) -> str:
    """DuckDB CTE ``cdc`` of the probing chunker: ends are picked from the places where the hash is zero, file by file."""
    low, high = (1 << bits) >> 2, (1 << bits) * 4
    limit = f"least(c.n, s.e + {high})"
    return f"""{gear_sql(bits, seven=True)},
zero AS (SELECT file_id, list(i + 1 ORDER BY i) FILTER (h = 0) AS at, max(i) + 1 AS n FROM hashed GROUP BY file_id),
step AS (SELECT file_id, 0::BIGINT AS off, 0::BIGINT AS e, 0 AS k FROM zero UNION ALL
  SELECT s.file_id, s.e, coalesce(list_min(list_filter(c.at, lambda x: x >= s.e + {low + 16} AND x <= {limit} AND (x - s.e - {low}) % 16 = 0)), list_min(list_filter(c.at, lambda x: x > s.e + {low} AND x <= {limit})), {limit}), s.k + 1
  FROM step s JOIN zero c ON s.file_id = c.file_id WHERE s.e < c.n)"""


@query(f"WITH RECURSIVE {FILES_SQL}, {probing_sql(8)} SELECT file_id, (k - 1)::INT AS seq, off, e - off AS len FROM step WHERE k > 0")
def probing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by a table of 128 entries that probe every sixteenth place first."""
    return chunking.span_chunks(files(spark, sf_dir), lambda body: probing_spans(body, 8)).select("file_id", "seq", "off", "len")


@query(f"WITH RECURSIVE {FILES_SQL}, {probing_sql(8)} SELECT least(13, (e - off) // 74)::INT AS bin, count(*) AS n FROM step WHERE k > 0 GROUP BY 1")
def probing_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their lengths in fourteen bins up to the greatest."""
    return probing_chunks(spark, sf_dir).groupBy(F.least(F.lit(13), F.floor(F.col("len") / 74)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""{BLOCKS}, h AS (SELECT file_id, source, md5(body) AS whole, octet_length(body) AS n FROM files), g AS (SELECT whole, count(*) AS copies, count(DISTINCT source) AS users, max(n) AS n FROM h GROUP BY whole),
r AS (SELECT c.source, c.fp, c.len FROM chunks c JOIN h USING (file_id) JOIN g USING (whole) WHERE users = 1), u AS (SELECT source, fp, count(*) AS c, max(len) AS len FROM r GROUP BY ALL)
SELECT 'file' AS level, count(*) AS uniques, coalesce(sum(copies * n), 0)::BIGINT AS logical, coalesce(sum(n), 0)::BIGINT AS stored FROM g WHERE users > 1 UNION ALL SELECT 'chunk', count(*), coalesce(sum(c * len), 0)::BIGINT, coalesce(sum(len), 0)::BIGINT FROM u""")
def key_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by content for whole files that several users have, by user and content for the chunks of all others."""
    f = files(spark, sf_dir)
    h = chunking.whole_files(f).select("file_id", "source", F.col("fp").alias("whole"), "len")
    g = h.groupBy("whole").agg(F.count("*").alias("copies"), F.count_distinct("source").alias("users"), F.max("len").alias("n"))
    sums = lambda name, c, n: [F.lit(name).alias("level"), F.count("*").alias("uniques"), F.coalesce(F.sum(F.col(c) * F.col(n)), F.lit(0)).alias("logical"), F.coalesce(F.sum(n), F.lit(0)).alias("stored")]
    own = h.join(g.filter("users = 1").select("whole"), "whole", "left_semi").select("file_id")
    u = blocks(spark, sf_dir).join(own, "file_id", "left_semi").groupBy("source", "fp").agg(F.count("*").alias("c"), F.max("len").alias("len"))
    whole, parts = (d.agg(*x[1:]).select(x[0], "*") for d, x in ((g.filter("users > 1"), sums("file", "copies", "n")), (u, sums("chunk", "c", "len"))))
    return whole.unionByName(parts)


@query(f"{BLOCKS}, u AS (SELECT DISTINCT ('0x' || substr(fp, 1, 15))::BIGINT AS h FROM chunks) SELECT b::INT AS bit, sum((h >> b) & 1)::BIGINT AS ones, count(*) AS n FROM u, range(16) t(b) GROUP BY b")
def bit_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of the low bits, which a mask looks at, is set over all fingerprints."""
    u = blocks(spark, sf_dir).select("fp").distinct().select(truncated(F.col("fp"), 0).alias("h"))
    one = u.agg(F.count("*").alias("n"), *(F.sum(report.bit(F.col("h"), b)).alias(f"b{b}") for b in range(16)))
    return one.select("n", F.posexplode(F.array(*(f"b{b}" for b in range(16))))).select(F.col("pos").alias("bit"), F.col("col").alias("ones"), "n")


@query("""WITH s AS (SELECT source, count(*) AS files FROM documents GROUP BY source), c AS (SELECT *, list_transform(string_split(source, ''), lambda x: unicode(x)::BIGINT) AS codes FROM s)
SELECT source, files, list_reduce(list_prepend(2166136261::BIGINT, codes), lambda h, x: (xor(h, x) * 16777619) & 4294967295) % 100000 / 100000.0::DOUBLE AS shade FROM c""")
def source_shades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable number in [0, 1) for each source, for its colour."""
    return files(spark, sf_dir).groupBy("source").agg(F.count("*").alias("files")).select("source", "files", report.unit_hash(F.col("source")).alias("shade"))


@query(f"{BLOCKS}, moved AS (SELECT doc_id AS file_id, lang, source, encode(substr(coalesce(text, ''), 1, 300) || 'INSERTED' || substr(coalesce(text, ''), 301)) AS body FROM documents), {blocks_sql(BLOCK, 'moved').replace('chunks AS', 'moved_chunks AS')} {COVER.format('moved_chunks', 'chunks')}")
def spliced_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a copy fixed blocks find again if eight letters are put in behind the first three hundred characters."""
    f = files(spark, sf_dir)
    moved = f.withColumn("body", F.encode(spliced(F.decode("body", "UTF-8"), 300, "INSERTED"), "UTF-8"))
    return dedup.coverage(chunking.fixed_chunks(moved, BLOCK), chunking.fixed_chunks(f, BLOCK), "lang")
