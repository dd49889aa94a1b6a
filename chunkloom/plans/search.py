"""Queries that look for content elsewhere: blocks at any offset, best recipes; and chunkers that depend on neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.config import DedupConfig
from chunkloom.operators import chunking, containment, dedup, overlap
from chunkloom.plans.dedup import BLOCKS, RATIO, blocks, plain_cdc_sql
from chunkloom.plans.registry import query
from chunkloom.sources.tables import FILES_SQL, files, table

WINDOW = 32
BIG, SMALL = DedupConfig(bits=9, bounded=False), DedupConfig(bits=6, bounded=False)
PEAK = 64


def renamed(ctes: str, suffix: str) -> str:
    """The same CTEs by other names."""
    for name in ("gear", "bytes", "hashed", "ends", "spans", "cdc"):
        for before, after in ((f"{name} AS", f"{name}{suffix} AS"), (f"FROM {name} ", f"FROM {name}{suffix} "), (f"JOIN {name} ", f"JOIN {name}{suffix} ")):
            ctes = ctes.replace(before, after)
    return ctes


@query(f"""WITH {FILES_SQL}, items AS (SELECT item_id, encode(coalesce(text, '')) AS body FROM benchmark),
b AS (SELECT item_id, i::INT AS seq, hex(body[i * {WINDOW} + 1 : (i + 1) * {WINDOW}]) AS block FROM items, range((octet_length(body) // {WINDOW})::BIGINT) t(i)),
w AS (SELECT file_id, substr(hx, (2 * i + 1)::BIGINT, {2 * WINDOW}) AS block FROM (SELECT file_id, hex(body) AS hx, octet_length(body) AS n FROM files), range((n - {WINDOW - 1})::BIGINT) t(i)),
f AS (SELECT block, count(DISTINCT file_id) AS files, count(*) AS places, min(file_id) AS first_file FROM w WHERE block IN (SELECT block FROM b) GROUP BY block)
SELECT item_id, seq, files, places, first_file FROM b JOIN f USING (block)""")
def blocks_at_any_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole blocks of 32 bytes of each benchmark item that stand anywhere in a file: in how many files, at how many places, and in which first."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    b = chunking.fixed_chunks(items, WINDOW, keep=True).filter(F.col("len") == WINDOW).select(F.col("file_id").alias("item_id"), "seq", "fp", "bytes")
    return b.select("item_id", "seq", "fp").join(containment.found_anywhere(b, files(spark, sf_dir), WINDOW), "fp").select("item_id", "seq", "files", "places", "first_file")


@query(f"""{BLOCKS}, s AS (SELECT DISTINCT file_id, fp FROM chunks),
m AS (SELECT a.file_id, b.file_id AS other, count(*) AS n FROM s a JOIN s b ON a.fp = b.fp AND b.file_id < a.file_id GROUP BY ALL)
SELECT file_id, arg_min(other, (-n, other)) AS recipe_of, max(n) AS overlap FROM m GROUP BY file_id""")
def best_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier recipe with which each file has most chunks in common, out of all earlier ones."""
    return overlap.best_recipes(blocks(spark, sf_dir))


@query(f"""WITH {FILES_SQL}, w AS (SELECT file_id, i, ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::INT AS b, n FROM (SELECT file_id, hex(body) AS hx, octet_length(body) AS n FROM files), range(n::BIGINT) t(i)),
m AS (SELECT *, max(b) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN {PEAK} PRECEDING AND 1 PRECEDING) AS before, max(b) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {PEAK} FOLLOWING) AS after FROM w),
ends AS (SELECT file_id, i + 1 AS e FROM m WHERE b > before AND b > after AND i >= {PEAK} AND i < n - {PEAK} UNION SELECT file_id, octet_length(body) FROM files WHERE octet_length(body) > 0),
spans AS (SELECT file_id, coalesce(lag(e) OVER (PARTITION BY file_id ORDER BY e), 0) AS off, e FROM ends)
SELECT s.file_id, (row_number() OVER (PARTITION BY s.file_id ORDER BY off) - 1)::INT AS seq, off::BIGINT AS off, (e - off)::BIGINT AS len, md5(f.body[off + 1 : e]) AS fp FROM spans s JOIN files f USING (file_id)""")
def local_maximum_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks cut without a hash, behind bytes that exceed the 64 on either side."""
    return chunking.peak_chunks(files(spark, sf_dir), PEAK).select("file_id", "seq", "off", "len", "fp")


BIMODAL = f"""{plain_cdc_sql(BIG.bits)},
d AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY file_id, seq) > 1 AS dup FROM cdc),
t AS (SELECT *, NOT dup AND (coalesce(lag(dup) OVER w, false) OR coalesce(lead(dup) OVER w, false)) AS recut FROM d WINDOW w AS (PARTITION BY file_id ORDER BY seq)),
again AS (SELECT t.file_id * 1000000 + t.seq AS file_id, f.body[off + 1 : off + len] AS body, t.lang, t.source FROM t JOIN files f USING (file_id) WHERE recut),
{renamed(plain_cdc_sql(SMALL.bits, 'again'), '2')}, {renamed(plain_cdc_sql(SMALL.bits), '3')}"""


@query(f"""WITH {FILES_SQL}, {BIMODAL},
kept AS (SELECT fp, max(len) AS len FROM (SELECT fp, len FROM t WHERE NOT dup AND NOT recut UNION ALL SELECT fp, len FROM cdc2) GROUP BY fp),
n AS (SELECT sum(octet_length(body)) AS logical FROM files),
s AS (SELECT 'large' AS scheme, 0::BIGINT AS recut, len FROM t WHERE NOT dup UNION ALL SELECT 'small', 0, max(len) FROM cdc3 GROUP BY fp
  UNION ALL SELECT 'bimodal', (SELECT count(*) FROM t WHERE recut), len FROM kept)
SELECT scheme, max(recut) AS recut, count(*) AS stored_chunks, sum(len)::BIGINT AS written, {RATIO.format('max(logical)', 'sum(len)')} AS ratio FROM s, n GROUP BY scheme""")
def bimodal_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large chunks, of which the new ones beside a duplicate are cut again into small ones, next to large and small chunks throughout."""
    f = files(spark, sf_dir)
    big = chunking.transitions(dedup.decisions(chunking.cdc_chunks(f, BIG)))
    new = big.filter("kind = 'new'").select("file_id", "off", "fp", "len", "recut")
    kept = new.filter("NOT recut").select("fp", "len").unionByName(chunking.recut_chunks(f, new.filter("recut"), SMALL).select("fp", "len"))
    logical = F.broadcast(f.agg(F.sum(F.octet_length("body")).alias("logical")))  # one row
    once = lambda rows: rows.groupBy("fp").agg(F.max("len").alias("len"))
    schemes = {"large": new.select("fp", "len"), "small": once(chunking.cdc_chunks(f, SMALL)), "bimodal": once(kept)}
    out = None
    for name, rows in schemes.items():
        one = rows.agg(F.count("*").alias("stored_chunks"), F.sum("len").alias("written")).withColumn("scheme", F.lit(name))
        out = one if out is None else out.unionByName(one)
    recut = F.broadcast(new.agg(F.count_if("recut").alias("recut")))  # one row
    both = out.crossJoin(logical).crossJoin(recut)
    return both.select("scheme", F.when(F.col("scheme") == "bimodal", F.col("recut")).otherwise(F.lit(0)).cast("long").alias("recut"), "stored_chunks", "written", dedup.ratio(F.col("logical"), F.col("written")).alias("ratio"))
