"""Queries over fragmentation from day to day, and what rewriting sparse containers does about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators import chunking, rewriting
from chunkloom.plans.dedup import BLOCK
from chunkloom.plans.lifecycle import SESSIONS
from chunkloom.plans.registry import query
from chunkloom.sources.storage import stored
from chunkloom.sources.tables import SPAN, backups, files

CAPACITY, SPARSE = 32 * 1024, 0.5
#: A copy is (c, fp); ``ref``: the day uses it; ``again``: it is a rewrite. Each day looks at all copies of the day before.
REPLAY = f"""{SESSIONS.replace('WITH', 'WITH RECURSIVE', 1)}, s AS (SELECT day, fp, max(len)::BIGINT AS len, min(file_id * {SPAN} + seq) AS pos FROM refs GROUP BY day, fp),
days AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT day FROM s)), d AS MATERIALIZED (SELECT k, s.* FROM s JOIN days USING (day)),
r AS (SELECT k, fp, len, (k * 1048576 + (sum(len) OVER (ORDER BY pos) - len) // {CAPACITY})::BIGINT AS c, true AS ref, false AS again FROM d WHERE k = 1 UNION ALL
 (WITH sp AS (SELECT c FROM r GROUP BY c HAVING sum(len) FILTER (ref) < {SPARSE} * sum(len)), latest AS (SELECT fp, max(c) AS c FROM r GROUP BY fp), nx AS (SELECT max(k) + 1 AS k FROM r),
  t AS (SELECT d.k, d.fp, d.len, d.pos, l.c, l.c IN (SELECT c FROM sp) AS again FROM d JOIN nx USING (k) LEFT JOIN latest l ON l.fp = d.fp)
  SELECT nx.k, r.fp, r.len, r.c, t.fp IS NOT NULL, false FROM r CROSS JOIN nx LEFT JOIN t ON t.fp = r.fp AND t.c = r.c AND NOT t.again WHERE nx.k <= (SELECT max(k) FROM d)
  UNION ALL SELECT k, fp, len, (k * 1048576 + (sum(len) OVER (ORDER BY pos) - len) // {CAPACITY})::BIGINT, true, coalesce(again, false) FROM t WHERE c IS NULL OR again))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of chunks of all backups; only contents that some backup has are cut."""
    uses = stored(backups(spark, sf_dir).groupBy("doc_id", "day").agg(F.min("file_id").alias("file_id")), "uses")
    used = files(spark, sf_dir).join(uses.select(F.col("doc_id").alias("file_id")).distinct(), "file_id", "left_semi")
    chunks = chunking.fixed_chunks(used, BLOCK).select(F.col("file_id").alias("content"), "seq", "fp", "len")
    return rewriting.runs(chunks, uses.select(F.col("day").alias("session"), "file_id", F.col("doc_id").alias("content")))


@query(f"""{REPLAY}, u AS (SELECT k, c, sum(len) FILTER (ref) AS live, sum(len) AS used FROM r GROUP BY k, c),
w AS (SELECT k, count(*) AS containers, count(*) FILTER (live < {SPARSE} * used) AS sparse FROM u WHERE live > 0 GROUP BY k),
x AS (SELECT k, count(*) AS chunks, sum(len)::BIGINT AS bytes, coalesce(sum(len) FILTER (c // 1048576 = k AND NOT again), 0)::BIGINT AS new_bytes, count(*) FILTER (again) AS rewritten, coalesce(sum(len) FILTER (again), 0)::BIGINT AS rewritten_bytes FROM r WHERE ref GROUP BY k),
b AS (SELECT fp, min((k, pos)) AS f, max(len) AS len FROM d GROUP BY fp), p AS (SELECT fp, f[1] * 1048576 + (sum(len) OVER (PARTITION BY f[1] ORDER BY f[2]) - len) // {CAPACITY} AS c FROM b),
o AS (SELECT k, count(DISTINCT c) AS unmoved_containers FROM d JOIN p USING (fp) GROUP BY k)
SELECT day::BIGINT AS day, chunks, bytes, new_bytes, rewritten, rewritten_bytes, containers, sparse, unmoved_containers FROM x JOIN w USING (k) JOIN o USING (k) JOIN days USING (k)""".replace("f[1]", "struct_extract(f, 1)").replace("f[2]", "struct_extract(f, 2)"))
def rewriting_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's backup where it rewrites what lies in containers that the day before used to less than half: distinct chunks, bytes new and written
    again, containers a restore of the day reads, how many of them the next day inherits as sparse, and what it would read had nothing been rewritten."""
    found = runs(spark, sf_dir)
    done = rewriting.replayed(found, CAPACITY, SPARSE)
    if done is None:
        return spark.createDataFrame([], "day long, chunks long, bytes long, new_bytes long, rewritten long, rewritten_bytes long, containers long, sparse long, unmoved_containers long")
    sparse = F.count_if(F.col("live") < F.col("used") * SPARSE).alias("sparse")
    sums = {"chunks": "chunks", "live": "bytes", "fresh": "new_bytes", "rewritten": "rewritten", "rewritten_bytes": "rewritten_bytes"}
    days = rewriting.use(done[1]).groupBy("session").agg(*(F.sum(c).alias(name) for c, name in sums.items()), F.count("*").alias("containers"), sparse)
    plain = rewriting.unmoved_runs(found, CAPACITY).select(F.explode("uses.session").alias("session"), "home", "container").distinct().groupBy("session").agg(F.count("*").alias("unmoved_containers"))
    return days.join(plain, "session").withColumn("session", F.col("session").cast("long")).withColumnRenamed("session", "day")
