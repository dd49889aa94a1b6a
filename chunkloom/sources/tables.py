"""The files, versions and backup sessions that the engine's operators work on, from tables of texts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits that hold the place of a chunk within its file in an ``ord`` key: ``ord = file * 2**ORD_BITS + seq``.
ORD_BITS = 24
SPAN = 1 << ORD_BITS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, lang, source, body (UTF-8 bytes of a document's text; null is empty)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "lang", "source", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))


def backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, file_id, version_doc: a backup of file ``user_id`` on each day with an event of it; its content changes every week."""
    events = table(spark, sf_dir, "events")
    docs = table(spark, sf_dir, "documents")
    first = events.agg(F.to_date(F.min("ts")).alias("first"))
    n = docs.agg(F.count("*").alias("n_docs"))
    # both broadcast sides are one row by construction
    days = events.select(F.to_date("ts").alias("date"), F.col("user_id").alias("file_id")).distinct()
    return days.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(n)).select(F.datediff("date", "first").alias("day"), "file_id", F.pmod(F.col("file_id") + F.lit(7919) * F.floor(F.datediff("date", "first") / 7), F.col("n_docs")).alias("doc_id"))


BACKUPS_SQL = """
first AS (SELECT min(ts)::DATE AS d0 FROM events), nd AS (SELECT count(*) AS n FROM documents),
backups AS (SELECT DISTINCT datediff('day', d0, ts::DATE)::INT AS day, user_id AS file_id,
                   ((user_id + 7919 * (datediff('day', d0, ts::DATE) // 7)) % n)::BIGINT AS doc_id FROM events, first, nd)"""

FILES_SQL = "files AS (SELECT doc_id AS file_id, lang, source, encode(coalesce(text, '')) AS body FROM documents)"


def blocks_sql(size: int = 256, body: str = "files") -> str:
    """DuckDB CTE ``chunks`` of fixed blocks."""
    return f"chunks AS (SELECT file_id, lang, source, i::INT AS seq, (i * {size})::BIGINT AS off, least({size}, octet_length(body) - i * {size})::BIGINT AS len, md5(body[i * {size} + 1 : least((i + 1) * {size}, octet_length(body))]) AS fp, file_id * {SPAN} + i AS ord FROM {body}, range(((octet_length(body) + {size - 1}) // {size})::BIGINT) t(i))"


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """file_id (38 bits of a hash of the path, so that ``ord`` keys fit), name and body of real files, by Spark's binary source."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.pmod(F.xxhash64("path"), F.lit(1 << 38)).alias("file_id"), F.col("path").alias("name"), F.col("content").alias("body"))
