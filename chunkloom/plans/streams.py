"""Queries with streaming forms, run over the table as a bounded stream or as the batch they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.plans.lifecycle import KEEP, LAST
from chunkloom.plans.registry import query
from chunkloom.sources.storage import new_path
from chunkloom.sources.tables import BACKUPS_SQL, table
from chunkloom.streaming import ingest

STORE = "spark.sql.streaming.stateStore.providerClass"


@query("SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days: the batch form of ``streaming.ingest.daily_totals``."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g), c AS (SELECT user_id, sid, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows: events of a user less than six hours apart."""
    e = table(spark, sf_dir, "events")
    s = e.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT event_type, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def event_week_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by week."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "7 days").getField("start").alias("week")).agg(F.count_distinct("user_id").alias("users"))


@query(f"WITH {BACKUPS_SQL} SELECT (day + {KEEP + 1})::INT AS expired_on, count(*) AS copies, count(DISTINCT file_id) AS files FROM backups WHERE day + {KEEP + 1} <= {LAST} GROUP BY day")
def retention_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that expire on each day, as ``streaming.ingest.expiry_stream`` tells them by timers: all events are read as a stream until none is left, the
    watermark at the last of them. The stream is one batch, so no event is late."""
    path, events = new_path(spark, "expiry"), table(spark, sf_dir, "events")
    # a pattern, as a stream's path must not be a file
    source = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet")
    # the table's times have no zone: the wall clock is taken as UTC, whatever the session's zone
    source = source.select(F.col("user_id").alias("file_id"), F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()).alias("ts"))
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        gone = ingest.expiry_stream(source, KEEP, "0 seconds").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        gone.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    first = events.agg(F.to_date(F.min("ts")).alias("first"))  # one row
    out = spark.read.schema(ingest.EXPIRED).parquet(f"{path}/out").crossJoin(F.broadcast(first))
    return out.groupBy(F.datediff("expired_on", "first").alias("expired_on")).agg(F.count("*").alias("copies"), F.count_distinct("file_id").alias("files"))
