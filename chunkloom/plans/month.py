"""Reports over the month's store: its log, days in words, sparklines, queues, moved files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.config import ENTRY
from chunkloom.functions import report
from chunkloom.operators import chunking, dedup, lifecycle
from chunkloom.plans.dedup import BLOCKS, blocks
from chunkloom.plans.lifecycle import KEEP, LAST, LOG, RATIO, SERIES, SESSIONS, collected, event_log, last_day, restore_samples, series
from chunkloom.plans.registry import ORACLE, query
from chunkloom.sources.tables import BACKUPS_SQL, FILES_SQL, backups, files

LOGGED = SERIES.replace(SESSIONS, LOG, 1)  # the log and, after it, the series s
EXPIRED = f"x AS (SELECT (day + {KEEP + 1})::INT AS day, count(*) AS expired FROM backups WHERE day + {KEEP + 1} <= {LAST} GROUP BY ALL)"
CHOSEN = 5


def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, expired: copies that go on each day."""
    return lifecycle.expiries(backups(spark, sf_dir), KEEP, last_day(spark, sf_dir)).groupBy(F.col("expired_on").cast("int").alias("day")).agg(F.count("*").alias("expired"))


@query(f"{LOG} SELECT day, entries, (entries * {ENTRY})::BIGINT AS index_ram, (max(entries * {ENTRY}) OVER (ORDER BY day))::BIGINT AS peak FROM log")
def index_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index day by day, and the most memory it has taken so far."""
    e = collected(spark, sf_dir).select("day", "entries", (F.col("entries") * ENTRY).alias("index_ram"))
    return e.withColumn("peak", F.max("index_ram").over(Window.orderBy("day")))  # a row per day


@query(f"""{LOGGED}, {EXPIRED} SELECT day, 'scan' AS kind, 0::BIGINT AS place, logical AS bytes FROM s UNION ALL SELECT x.day, 'expire', coalesce(s.chunks, 0), 0 FROM x LEFT JOIN s USING (day)
UNION ALL SELECT log.day, 'gc', coalesce(s.chunks, 0), log.gc FROM log LEFT JOIN s USING (day) WHERE gc > 0""")
def phase_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in a day's run of chunks each phase begins: the scan at its start, expiry and collection behind its last chunk."""
    s, end = series(spark, sf_dir), F.coalesce("chunks", F.lit(0)).alias("place")
    one = s.select("day", F.lit("scan").alias("kind"), F.lit(0).cast("long").alias("place"), F.col("logical").alias("bytes"))
    two = expired(spark, sf_dir).join(s, "day", "left").select("day", F.lit("expire").alias("kind"), end, F.lit(0).cast("long").alias("bytes"))
    three = collected(spark, sf_dir).filter("gc > 0").join(s, "day", "left").select("day", F.lit("gc").alias("kind"), end, F.col("gc").alias("bytes"))
    return one.unionByName(two).unionByName(three)


@query(f"""{LOGGED}, {EXPIRED} SELECT s.day, s.chunks, (s.chunks - log.new_chunks)::BIGINT AS dups, log.written, CASE WHEN s.day = 0 THEN 'first backup' WHEN log.written = 0 THEN 'nothing new'
WHEN s.chunks - log.new_chunks > 0.8::DOUBLE * s.chunks THEN 'mostly duplicates' WHEN log.gc > 0 THEN 'collected' WHEN coalesce(x.expired, 0) > 0 THEN 'expiry and small changes' ELSE 'ordinary' END AS sentence
FROM s JOIN log USING (day) LEFT JOIN x USING (day)""")
def day_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day in words. This store has no deltas; ``report.day_sentence`` has an outcome for them."""
    d = series(spark, sf_dir).select("day", "chunks").join(collected(spark, sf_dir), "day").join(expired(spark, sf_dir), "day", "left").fillna(0, ["expired"])
    dups = F.col("chunks") - F.col("new_chunks")
    says = report.day_sentence(F.col("day"), F.col("chunks"), dups, F.col("written"), F.lit(0), F.col("gc"), F.col("expired"))
    return d.select("day", "chunks", dups.alias("dups"), "written", says.alias("sentence"))


@query(f"""{LOGGED}, {EXPIRED}, b AS (SELECT count(*) AS backups, count(DISTINCT file_id) AS files FROM backups), e AS (SELECT coalesce(sum(expired), 0)::BIGINT AS expired FROM x),
j AS (SELECT log.*, coalesce(s.logical, 0) AS logical, coalesce(s.chunks, 0) AS chunks FROM log LEFT JOIN s USING (day))
SELECT count(*) AS days, any_value(b.backups) AS backups, any_value(b.files) AS files, sum(chunks)::BIGINT AS chunks, sum(new_chunks)::BIGINT AS uniques, (sum(chunks) - sum(new_chunks))::BIGINT AS dups, sum(logical)::BIGINT AS logical, sum(written)::BIGINT AS stored,
(sum(logical) - sum(written))::BIGINT AS saved, {RATIO.format('sum(logical)', 'sum(written)')} AS ratio, max(written) AS most_written, min(written) AS least_written, min_by(written, day) AS first_written, max_by(written, day) AS last_written, round(avg(written), 6) AS mean_written,
count(*) FILTER (gc > 0) AS gc_runs, sum(gc)::BIGINT AS rewritten, min(day) FILTER (gc > 0) AS first_gc, round((sum(written) + sum(gc))::DOUBLE / sum(written), 6) AS wa, round(sum(gc)::DOUBLE / (sum(written) + sum(gc)), 6) AS gc_share, round((sum(written) + sum(gc))::DOUBLE / sum(logical), 6) AS write_ratio,
any_value(e.expired) AS expired, max(disk) AS peak_disk, max_by(disk, day) AS last_disk, max(holes)::BIGINT AS peak_holes, max_by(holes, day)::BIGINT AS last_holes, max_by(live_bytes, day) AS last_live, max(entries) AS peak_entries, (max(entries) * {ENTRY})::BIGINT AS peak_ram, max(holes_ratio_before_gc) AS peak_holes_ratio FROM j, b, e""")
def month_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month under collection in one row of thirty fields."""
    b = backups(spark, sf_dir).agg(F.count("*").alias("backups"), F.count_distinct("file_id").alias("files"))
    e = expired(spark, sf_dir).agg(F.coalesce(F.sum("expired"), F.lit(0)).alias("expired"))
    j = collected(spark, sf_dir).join(series(spark, sf_dir).select("day", "logical", "chunks"), "day", "left").fillna(0, ["logical", "chunks"])
    n, w, g = F.sum("logical"), F.sum("written"), F.sum("gc")
    at = lambda f, c, name: f(c, "day").alias(name)
    one = j.agg(
        F.count("*").alias("days"), F.sum("chunks").alias("chunks"), F.sum("new_chunks").alias("uniques"), (F.sum("chunks") - F.sum("new_chunks")).alias("dups"), n.alias("logical"), w.alias("stored"), (n - w).alias("saved"), dedup.ratio(n, w).alias("ratio"),
        F.max("written").alias("most_written"), F.min("written").alias("least_written"), at(F.min_by, "written", "first_written"), at(F.max_by, "written", "last_written"), F.round(F.avg("written"), 6).alias("mean_written"),
        F.count_if(F.col("gc") > 0).alias("gc_runs"), g.alias("rewritten"), F.min(F.when(F.col("gc") > 0, F.col("day"))).alias("first_gc"), F.round((w + g) / w, 6).alias("wa"), F.round(g / (w + g), 6).alias("gc_share"), F.round((w + g) / n, 6).alias("write_ratio"),
        F.max("disk").alias("peak_disk"), at(F.max_by, "disk", "last_disk"), F.max("holes").alias("peak_holes"), at(F.max_by, "holes", "last_holes"), at(F.max_by, "live_bytes", "last_live"), F.max("entries").alias("peak_entries"), (F.max("entries") * ENTRY).alias("peak_ram"), F.max("holes_ratio_before_gc").alias("peak_holes_ratio"),
    )
    return one.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(e))  # one row each


@query(f"SELECT * FROM ({ORACLE['event_log']}) WHERE day = 10")
def events_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the day that is shown."""
    return event_log(spark, sf_dir).filter("day = 10")


SPARK = """SELECT '{0}' AS measure, min({0}) - 0.18::DOUBLE * CASE WHEN max({0}) > min({0}) THEN max({0}) - min({0}) ELSE 1 END AS low, max({0}) + 0.18::DOUBLE * CASE WHEN max({0}) > min({0}) THEN max({0}) - min({0}) ELSE 1 END AS high,
sum({0} * 0.1::DOUBLE * pow(0.9::DOUBLE, n - k)) AS smoothed FROM (SELECT *, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM s)"""


@query(f"{SERIES} SELECT measure, round(low, 3) AS low, round(high, 3) AS high, round(smoothed, 3) AS smoothed FROM ({SPARK.format('logical')} UNION ALL {SPARK.format('written')})")
def sparklines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis ranges of the month's small charts, and their exponentially smoothed ends (of a row per day)."""
    s, out = series(spark, sf_dir), None
    for m in ("logical", "written"):
        r = report.padded_range(F.min(m), F.max(m))
        ends = report.smoothed(F.transform(F.array_sort(F.collect_list(F.struct("day", F.col(m).cast("double").alias("v")))), lambda x: x["v"]))
        one = s.agg(r.alias("r"), ends.alias("e")).select(F.lit(m).alias("measure"), F.round("r.low", 3).alias("low"), F.round("r.high", 3).alias("high"), F.round("e", 3).alias("smoothed"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT s, day, file_id, (row_number() OVER (ORDER BY (s = {CHOSEN}) DESC, file_id, s))::INT AS place FROM ({ORACLE['restore_samples']})")
def restore_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spot check's twelve copies in the order they are restored: the file that was clicked first."""
    first = report.focus_first(F.col("s"), CHOSEN)[0]
    return restore_samples(spark, sf_dir).withColumn("place", F.row_number().over(Window.orderBy(first, "file_id", "s")).cast("int"))


@query(f"""WITH {FILES_SQL}, {BACKUPS_SQL}, v AS (SELECT b.day, b.file_id, md5(f.body) AS fp FROM backups b JOIN files f ON f.file_id = b.doc_id), p AS (SELECT day + 1 AS day, file_id, fp FROM v),
m AS (SELECT coalesce(v.day, p.day) AS day, coalesce(v.fp, p.fp) AS fp, count(*) FILTER (p.fp IS NULL) AS gained, count(*) FILTER (v.fp IS NULL) AS lost FROM v FULL JOIN p ON v.day = p.day AND v.file_id = p.file_id AND v.fp = p.fp GROUP BY 1, 2)
SELECT day, sum(gained)::BIGINT AS gained, sum(lost)::BIGINT AS lost, sum(least(gained, lost))::BIGINT AS moved FROM m WHERE day BETWEEN 1 AND {LAST} GROUP BY day""")
def moved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that a day's files have and had not, had and have not, and of these how many only changed their file: they needn't be chunked.

    Counted by content, so a content of very many files makes no pairs.
    """
    docs = chunking.whole_files(files(spark, sf_dir)).select(F.col("file_id").alias("doc_id"), "fp")
    v = backups(spark, sf_dir).join(docs, "doc_id").select("day", "file_id", "fp")
    both = v.select("*", F.lit(1).alias("now"), F.lit(0).alias("before")).unionByName(v.select((F.col("day") + 1).alias("day"), "file_id", "fp", F.lit(0).alias("now"), F.lit(1).alias("before")))
    per = both.groupBy("day", "fp", "file_id").agg(F.max("now").alias("now"), F.max("before").alias("before"))
    m = per.groupBy("day", "fp").agg(F.count_if((F.col("now") == 1) & (F.col("before") == 0)).alias("gained"), F.count_if((F.col("now") == 0) & (F.col("before") == 1)).alias("lost"))
    return m.filter(F.col("day").between(1, last_day(spark, sf_dir))).groupBy("day").agg(F.sum("gained").alias("gained"), F.sum("lost").alias("lost"), F.sum(F.least("gained", "lost")).alias("moved"))


@query(f"""{BLOCKS}, q AS (SELECT DISTINCT file_id FROM files ORDER BY file_id LIMIT {KEEP}), g AS (SELECT fp, max(len) AS len, count(*) AS n, count(*) FILTER (file_id IN (SELECT file_id FROM q)) AS gone FROM chunks GROUP BY fp)
SELECT sum(gone)::BIGINT AS refs, count(*) FILTER (n = gone) AS dropped, coalesce(sum(len) FILTER (n = gone), 0)::BIGINT AS freed FROM g""")
def single_day_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is freed if the first seven files of the queue expire at once (the queue's length is the operator's parameter)."""
    q = F.broadcast(files(spark, sf_dir).select("file_id").distinct().orderBy("file_id").limit(KEEP).withColumn("goes", F.lit(1)))  # seven rows
    g = blocks(spark, sf_dir).join(q, "file_id", "left").groupBy("fp").agg(F.max("len").alias("len"), F.count("*").alias("n"), F.count("goes").alias("gone"))
    dead = F.col("n") == F.col("gone")
    return g.agg(F.sum("gone").alias("refs"), F.count_if(dead).alias("dropped"), F.sum(F.when(dead, F.col("len")).otherwise(0)).alias("freed"))
