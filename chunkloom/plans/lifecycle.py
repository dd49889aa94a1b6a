"""Queries over days: backup sessions, retention, collection, restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.config import DedupConfig
from chunkloom.operators import chunking, dedup, lifecycle, scan
from chunkloom.plans.dedup import BLOCK
from chunkloom.plans.registry import query
from chunkloom.sources.tables import BACKUPS_SQL, FILES_SQL, backups, blocks_sql, files, table

KEEP, GC = 7, 0.25
#: Days of a generated month. What is read from tables ends with the last day that they have.
DAYS = 30
LAST = "(SELECT max(day) FROM backups)"
CLOCK = "(SELECT unnest(range(m + 1))::INT AS t FROM (SELECT max(day) AS m FROM backups))"
SESSIONS = f"WITH {FILES_SQL}, {blocks_sql(BLOCK)}, {BACKUPS_SQL}, refs AS (SELECT b.day, b.file_id, c.fp, c.len, c.seq FROM backups b JOIN chunks c ON c.file_id = b.doc_id)"
RATIO = "round(CASE WHEN {1} > 0 THEN {0}::DOUBLE / {1} ELSE 0 END, 6)"


def last_day(spark: SparkSession, sf_dir: str) -> int:
    """The last day that has a backup, from 0; -1 if there is none."""
    found = table(spark, sf_dir, "events").agg(F.datediff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))).alias("last")).first()["last"]
    return -1 if found is None else found


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, fp, len of the contents that backups refer to; contents are chunked once, however often they are backed up."""
    return chunking.fixed_chunks(files(spark, sf_dir), BLOCK).select(F.col("file_id").alias("doc_id"), "seq", "fp", "len")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, file_id, doc_id, seq, fp, len of every chunk of every backup."""
    return backups(spark, sf_dir).join(doc_chunks(spark, sf_dir), "doc_id")


def day_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, fp, len, n: references of a day to a chunk."""
    return refs(spark, sf_dir).groupBy("day", "fp").agg(F.max("len").alias("len"), F.count("*").alias("n"))


@query(f"WITH {BACKUPS_SQL} SELECT day, count(*) AS backups, count(DISTINCT doc_id) AS contents, min(file_id) AS first_file, max(file_id) AS last_file FROM backups GROUP BY day")
def backup_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backups of each day."""
    return backups(spark, sf_dir).groupBy("day").agg(F.count("*").alias("backups"), F.count_distinct("doc_id").alias("contents"), F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"))


SERIES = f"""{SESSIONS}, f AS (SELECT fp, min(day) AS born FROM refs GROUP BY fp), g AS (SELECT r.day, r.fp, max(len) AS len, count(*) AS n, max(born) AS born FROM refs r JOIN f USING (fp) GROUP BY r.day, r.fp),
s AS (SELECT day, sum(n)::BIGINT AS chunks, count(*) FILTER (day = born) AS uniques, sum(n * len)::BIGINT AS logical, coalesce(sum(len) FILTER (day = born), 0)::BIGINT AS written FROM g GROUP BY day)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = day_refs(spark, sf_dir)
    born = per.groupBy("fp").agg(F.min("day").alias("born"))
    new = F.col("day") == F.col("born")
    return per.join(born, "fp").groupBy("day").agg(F.sum("n").alias("chunks"), F.count_if(new).alias("uniques"), F.sum(F.col("n") * F.col("len")).alias("logical"), F.sum(F.when(new, F.col("len")).otherwise(0)).alias("written"))


@query(f"{SERIES} SELECT day, chunks, uniques, chunks - uniques AS dups, logical, written, {RATIO.format('logical', 'written')} AS ratio, (sum(logical) OVER w)::BIGINT AS cumulative_logical, (sum(written) OVER w)::BIGINT AS cumulative_written FROM s WINDOW w AS (ORDER BY day)")
def daily_dedup_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per day: what came in, what was written, running sums."""
    w = Window.orderBy("day")  # a row per day
    return series(spark, sf_dir).select("day", "chunks", "uniques", (F.col("chunks") - F.col("uniques")).alias("dups"), "logical", "written", dedup.ratio(F.col("logical"), F.col("written")).alias("ratio"), F.sum("logical").over(w).alias("cumulative_logical"), F.sum("written").over(w).alias("cumulative_written"))


@query(f"{SERIES} SELECT count(*) AS days, sum(logical)::BIGINT AS logical, sum(written)::BIGINT AS stored, {RATIO.format('sum(logical)', 'sum(written)')} AS ratio, max(written) AS most_written, sum(chunks)::BIGINT AS chunks, sum(uniques)::BIGINT AS uniques FROM s")
def month_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month in a row, without collection."""
    return series(spark, sf_dir).agg(F.count("*").alias("days"), F.sum("logical").alias("logical"), F.sum("written").alias("stored"), dedup.ratio(F.sum("logical"), F.sum("written")).alias("ratio"), F.max("written").alias("most_written"), F.sum("chunks").alias("chunks"), F.sum("uniques").alias("uniques"))


@query(f"""{SERIES} SELECT day, CASE WHEN day = 0 THEN 'first backup' WHEN written = 0 THEN 'nothing new' WHEN (chunks - uniques) / chunks > 0.8 THEN 'mostly duplicates' WHEN uniques / chunks > 0.5 THEN 'mostly new' ELSE 'mixed' END AS kind,
 CASE WHEN day = 0 THEN 'start' WHEN {RATIO.format('logical', 'written')} > 8 THEN 'high' WHEN {RATIO.format('logical', 'written')} > 2 THEN 'middle' ELSE 'low' END AS colour FROM s""")
def day_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word on each day."""
    s = series(spark, sf_dir).withColumn("r", dedup.ratio(F.col("logical"), F.col("written")))
    kind = F.when(F.col("day") == 0, "first backup").when(F.col("written") == 0, "nothing new").when((F.col("chunks") - F.col("uniques")) / F.col("chunks") > 0.8, "mostly duplicates").when(F.col("uniques") / F.col("chunks") > 0.5, "mostly new").otherwise("mixed")
    colour = F.when(F.col("day") == 0, "start").when(F.col("r") > 8, "high").when(F.col("r") > 2, "middle").otherwise("low")
    return s.select("day", kind.alias("kind"), colour.alias("colour"))


@query(f"WITH {BACKUPS_SQL} SELECT day + {KEEP + 1} AS expired_on, count(*) AS copies, count(DISTINCT file_id) AS files FROM backups WHERE day + {KEEP + 1} <= {LAST} GROUP BY day")
def retention_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that expire on each day."""
    return lifecycle.expiries(backups(spark, sf_dir), KEEP, last_day(spark, sf_dir)).groupBy("expired_on").agg(F.count("*").alias("copies"), F.count_distinct("file_id").alias("files"))


@query(f"""WITH RECURSIVE {BACKUPS_SQL}, due AS (SELECT (day + {KEEP + 1})::INT AS run_day, count(*) AS n FROM backups WHERE day + {KEEP + 1} <= {LAST} GROUP BY ALL),
d AS (SELECT t::INT AS run_day, coalesce(n, 0) AS n FROM range((SELECT min(run_day) FROM due), {LAST} + 1) r(t) LEFT JOIN due ON due.run_day = t),
r AS (SELECT run_day, n AS due, least(n, 20) AS taken, greatest(n - 20, 0) AS backlog FROM d WHERE run_day = (SELECT min(run_day) FROM d)
UNION ALL SELECT d.run_day, d.n, least(d.n + r.backlog, 20), greatest(d.n + r.backlog - 20, 0) FROM r JOIN d ON d.run_day = r.run_day + 1)
SELECT run_day, due::BIGINT AS due, taken::BIGINT AS taken, backlog::BIGINT AS backlog FROM r""")
def retention_due_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expiry of at most twenty copies a day, the oldest first: due, taken, and what waits for the next day (the cap is the rule)."""
    due = lifecycle.expiries(backups(spark, sf_dir), KEEP, last_day(spark, sf_dir)).groupBy(F.col("expired_on").cast("int").alias("run_day")).agg(F.count("*").alias("due"))
    days = due.agg(F.explode(F.sequence(F.min("run_day"), F.lit(last_day(spark, sf_dir)))).alias("run_day")).join(due, "run_day", "left").fillna(0, ["due"])
    # one row a day: the queue is its sum of arrivals less the cap, less the least that sum ever was
    w = Window.orderBy("run_day")
    total = days.withColumn("c", F.sum(F.col("due") - 20).over(w))
    waits = total.withColumn("backlog", F.col("c") - F.least(F.lit(0), F.min("c").over(w)))
    return waits.select("run_day", "due", (F.col("due") + F.lag("backlog", 1, 0).over(w) - F.col("backlog")).alias("taken"), "backlog")


QUEUE = f"""WITH RECURSIVE {BACKUPS_SQL}, due AS (SELECT (day + {KEEP + 1})::INT AS run_day, count(*) AS n FROM backups WHERE day + {KEEP + 1} <= {LAST} GROUP BY ALL),
d AS (SELECT t::INT AS run_day, coalesce(n, 0) AS n FROM range((SELECT min(run_day) FROM due), {LAST} + 1) r(t) LEFT JOIN due ON due.run_day = t),
r AS (SELECT run_day, least(n, 20) AS taken, greatest(n - 20, 0) AS backlog FROM d WHERE run_day = (SELECT min(run_day) FROM d)
UNION ALL SELECT d.run_day, least(d.n + r.backlog, 20), greatest(d.n + r.backlog - 20, 0) FROM r JOIN d ON d.run_day = r.run_day + 1),
c AS (SELECT run_day, taken, sum(taken) OVER (ORDER BY run_day) AS up FROM r),
q AS (SELECT day, file_id, row_number() OVER (ORDER BY day, file_id) AS place FROM backups WHERE day + {KEEP + 1} <= {LAST})"""


@query(f"{QUEUE} SELECT place, file_id, day, (day + {KEEP + 1})::INT AS due_on, run_day AS taken_on FROM q LEFT JOIN c ON place > up - taken AND place <= up")
def retention_due_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every expired copy in the order in which it is due, and the day on which a run of at most twenty takes it (null: it still waits at the end)."""
    copies = lifecycle.expiries(backups(spark, sf_dir), KEEP, last_day(spark, sf_dir)).select("day", "file_id", F.col("expired_on").cast("int").alias("due_on"))
    queue = scan.running(scan.in_ranges(copies, [], ["day", "file_id"]), [], ["day", "file_id"], "place").drop("part")
    # a row a day, so the join by ranges has no more than the month's days on its other side
    days = retention_due_capped(spark, sf_dir).withColumn("up", F.sum("taken").over(Window.orderBy("run_day")))
    turns = F.broadcast(days.select(F.col("run_day").alias("taken_on"), (F.col("up") - F.col("taken")).alias("_from"), F.col("up").alias("_to")))
    return queue.join(turns, (F.col("place") > F.col("_from")) & (F.col("place") <= F.col("_to")), "left").select("place", "file_id", "day", "due_on", "taken_on")


LIVE = f"""{SESSIONS}, u AS (SELECT DISTINCT day, fp, len FROM refs), t AS {CLOCK},
w AS (SELECT t, fp, max(len) AS len, max(day) AS last FROM u, t WHERE day <= t GROUP BY t, fp)"""


@query(f"{LIVE} SELECT t AS day, count(*) FILTER (last >= t - {KEEP}) AS live_chunks, coalesce(sum(len) FILTER (last >= t - {KEEP}), 0)::BIGINT AS live_bytes FROM w GROUP BY t")
def live_chunks_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What retention keeps alive at the end of each day."""
    return holes(spark, sf_dir).select("day", "live_chunks", "live_bytes")


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_day = lifecycle.changes(lifecycle.day_lists(day_refs(spark, sf_dir)), 0, 0, KEEP)
    w = Window.orderBy("day")  # a row per day
    days = spark.range(last_day(spark, sf_dir) + 1).select(F.col("id").cast("int").alias("day")).join(by_day, "day", "left")
    sums = days.select("day", *(F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in ("live", "live_n", "used")))
    return sums.filter("used > 0").select("day", F.col("live_n").alias("live_chunks"), F.col("live").alias("live_bytes"), (F.col("used") - F.col("live")).alias("holes"), "used")


@query(f"{LIVE} SELECT t AS day, coalesce(sum(len) FILTER (last < t - {KEEP}), 0)::BIGINT AS holes, sum(len)::BIGINT AS used FROM w GROUP BY t")
def holes_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that nothing refers to any more, without collection."""
    return holes(spark, sf_dir).select("day", "holes", "used")


CONTAINER = 64 * 1024


def between_sql(lo: str, hi: str) -> str:
    """Whether ``days`` has one from ``lo`` to ``hi``."""
    return f"len(list_filter(days, lambda d: d >= {lo} AND d <= {hi})) > 0"


ON_DISK = between_sql(f"greatest(0, c - {KEEP})", "t")
ALIVE = between_sql(f"greatest(0, t - {KEEP})", "t")
BEFORE = between_sql(f"greatest(0, c - {KEEP})", "t - 1")
HOLES = f"coalesce(sum(len) FILTER ({ON_DISK}), 0) - coalesce(sum(len) FILTER ({ALIVE}), 0)"
WHOLE = f"((coalesce({{}}, 0)::BIGINT + {CONTAINER - 1}) // {CONTAINER} * {CONTAINER})"
#: DuckDB CTEs up to ``log``: c is the day of the last collection, each step of ``ran`` finds the next one.
LOG = f"""{SESSIONS.replace('WITH', 'WITH RECURSIVE', 1)}, masks AS MATERIALIZED (SELECT fp, max(len)::BIGINT AS len, list(DISTINCT day) AS days FROM refs GROUP BY fp),
clock AS {CLOCK},
ran AS (SELECT -1 AS c UNION ALL SELECT x FROM (SELECT min(t) AS x FROM (SELECT t FROM masks, clock, ran WHERE t > c GROUP BY t HAVING {HOLES} > {GC}::DOUBLE * {WHOLE.format(f'sum(len) FILTER ({ON_DISK})')})) WHERE x IS NOT NULL),
since AS (SELECT t, max(c) AS c, t IN (SELECT c FROM ran) AS gc FROM clock JOIN ran ON c < t GROUP BY t),
state AS (SELECT t, any_value(gc) AS gc, coalesce(sum(len) FILTER (list_contains(days, t) AND NOT ({BEFORE})), 0)::BIGINT AS written, count(*) FILTER (list_contains(days, t) AND NOT ({BEFORE})) AS new_chunks,
  coalesce(sum(len) FILTER ({ALIVE}), 0)::BIGINT AS live, count(*) FILTER ({ALIVE}) AS live_n, coalesce(sum(len) FILTER ({ON_DISK}), 0)::BIGINT AS used, count(*) FILTER ({ON_DISK}) AS used_n FROM masks, since GROUP BY t),
log AS (SELECT t AS day, written, new_chunks, live AS live_bytes, CASE WHEN gc THEN live ELSE used END AS used, CASE WHEN gc THEN 0 ELSE used - live END AS holes, {WHOLE.format('CASE WHEN gc THEN live ELSE used END')} AS disk, CASE WHEN gc THEN live_n ELSE used_n END AS entries,
  CASE WHEN used > 0 THEN round((used - live)::DOUBLE / {WHOLE.format('used')}, 6) ELSE 0 END AS holes_ratio_before_gc, CASE WHEN gc THEN live ELSE 0 END AS gc, CASE WHEN gc OR used = 0 THEN 0 ELSE round((used - live)::DOUBLE / {WHOLE.format('used')}, 6) END AS holes_ratio_after_gc FROM state)"""


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store day by day, under collection."""
    return lifecycle.collections(spark, lifecycle.day_lists(day_refs(spark, sf_dir)), last_day(spark, sf_dir) + 1, KEEP, GC, CONTAINER)


@query(f"{LOG} SELECT * FROM log")
def gc_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's holes and collection: what it found, what it rewrote."""
    return collected(spark, sf_dir)


@query(f"{LOG} SELECT sum(written)::BIGINT AS stored, sum(gc)::BIGINT AS rewritten, count(*) FILTER (gc > 0) AS gc_runs, round((sum(written) + sum(gc))::DOUBLE / sum(written), 6) AS wa, round(sum(gc)::DOUBLE / (sum(written) + sum(gc)), 6) AS gc_share FROM log")
def write_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes put on disk for each byte that had to be stored."""
    log = collected(spark, sf_dir)
    s, g = F.sum("written"), F.sum("gc")
    return log.agg(s.alias("stored"), g.alias("rewritten"), F.count_if(F.col("gc") > 0).alias("gc_runs"), F.round((s + g) / s, 6).alias("wa"), F.round(g / (s + g), 6).alias("gc_share"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard, file_id, days, body: sessions with contents, sixteen files a shard; a file's content comes once with all the days that have it."""
    days = backups(spark, sf_dir).groupBy("file_id", "doc_id").agg(F.collect_list("day").alias("days"))
    return days.join(files(spark, sf_dir).select(F.col("file_id").alias("doc_id"), "body"), "doc_id").select(F.floor(F.col("file_id") / 16).alias("shard"), "file_id", "days", "body")


MONTH = DedupConfig(bits=9, container_bytes=32 * 1024)


@query()
def month_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole life of the store, with containers and collection, day by day."""
    return lifecycle.simulate(bodies(spark, sf_dir), MONTH, last_day(spark, sf_dir) + 1)


@query()
def month_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month's balance for no delta, delta by place and delta by recency, with savings against the first."""
    cfgs = [MONTH, DedupConfig(bits=9, container_bytes=32 * 1024, delta=True), DedupConfig(bits=9, container_bytes=32 * 1024, delta=True, delta_pick="recent")]
    each = lifecycle.simulate_each(bodies(spark, sf_dir), cfgs, last_day(spark, sf_dir) + 1)
    name = F.element_at(F.array(*map(F.lit, ("off", "index", "recent"))), F.col("k").cast("int") + 1)
    out = lifecycle.write_amplification(each, "k").select(F.col("k").cast("int").alias("ord"), name.alias("delta"), "*").drop("k")
    w = Window.orderBy("ord")  # three rows
    return out.withColumn("saved", F.round(1 - F.col("stored") / F.first("stored").over(w), 6))


@query()
def restore_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every live copy after the month restored through containers and chains."""
    return lifecycle.restores(bodies(spark, sf_dir), DedupConfig(bits=9, container_bytes=32 * 1024, delta=True), last_day(spark, sf_dir) + 1)


@query()
def generated_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty generated files through a month by type: ratio, write amplification, collections. Seeded; tests check its invariants."""
    out = None
    for kind in ("code", "vm", "logs"):
        cfg = DedupConfig(bits=10, container_bytes=256 * 1024)
        one = lifecycle.write_amplification(lifecycle.simulate(lifecycle.generated_backups(spark, cfg, kind, files=24, kilobytes=32), cfg, DAYS)).select(F.lit(kind).alias("type"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{SERIES} SELECT day, 'backup' AS kind, count(*) AS n, max(logical)::BIGINT AS bytes FROM s GROUP BY day UNION ALL SELECT day + {KEEP + 1}, 'expire', count(*), 0 FROM backups WHERE day + {KEEP + 1} <= {LAST} GROUP BY day")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened: backups and expiries."""
    s = series(spark, sf_dir).select("day", F.lit("backup").alias("kind"), F.lit(1).cast("long").alias("n"), F.col("logical").alias("bytes"))
    e = lifecycle.expiries(backups(spark, sf_dir), KEEP, last_day(spark, sf_dir)).groupBy(F.col("expired_on").alias("day")).agg(F.count("*").alias("n")).select("day", F.lit("expire").alias("kind"), "n", F.lit(0).cast("long").alias("bytes"))
    return s.unionByName(e)


@query(f"""{SESSIONS}, d AS (SELECT DISTINCT file_id FROM backups), n AS (SELECT count(*) AS n FROM d), c AS (SELECT file_id, row_number() OVER (ORDER BY file_id) - 1 AS rn FROM d),
s AS (SELECT unnest(range(12))::INT AS s) SELECT s, greatest(0, {LAST} - s * greatest(1, {LAST} // 11))::INT AS day, file_id FROM s, n JOIN c ON c.rn = (s.s * 7) % n.n""")
def restore_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which twelve copies a spot check restores (a sampling operator): spread over days and files."""
    rank, total = ranked(backups(spark, sf_dir).select("file_id").distinct())
    last = last_day(spark, sf_dir)
    pick = spark.range(12).select(F.col("id").cast("int").alias("s")).crossJoin(F.broadcast(total)).withColumn("rn", F.pmod(F.col("s") * 7, F.col("total")))
    return pick.join(rank, "rn").select("s", F.greatest(F.lit(0), F.lit(last) - F.col("s") * max(1, last // 11)).cast("int").alias("day"), "file_id")


def ranked(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id and its rank rn from 0, one row with their total) of distinct files."""
    # a dense rank without one task's order: ranks within ranges of ids, shifted by the counts of the ranges before
    part = F.floor(F.col("file_id") / 4096)
    sizes = d.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rank = d.withColumn("part", part).withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("file_id")) - 1).join(base, "part").select("file_id", (F.col("rn") + F.col("base")).alias("rn"))
    return rank, sizes.agg(F.sum("n").alias("total"))
