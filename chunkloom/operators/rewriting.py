"""Rewriting what lies in sparse containers, as sessions go by: a session inherits from the one before which containers it used sparsely.

A session writes what no earlier one stored, and once more the duplicates whose newest copy lies in an inherited container; later sessions refer to
the newer copy, the older stays for the sessions that have it. Within a session containers are filled in order of the stream: a chunk lies in the
container that its first byte falls in, a running sum over ranges.

Rows are runs: chunks in a row that are used in the same sessions and whose first places there are in a row too, so they always move together; a
run is cut where a container ends. A run carries its list of uses and goes from each to the next, so a session reads the runs that it
uses and no others. Of containers there is one small row for each session that uses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from chunkloom.operators import scan
from chunkloom.sources.storage import new_path, stored

HOME = ["home", "container"]
#: Chunks of a run at most.
RUN = 128
#: Runs that a task takes at most in order, or writes without a shuffle.
RANGE = 100_000


def runs(chunks: DataFrame, uses: DataFrame, members: bool = False) -> DataFrame:
    """The runs of ``chunks`` (content, seq, fp, len) under ``uses`` (session, an int, file_id, content), each distinct chunk in one of them.

    run (its first fp), at (where its chunks begin), len (bytes), uses (session, file_id, seq of the first chunk's first place, by session) and, if ``members``, fps.
    """
    lists = uses.groupBy("content", "session").agg(F.min("file_id").alias("file_id")).groupBy("content").agg(F.array_sort(F.collect_list(F.struct("session", "file_id"))).alias("list"))
    lists = stored(lists, "lists")
    every = stored(chunks.join(lists.select("content"), "content", "left_semi"), "chunks")
    held = stored(every.groupBy("fp").agg(F.min("content").alias("content"), F.max("content").alias("other"), F.min("seq").alias("seq"), F.max("len").alias("len")), "held")
    place = lambda seq: F.transform("list", lambda u: F.struct(u["session"].alias("session"), u["file_id"].alias("file_id"), seq.alias("seq")))
    # chunks of one content have its uses, and their list need not be made for each
    own = _runs(held.filter("content = other"), "content", members).join(lists, "content").select("run", "at", "len", place(F.col("seq")).alias("uses"), *["fps"] * members)
    shared = every.join(held.filter("content <> other").select("fp"), "fp", "left_semi").join(lists, "content").select("fp", "seq", "len", F.explode("list").alias("u"))
    first = shared.groupBy("fp", "u.session").agg(F.min(F.struct("u.file_id", "seq")).alias("p"), F.max("len").alias("len"))
    listed = first.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("session", "p.file_id", "p.seq"))).alias("list"), F.max("len").alias("len"))
    begin = F.col("list")[0]["seq"]
    beside = F.transform("list", lambda u: F.struct(u["session"].alias("session"), u["file_id"].alias("file_id"), (u["seq"] - begin).alias("by")))
    moved = lambda: F.transform("beside", lambda u: F.struct(u["session"].alias("session"), u["file_id"].alias("file_id"), (u["by"] + F.col("seq")).alias("seq")))
    met = _runs(listed.select("fp", "len", begin.alias("seq"), beside.alias("beside")), "beside", members).select("run", "at", "len", moved().alias("uses"), *["fps"] * members)
    return stored(own.unionByName(met), "runs")


def _runs(chunks: DataFrame, by: str, members: bool) -> DataFrame:
    """``by``, seq, run, at, len of what stands in a row within ``by``: a group is a content or what one has."""
    w = Window.partitionBy(by).orderBy("seq")
    numbered = chunks.select(by, "seq", "fp", "len", (F.col("seq") - F.row_number().over(w)).alias("row"), (F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")).alias("off"))
    fps = [F.transform(F.array_sort(F.collect_list(F.struct("seq", "fp"))), lambda x: x["fp"]).alias("fps")] * members
    found = numbered.groupBy(by, "row", F.floor(F.col("seq") / RUN).alias("_block")).agg(F.min(F.struct("seq", "fp")).alias("f"), F.sort_array(F.collect_list("off")).alias("offs"), F.sum("len").alias("len"), *fps)
    return found.select(by, "f.seq", F.col("f.fp").alias("run"), F.transform("offs", lambda x: x - F.col("offs")[0]).alias("at"), "len", *["fps"] * members)


def filled(rows: DataFrame, capacity: int, by: list[str], n: int | None = None) -> DataFrame:
    """Runs or parts of runs (``by``, start, at, len, file_id, seq) cut where containers end, with container, from 0 within ``by``, in order of (file_id, seq); in ``n`` ranges."""
    order = ["file_id", "seq"]
    if n == 1:
        up = rows.withColumn("_up", F.sum("len").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        up = scan.running(scan.in_ranges(rows, by, order, n), by, order, "_rn", _up="len")
    before = F.col("_up") - F.col("len")
    of = lambda x: F.floor((before + x) / capacity)
    first, last = of(F.lit(0)), of(F.element_at("at", -1))
    part = lambda start, at, n, c: F.struct(start.cast("int").alias("start"), at.alias("at"), n.alias("len"), c.alias("container"))

    def piece(c: Column) -> Column:
        here, behind = F.filter("at", lambda x: of(x) == c), F.filter("at", lambda x: of(x) > c)
        end = F.coalesce(F.get(behind, F.lit(0)), F.col("len"))
        return part(F.col("start") + F.size(F.filter("at", lambda x: of(x) < c)), F.transform(here, lambda x: x - F.get(here, F.lit(0))), end - F.get(here, F.lit(0)), c)

    # a container that no chunk begins in has no piece
    cut = F.filter(F.transform(F.sequence(first, last), piece), lambda x: F.size(x["at"]) > 0)
    cuts = F.when(first == last, F.array(part(F.col("start"), F.col("at"), F.col("len"), first))).otherwise(cut)
    return up.withColumn("_cut", F.explode(cuts)).select(*(c for c in rows.columns if c not in ("start", "at", "len", "container")), "_cut.*")


def replayed(found: DataFrame, capacity: int, threshold: float = 0.5) -> tuple[DataFrame, DataFrame] | None:
    """The runs' moves (session, run, start, at, len, home and container of the copy used, written in this session, again: a rewrite) and the
    containers' uses (session, home, container, chunks, live: bytes used; fresh: bytes written first; rewritten chunks, rewritten_bytes). None if there are no runs.

    Moves are stored by the session of the run's next use, which reads them. The driver holds the numbers of the sessions only; a session is three jobs or a few more
    over its own runs and the containers.
    """
    spark = found.sparkSession
    moves, places, last = new_path(spark, "moves"), new_path(spark, "places"), None
    use = lambda i: F.get("uses", F.lit(i))
    none, no = F.lit(None).cast("long"), F.lit(False)
    start = found.select(F.lit(None).cast("int").alias("session"), "run", F.lit(0).alias("start"), "at", "len", "uses", *(none.alias(c) for c in HOME), no.alias("written"), no.alias("again"))

    def send(rows: DataFrame, few: bool = False) -> None:
        rows = rows.withColumn("next", use(0)["session"])
        (rows.coalesce(1) if few else rows.hint("rebalance", "next")).write.mode("append").partitionBy("next").parquet(moves)

    send(start)
    read = lambda schema, path: spark.read.schema(schema).parquet(path)
    met = None
    for (now,) in found.select(F.explode("uses.session").alias("session")).distinct().orderBy("session").collect():
        here = read(start.schema, f"{moves}/next={now}").drop("session", "written", "again")
        if met is None:
            here = here.withColumn("again", no)
        else:
            live = F.sum(F.when(F.col("session") == last, F.col("live"))).alias("live")
            sparse = met.groupBy(*HOME).agg(F.sum(F.col("fresh") + F.col("rewritten_bytes")).alias("used"), live).filter(F.col("live") < F.col("used") * threshold)
            here = here.join(sparse.select(*HOME, F.lit(True).alias("again")), HOME, "left").withColumn("again", F.coalesce("again", no))
        goes, counted = F.col("home").isNull() | F.col("again"), Observation()
        here = here.select("run", "start", "at", "len", "uses", *HOME, "again").observe(counted, F.count("*").alias("all"), F.count_if(goes).alias("new"))
        here = stored(here, "found")
        rows = here.filter(goes).select("run", "start", "at", "len", "uses", "again", use(0)["file_id"].alias("file_id"), (use(0)["seq"] + F.col("start")).alias("seq"))
        new = filled(rows, capacity, [], 1 + counted.get["new"] // RANGE).withColumns({"home": F.lit(now).cast("long"), "written": F.lit(True)})
        kept = here.filter(~goes).withColumn("written", no)
        rest = F.slice("uses", F.lit(2), F.size("uses"))
        out = new.select(*kept.columns).unionByName(kept).withColumns({"session": F.lit(now), "uses": rest}).select(*start.columns)
        send(out, counted.get["all"] <= RANGE)
        size = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
        n, again = F.size("at").cast("long"), F.col("again")
        by = out.groupBy("session", *HOME).agg(F.sum(n).alias("chunks"), F.sum("len").alias("live"), size(F.col("written") & ~again, F.col("len")).alias("fresh"), size(again, n).alias("rewritten"), size(again, F.col("len")).alias("rewritten_bytes"))
        by.write.mode("append").partitionBy("session").parquet(places)
        met, last = read(by.schema, places), now
    return None if met is None else (read(start.schema, moves).filter(F.col("session").isNotNull()), met)


def use(places: DataFrame) -> DataFrame:
    """``places`` (of ``replayed``) with used, all bytes of the container: what a session doesn't use it doesn't know of."""
    return places.join(places.groupBy(*HOME).agg(F.sum(F.col("fresh") + F.col("rewritten_bytes")).alias("used")), HOME)


def unmoved_runs(found: DataFrame, capacity: int) -> DataFrame:
    """run, start, at, len, uses, home, container where nothing is rewritten: a run stays where the first session put it, so one pass does for all."""
    first = F.col("uses")[0]
    rows = found.select("run", F.lit(0).alias("start"), "at", "len", "uses", first["session"].alias("home"), first["file_id"].alias("file_id"), first["seq"].alias("seq"))
    return filled(rows, capacity, ["home"]).drop("file_id", "seq")


def _of_sessions(sessions: DataFrame) -> DataFrame:
    """The runs of references (session, file_id, seq, fp, len): a file of a session is a content of its own."""
    content = F.struct("session", "file_id").alias("content")
    return runs(sessions.select(content, "seq", "fp", "len"), sessions.select("session", "file_id", content).distinct(), members=True)


def _by_chunk(pieces: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """session, fp, len and ``columns`` of each chunk of ``pieces`` of the runs ``found``."""
    end = lambda i: F.coalesce(F.get("at", i + 1), F.col("len"))
    each = F.transform(F.sequence(F.lit(0), F.size("at") - 1), lambda i: F.struct(F.get("fps", F.col("start") + i).alias("fp"), (end(i) - F.get("at", i)).alias("len")))
    rows = pieces.join(found.select("run", "fps"), "run").withColumn("x", F.explode(each))
    return rows.select("session", "x.fp", "x.len", *columns)


def rewritten(sessions: DataFrame, capacity: int, threshold: float = 0.5) -> DataFrame:
    """session, fp, len, home and container (the session that wrote the copy used, and where), written (in this session) and again (a rewrite).

    ``sessions`` has session (an int), file_id, seq, fp, len of every reference; a chunk counts once for each session, at its first place. An empty
    table gives an empty one.
    """
    found = _of_sessions(sessions)
    done = replayed(found, capacity, threshold)
    columns = [F.col("session").cast("long").alias("session"), "fp", "len", *HOME, "written", "again"]
    if done is None:
        return sessions.select("session", "fp", "len", *(F.lit(None).cast("long").alias(c) for c in HOME), F.lit(True).alias("written"), F.lit(False).alias("again")).limit(0).select(*columns)
    return _by_chunk(done[0], found, *HOME, "written", "again").select(*columns)


def unmoved(sessions: DataFrame, capacity: int) -> DataFrame:
    """session, fp, len, home, container of each chunk of each session where nothing is rewritten."""
    found = _of_sessions(sessions)
    pieces = unmoved_runs(found, capacity).withColumn("session", F.explode("uses.session"))
    return _by_chunk(pieces, found, *HOME)
