"""Incremental ingestion on Structured Streaming.

``chunk_stream`` cuts files that arrive in pieces: the state of a file is its open chunk and the few bytes before it, so a file of any length
takes bounded state, kept in the state store (RocksDB where set) and dropped when the file ends. ``dedup_stream`` keeps, within a watermark, the
first chunk of each fingerprint. ``expiry_stream`` has a timer for the next copy of each file that retention will drop. ``ingest_batches`` is the in-line form against a durable store: each micro-batch is anti-joined with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from chunkloom.config import DedupConfig
from chunkloom.functions.gear import Resumable
from chunkloom.operators.dedup import new_chunks

CHUNKS = "file_id long, seq int, off long, len long, fp string"
EXPIRED = "file_id long, backed_up date, expired_on date"
DAY = 86_400_000  # milliseconds
STATE = "before binary, open binary, offset long, seq int"


def chunk_stream(pieces: DataFrame, cfg: DedupConfig) -> DataFrame:
    """Chunks of a stream of pieces (file_id, part, data, last), the parts of a file arriving in order of ``part``."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = Resumable(cfg, *(state.get if state.exists else (b"", b"", 0, 0)))
        c.before, c.open = bytes(c.before), bytes(c.open)
        rows, ended = [], False
        for f in [pd.concat(list(frames)).sort_values("part")]:
            for data, last in zip(f["data"], f["last"], strict=True):
                ended = ended or bool(last)
                rows += [(key[0], seq, off, len(b), hashlib.md5(b, usedforsecurity=False).hexdigest()) for seq, off, b in c.feed(bytes(data or b""), bool(last))]
        if ended:
            state.remove()
        else:
            state.update((c.before, c.open, c.offset, c.seq))
        yield pd.DataFrame(rows, columns=["file_id", "seq", "off", "len", "fp"])

    return pieces.groupBy("file_id").applyInPandasWithState(step, CHUNKS, STATE, "append", GroupStateTimeout.NoTimeout)


def dedup_stream(chunks: DataFrame, time: str, late: str = "7 days") -> DataFrame:
    """The first chunk of each fingerprint within ``late``; older state goes with the watermark."""
    return chunks.withWatermark(time, late).dropDuplicatesWithinWatermark(["fp"])


class Retention(StatefulProcessor):
    """The copies of a file that are kept: a state of the days that have one, and a timer for the day on which the oldest goes; when it fires, the timer of the next is set.

    The state is read and written once for a batch's rows of a file and once for a timer, however many copies it holds.
    """

    def __init__(self, keep: int):
        self.after = (keep + 1) * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "days array<long>")

    def gone(self, file_id: int, days: list[int]) -> pd.DataFrame:
        date = lambda ms: pd.Timestamp(ms, unit="ms").date()
        return pd.DataFrame([(file_id, date(d), date(d + self.after)) for d in days], columns=["file_id", "backed_up", "expired_on"])

    def days(self) -> list[int]:
        return sorted(map(int, self.kept.get()[0])) if self.kept.exists() else []

    def keep_(self, days: list[int]) -> None:
        if days:
            self.kept.update((days,))
        else:
            self.kept.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now, before = timerValues.getCurrentWatermarkInMs(), self.days()
        new = {int(d) for f in rows for d in f["day"].unique()} - set(before)
        gone = sorted(d for d in new if d + self.after <= now)  # they came when their time was over
        days = sorted({*before, *new} - set(gone))
        if days != before:
            self.keep_(days)
            if not before or days[0] < before[0]:
                if before:
                    self.handle.deleteTimer(before[0] + self.after)
                self.handle.registerTimer(days[0] + self.after)
        if gone:
            yield self.gone(key[0], gone)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, days = timerValues.getCurrentWatermarkInMs(), self.days()
        gone, left = [d for d in days if d + self.after <= now], [d for d in days if d + self.after > now]
        self.keep_(left)
        if left:
            self.handle.registerTimer(left[0] + self.after)
        yield self.gone(key[0], gone)

    def close(self) -> None: ...


def expiry_stream(events: DataFrame, keep: int, late: str = "1 day") -> DataFrame:
    """file_id, backed_up and expired_on (dates, UTC) of each copy as the watermark of ``events`` (file_id, ts) reaches the day on which it goes.

    A file has one copy a day however many events. Its state is the days kept, no more than ``keep`` and the days the watermark is behind; rows behind the
    watermark are dropped, a null ``ts`` or ``file_id`` is no backup. Timers and state are in the state store and survive a restart from the checkpoint.
    The session's state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    day = (F.floor(F.unix_millis("ts") / DAY) * DAY).cast("long").alias("day")
    copies = events.filter("ts IS NOT NULL AND file_id IS NOT NULL").withWatermark("ts", late).select("file_id", "ts", day)
    return copies.groupBy("file_id").transformWithStateInPandas(Retention(keep), EXPIRED, "Append", "EventTime")


def daily_totals(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events by day of event time, final once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Backup sessions of a user: events less than ``gap`` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def ingest_batches(chunks: DataFrame, store_path: str, checkpoint: str):
    """Start a query that appends each micro-batch's new chunks (fp, chunk_id, len) to the table at ``store_path``.

    A batch is written under its number, so one that is done again after a failure replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(store_path).filter(F.col("batch") != number)
        except Exception as e:  # nothing is stored yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = spark.createDataFrame([], "fp string")
        new_chunks(batch, known).write.mode("overwrite").parquet(f"{store_path}/batch={number}")

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
