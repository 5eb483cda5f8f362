"""Progress, completion and expiry of jobs as stream state.

Two stateful operators in a row. The first keeps the last outcome of every card, sharded by card, so that a job
with most of the cards is not one task; it sends what a trigger changed in a job's counters. Tasks add these up
before the second operator, which keeps the counters of each job and says once that they meet the total.
Nothing that an earlier trigger wrote is read again; a trigger that runs again starts from the state before it.

A job that ended is dropped with all its cards ``keep_hours`` of event time after its end. Events later than the
watermark are left out by both operators, so none brings a dropped job back; a job that registers cards again
after its end is a new run: its timer is void, and it is announced anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

SHARDS = 16
HOUR = 3_600_000
CHANGE = "job_id long, ts timestamp, processed long, failed long, total long, opened boolean, ended timestamp"
DONE = "job_id long, ts timestamp, processed long, failed long, total long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UNITS = {"pending": (0, 0), "success": (1, 0), "failed": (0, 1)}
END = ("done", "error")


def _millis(ts: pd.Timestamp) -> int:
    return int(ts.timestamp() * 1000)


def _moment(millis: int) -> pd.Timestamp:
    return pd.Timestamp(millis, unit="ms")


def _blank(value) -> bool:
    """Null in a column of pandas: None, NaN or NaT."""
    return value is None or value != value


def _columns(rows: Iterator[pd.DataFrame], *names: str) -> list[list]:
    """Columns of the rows of a key, in order of arrival. A key has few rows: lists cost less than frames."""
    frames = list(rows)
    return [[value for frame in frames for value in frame[name].tolist()] for name in names]


def _last_outcomes(rows: list[tuple]) -> dict[int, tuple | None]:
    """The last outcome (status, ts, event_id) of each card among its rows, None if all are pending.

    The later time wins, then the higher event, then the row that came last; nulls count as latest.
    """
    rank = lambda value: (1, 0) if _blank(value) else (0, value)
    last: dict[int, tuple | None] = {}
    ranks: dict[int, tuple] = {}
    for card, status, ts, event_id in rows:
        card = int(card)
        last.setdefault(card, None)
        if status != "pending":
            at = (rank(ts), rank(event_id))
            if card not in ranks or at >= ranks[card]:
                ranks[card], last[card] = at, (status, ts, event_id)
    return last


class _Cards(StatefulProcessor):
    """Last outcome of the cards of one shard of a job."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle = handle
        self.cards = handle.getMapState("cards", "card long", "status string, ts timestamp, event_id long")
        self.end = handle.getValueState("end", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = _columns(rows, "card", "status", "ts", "event_id")
        stamps = columns[2]
        end = self.end.get()
        ended = end[0] if end else None
        ends = [ts for card, ts in zip(columns[0], stamps) if _blank(card)]
        cards = [row for row in zip(*columns) if not _blank(row[0])]
        opened = False
        if ended is not None and (later := [ts for _, status, ts, _ in cards if status == "pending" and ts > _moment(ended)]):
            self.cards.clear()  # a new run of the job
            self.end.clear()
            cards, ended, opened = [row for row in cards if row[2] >= min(later)], None, True
        change = [0, 0, 0]
        new = not self.cards.exists()  # nothing to look up card by card
        for card, row in _last_outcomes(cards).items():
            place, before = (card,), None
            if not new:
                before = self.cards.getValue(place)
            known = before is not None
            before = before if known else ("pending", None, None)
            last = tuple(before)
            if row is not None:
                status, ts, event_id = row
                if last[1] is None or (ts, event_id) > (pd.Timestamp(last[1]), last[2]):
                    last = (status, ts.to_pydatetime(), int(event_id))
            if not known or last[0] != before[0] or last[1] != before[1]:
                self.cards.updateValue(place, last)
            for i in (0, 1):
                change[i] += UNITS[last[0]][i] - UNITS[before[0]][i]
            change[2] += not known
        if ends:
            at = max(_millis(ts) for ts in ends)
            if ended is None or at > ended:
                ended = at
                self.end.update((at,))
                self.handle.registerTimer(at + self.keep)
        told = ended if ends and key[1] == 0 else None
        if any(change) or opened or told is not None:
            now = max(_millis(max(ts for ts in stamps if not _blank(ts))), timerValues.getCurrentWatermarkInMs())
            row = [key[0], _moment(now), *change, opened, pd.NaT if told is None else _moment(told)]
            yield pd.DataFrame([row], columns=["job_id", "ts", "processed", "failed", "total", "opened", "ended"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.end.exists() and self.end.get()[0] + self.keep == expiredTimerInfo.getExpiryTimeInMs():
            self.cards.clear()
            self.end.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Jobs(StatefulProcessor):
    """Counters of one job, and whether it was announced."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "processed long, failed long, total long, announced boolean, ended long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stamps, opened, ends, *changes = _columns(rows, "ts", "opened", "ended", "processed", "failed", "total")
        processed, failed, total, announced, ended = self.counters.get() or (0, 0, 0, False, None)
        if any(opened) and ended is not None:
            processed, failed, total, announced, ended = 0, 0, 0, False, None
        processed, failed, total = (n + int(sum(change)) for n, change in zip((processed, failed, total), changes))
        if ends := [ts for ts in ends if not _blank(ts)]:
            ended = _millis(max(ends))
            self.handle.registerTimer(ended + self.keep)
        fires = not announced and total > 0 and processed + failed == total
        self.counters.update((processed, failed, total, announced or fires, ended))
        if fires:
            now = max(_millis(max(stamps)), timerValues.getCurrentWatermarkInMs())
            yield pd.DataFrame([[key[0], _moment(now), processed, failed, total]], columns=["job_id", "ts", "processed", "failed", "total"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counters.exists() and (ended := self.counters.get()[4]) is not None and ended + self.keep == expiredTimerInfo.getExpiryTimeInMs():
            self.counters.clear()
        return iter(())

    def close(self) -> None:
        pass


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of one task, one row per job and batch, so that the shards of a job do not all travel."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch]).group_by("job_id").aggregate(
                [("ts", "max"), ("processed", "sum"), ("failed", "sum"), ("total", "sum"), ("opened", "any"), ("ended", "max")]
            )
            names = {"ts_max": "ts", "processed_sum": "processed", "failed_sum": "failed", "total_sum": "total", "opened_any": "opened", "ended_max": "ended"}
            named = table.rename_columns([names.get(n, n) for n in table.column_names]).select(batch.schema.names)
            yield from named.cast(batch.schema).to_batches()


def completion_events(events: DataFrame, ends: DataFrame | None = None, delay: str = "1 hour", keep_hours: int = 24, shards: int = SHARDS) -> DataFrame:
    """Stream of jobs whose every registered card has an outcome, each once: (job_id, ts, processed, failed, total).

    ``events(job_id, card, status, ts, event_id)`` and ``ends(job_id, status, ts)`` are streams; a job ends with status
    done or error. Run it with :func:`run_events`.
    """
    fields = ["job_id", "shard", "card", "status", "ts", "event_id"]
    rows = events.withColumns(
        {"job_id": F.col("job_id").cast("long"), "card": F.col("card").cast("long"), "event_id": F.col("event_id").cast("long")}
    ).withColumns({"shard": F.pmod(F.xxhash64("card"), F.lit(shards)).cast("int"), "ts": F.col("ts").cast("timestamp")}).select(*fields)
    if ends is not None:
        of_shards = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
        rows = rows.unionByName(
            ends.filter(F.col("status").isin(*END)).select(
                F.col("job_id").cast("long").alias("job_id"), of_shards.alias("shard"), F.lit(None).cast("long").alias("card"), "status", F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("event_id")
            )
        )
    keep = keep_hours * HOUR
    changes = (
        rows.withWatermark("ts", delay)
        .groupBy("job_id", "shard")
        .transformWithStateInPandas(_Cards(keep), CHANGE, "append", "EventTime", eventTimeColumnName="ts")
    )
    summed = changes.mapInArrow(_added, CHANGE)
    return summed.groupBy("job_id").transformWithStateInPandas(_Jobs(keep), DONE, "append", "EventTime", eventTimeColumnName="ts")


def run_events(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Drain the available input into a table; state lives in the state store that keeps timers."""
    spark: SparkSession = stream.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STORE)
    try:
        query = (
            stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
        )
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
    return query


def state_rows(query: StreamingQuery) -> int:
    """Rows of state after the last trigger, of all operators."""
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])
