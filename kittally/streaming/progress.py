"""Card progress: counters, completion, messages and job state, in batch and as a stream.

Events: job_id, card, status (pending, success, failed), ts, event_id. A card counts by its last
outcome in event order; repeats change nothing, and a later outcome moves one unit. The stream
keeps one small state per card, not per job, so a job with most of the cards has no hot task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as X


def last_outcomes(events: DataFrame) -> DataFrame:
    """Last outcome of each card, pending if it has none yet."""
    ended = F.when(F.col("status") != "pending", F.struct("ts", "event_id"))
    return events.groupBy("job_id", "card").agg(
        F.coalesce(F.max_by("status", ended), F.lit("pending")).alias("status"),
        F.max(F.when(F.col("status") != "pending", F.col("ts"))).alias("ts"),
    )


def register_cards(events: DataFrame) -> DataFrame:
    """Number of cards per job."""
    return events.select("job_id", "card").distinct().groupBy("job_id").agg(F.count("card").alias("total"))


def progress(events: DataFrame) -> DataFrame:
    """Counters per job."""
    s = F.col("status")
    return (
        last_outcomes(events)
        .groupBy("job_id")
        .agg(
            F.count(F.when(s == "success", 1)).alias("processed"),
            F.count(F.when(s == "failed", 1)).alias("failed"),
            F.count(F.lit(1)).alias("total"),
        )
    )


def completed_jobs(counters: DataFrame) -> DataFrame:
    """Jobs whose every card has an outcome."""
    return counters.filter(F.col("processed") + F.col("failed") == F.col("total")).select("job_id")


def progress_messages(counters: DataFrame) -> DataFrame:
    """Message per job with its percentage."""
    return counters.select(
        "job_id", "processed", "failed", "total", X.percent("processed", "failed", "total").alias("percent")
    )


def failed_cards(events: DataFrame, message: str | None = None) -> DataFrame:
    """Cards whose last outcome is a failure (T4); with ``message``, that column of the outcome's event."""
    if message is None:
        return last_outcomes(events).filter("status = 'failed'").select("job_id", "card")
    ended = F.when(F.col("status") != "pending", F.struct("ts", "event_id"))
    last = events.groupBy("job_id", "card").agg(F.max_by(F.struct("status", F.col(message).alias("m")), ended).alias("last"))
    return last.filter("last.status = 'failed'").select("job_id", "card", F.col("last.m").alias("error_message"))


def stale_jobs(jobs: DataFrame, now, hours: int = 24) -> DataFrame:
    """Finished jobs created before ``now`` less ``hours`` (T5)."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    return jobs.filter((F.col("created_at") < cutoff) & F.col("status").isin("done", "error")).select("job_id")


def drop_jobs(rows: DataFrame, stale: DataFrame) -> DataFrame:
    """Rows of the jobs that stay (T5)."""
    return rows.join(stale.select("job_id"), "job_id", "left_anti")


def final_status(counters: DataFrame, has_output: str = "has_output") -> DataFrame:
    """Closing status, stage and message of each job."""
    none, clean = ~F.col(has_output), F.col("failed") == 0
    return counters.select(
        "job_id",
        F.when(none, "error").when(clean, "done").otherwise("error").alias("status"),
        F.when(none, "completed").when(clean, "completed").otherwise("completed_with_errors").alias("stage"),
        F.when(none, "No translated cards generated. Check mapping_config and card parsing logs.")
        .when(~clean, F.concat(F.lit("Completed with "), F.col("failed").cast("string"), F.lit(" failed cards")))
        .alias("error"),
    )


def valid_transitions(requests: DataFrame) -> DataFrame:
    """Requested actions that a job's state allows, with the state they lead to.

    ``requests(job_id, status, bom_uploaded, archive_uploaded, action)``, action one of start and
    cancel. Starting again from an end state clears the counters.
    """
    status, action = F.col("status"), F.col("action")
    first = (action == "start") & (status == "awaiting_upload") & F.col("bom_uploaded") & F.col("archive_uploaded")
    again = (action == "start") & status.isin("error", "done")
    cancel = (action == "cancel") & (status == "processing")
    return requests.filter(first | again | cancel).select(
        "job_id",
        "action",
        F.when(cancel, "error").otherwise("processing").alias("new_status"),
        F.when(cancel, "cancelled").otherwise("unpacking").alias("new_stage"),
        again.alias("reset_counters"),
    )


# --- stream ------------------------------------------------------------------

DELTA_SCHEMA = "job_id long, card long, processed int, failed int, total int"
STATE_SCHEMA = "status string, ts timestamp, event_id long"
STEP = {"pending": (0, 0), "success": (1, 0), "failed": (0, 1)}


def _card_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counter change of one card from the events of one trigger."""
    known = state.exists
    status, ts, event_id = state.get if known else ("pending", None, None)
    before = STEP[status]
    for batch in batches:
        outcomes = batch[batch["status"] != "pending"]
        for row in outcomes.sort_values(["ts", "event_id"]).tail(1).itertuples(index=False):
            if ts is None or (row.ts, row.event_id) > (ts, event_id):
                status, ts, event_id = row.status, row.ts, int(row.event_id)
    state.update((status, ts, event_id))
    after = STEP[status]
    if known and after == before:
        return
    yield pd.DataFrame(
        {
            "job_id": [key[0]],
            "card": [key[1]],
            "processed": [after[0] - before[0]],
            "failed": [after[1] - before[1]],
            "total": [0 if known else 1],
        }
    )


def card_deltas(events: DataFrame) -> DataFrame:
    """Stream of counter changes; their sum per job is :func:`progress`."""
    return events.groupBy("job_id", "card").applyInPandasWithState(
        _card_step, DELTA_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def card_status(events: DataFrame) -> DataFrame:
    """Stream of each card's last outcome, kept by a native aggregate (T1 without Python)."""
    ended = F.when(F.col("status") != "pending", F.struct("ts", "event_id"))
    return events.groupBy("job_id", "card").agg(F.max_by("status", ended).alias("status"), F.max(ended).alias("at"))


def progress_of_status(updates: DataFrame) -> DataFrame:
    """Counters per job from the written rows of :func:`card_status`."""
    last = updates.groupBy("job_id", "card").agg(F.max_by("status", "at").alias("status"))
    s = F.col("status")
    return last.groupBy("job_id").agg(
        F.count(F.when(s == "success", 1)).alias("processed"),
        F.count(F.when(s == "failed", 1)).alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )


def sum_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("job_id").agg(
        F.sum("processed").alias("processed"), F.sum("failed").alias("failed"), F.sum("total").alias("total")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain the available input into a table and return it."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def publish(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``sink`` on the changed rows of each trigger."""
    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )


def keep_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that keeps each trigger's rows under its number: a trigger run again replaces its own rows."""
    return lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def kept(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of :func:`keep_batches` with their trigger in ``epoch``."""
    return spark.read.schema(StructType([*schema.fields, StructField("epoch", LongType())])).parquet(path)


def announce(log: str, announced: str) -> Callable[[DataFrame, int], None]:
    """Sink over :func:`card_status` that writes each job once, in the trigger that completes it.

    Status rows go to ``log``, jobs to ``announced``. A trigger that runs again finds what earlier ones
    announced and writes its own jobs anew, so nothing fires twice and nothing is lost.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        spark, schema = batch.sparkSession, StructType(batch.schema.fields)
        keep_batches(log)(batch, epoch)
        totals = progress_of_status(kept(spark, log, schema).filter(F.col("epoch") <= epoch))
        jobs = StructType([StructField("job_id", batch.schema["job_id"].dataType)])
        spark.createDataFrame([], jobs).write.mode("overwrite").parquet(f"{announced}/epoch={epoch}")
        earlier = kept(spark, announced, jobs).filter(F.col("epoch") < epoch)
        keep_batches(announced)(completions(totals, earlier), epoch)

    return sink


def completions(totals: DataFrame, already: DataFrame) -> DataFrame:
    """Jobs complete now and not announced before: each fires once."""
    return completed_jobs(totals).join(already.select("job_id"), "job_id", "left_anti")


def streaming_totals(lines: DataFrame) -> DataFrame:
    """Continuously kept card totals (T9). ``lines(part_key, qty)`` is a stream."""
    return lines.groupBy("part_key").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("lines"))


def latest_totals(updates: DataFrame) -> DataFrame:
    """Current totals from the written update rows: the one counting most lines is the last."""
    return updates.groupBy("part_key").agg(F.max_by("qty", "lines").alias("qty"), F.max("lines").alias("lines"))


def bounded(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Events with a watermark, for sinks that drop late changes. Not part of the base rules."""
    return events.withWatermark("ts", delay)
