import datetime as dt
import os
import random

import pytest

from kittally.streaming import jobs_state as JS
from kittally.streaming import progress as S
from kittally.streaming import snapshot as SN

SCHEMA = "job_id long, card long, status string, ts timestamp, event_id long"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


def events(rows):
    return [(j, c, s, at(t), i) for i, (j, c, s, t) in enumerate(rows)]


FIRST = [(1, 1, "pending", 0), (1, 2, "pending", 0), (1, 1, "success", 1), (1, 1, "success", 2), (2, 1, "pending", 0)]
SECOND = [(1, 1, "failed", 3), (1, 2, "success", 3), (2, 1, "failed", 4), (1, 1, "pending", 5), (1, 2, "failed", 2)]


def counters(df):
    return {r.job_id: (r.processed, r.failed, r.total) for r in df.collect()}


def test_batch_counters(spark):
    first = spark.createDataFrame(events(FIRST), SCHEMA)
    assert counters(S.progress(first)) == {1: (1, 0, 2), 2: (0, 0, 1)}
    both = spark.createDataFrame(events(FIRST + SECOND), SCHEMA)
    # a later failure moves the unit, an earlier one and repeats change nothing
    assert counters(S.progress(both)) == {1: (1, 1, 2), 2: (0, 1, 1)}
    assert {r.job_id for r in S.completed_jobs(S.progress(both)).collect()} == {1, 2}
    assert {(r.job_id, r.card) for r in S.failed_cards(both).collect()} == {(1, 1), (2, 1)}


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    rows = events(FIRST + SECOND)
    seen = []
    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        deltas = S.run_to_table(S.card_deltas(stream), out, state)
        seen.append(counters(S.sum_deltas(deltas)))
    assert seen == [{1: (1, 0, 2), 2: (0, 0, 1)}, {1: (1, 1, 2), 2: (0, 1, 1)}]
    assert seen[1] == counters(S.progress(spark.createDataFrame(rows, SCHEMA)))
    done = S.completions(S.sum_deltas(deltas), spark.createDataFrame([(1,)], "job_id long"))
    assert [r.job_id for r in done.collect()] == [2]


def test_native_stream_equals_batch(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    rows = events(FIRST + SECOND)

    def keep(batch, epoch):
        batch.write.mode("append").parquet(out)

    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        S.publish(S.card_status(spark.readStream.schema(SCHEMA).parquet(source)), keep, state).awaitTermination()
    assert counters(S.progress_of_status(spark.read.parquet(out))) == {1: (1, 1, 2), 2: (0, 1, 1)}


def test_streaming_totals(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "part_key string, qty double"

    def keep(batch, epoch):
        batch.write.mode("append").parquet(out)

    for part in ([("P1", 1.0), ("P2", 2.0)], [("P1", 4.0)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        totals = S.streaming_totals(spark.readStream.schema(schema).parquet(source))
        S.publish(totals, keep, state).awaitTermination()
    got = {r.part_key: (r.qty, r.lines) for r in S.latest_totals(spark.read.parquet(out)).collect()}
    assert got == {"P1": (5.0, 2), "P2": (2.0, 1)}


def test_job_states(spark):
    jobs = spark.createDataFrame(
        [(1, "awaiting_upload", True, True, "start"), (2, "awaiting_upload", True, False, "start"), (3, "error", False, False, "start"),
         (4, "processing", True, True, "cancel"), (5, "done", True, True, "cancel"), (6, "processing", True, True, "start")],
        "job_id int, status string, bom_uploaded boolean, archive_uploaded boolean, action string",
    )
    got = {r.job_id: (r.new_status, r.new_stage, r.reset_counters) for r in S.valid_transitions(jobs).collect()}
    assert got == {1: ("processing", "unpacking", False), 3: ("processing", "unpacking", True), 4: ("error", "cancelled", False)}
    ended = spark.createDataFrame([(1, 0, True), (2, 3, True), (3, 0, False)], "job_id int, failed int, has_output boolean")
    stages = {r.job_id: (r.status, r.stage, r.error) for r in S.final_status(ended).collect()}
    assert stages[1] == ("done", "completed", None)
    assert stages[2] == ("error", "completed_with_errors", "Completed with 3 failed cards")
    assert stages[3][0:2] == ("error", "completed")
    old = spark.createDataFrame([(1, "done", at(0)), (2, "processing", at(0)), (3, "error", at(60 * 24))], "job_id int, status string, created_at timestamp")
    stale = S.stale_jobs(old, at(60 * 24 + 1))
    assert [r.job_id for r in stale.collect()] == [1]
    assert S.drop_jobs(old, stale).count() == 2
    assert S.progress_messages(spark.createDataFrame([(1, 1, 1, 3)], "job_id int, processed int, failed int, total int")).first().percent == 66.7


def test_a_job_is_announced_once_also_when_a_trigger_runs_again(spark, tmp_path):
    def status(rows):
        return spark.createDataFrame(rows, "job_id long, card long, status string, at struct<ts: timestamp, event_id: long>")

    mark = lambda n: (at(n), n)
    sink = S.announce(str(tmp_path / "log"), str(tmp_path / "announced"))
    triggers = [
        [(1, 1, "success", mark(1)), (1, 2, "pending", None), (2, 1, "failed", mark(2))],
        [(1, 2, "failed", mark(3)), (3, 1, "pending", None)],
        [(2, 1, "success", mark(4)), (3, 1, "success", mark(5))],
    ]
    for epoch, rows in enumerate(triggers):
        sink(status(rows), epoch)
        sink(status(rows), epoch)
    found = spark.read.schema("job_id long, epoch long").parquet(str(tmp_path / "announced"))
    assert sorted((r.epoch, r.job_id) for r in found.collect()) == [(0, 2), (1, 1), (2, 3)]
    log = S.kept(spark, str(tmp_path / "log"), status(triggers[0]).schema)
    assert {r.job_id: (r.processed, r.failed, r.total) for r in S.progress_of_status(log).collect()} == {1: (1, 1, 2), 2: (1, 0, 1), 3: (1, 0, 1)}


def test_failed_cards_keep_the_message_of_their_last_outcome(spark):
    rows = [(1, 1, "failed", 1, 1, "first"), (1, 1, "failed", 2, 2, "second"), (1, 2, "failed", 1, 3, "x"), (1, 2, "success", 2, 4, None)]
    events = spark.createDataFrame(rows, "job_id long, card long, status string, ts long, event_id long, why string")
    assert [tuple(r) for r in S.failed_cards(events, "why").collect()] == [(1, 1, "second")]


ENDS = "job_id long, status string, ts timestamp"


class Feed:
    """Files of card events and job ends, drained by one stream over restarts."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0

    def add(self, rows, ends=()):
        numbered = [(j, c, s, at(60 * hour), self.n + i) for i, (j, c, s, hour) in enumerate(rows)]
        self.n += len(rows)
        self.spark.createDataFrame(numbered, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/events")
        self.spark.createDataFrame([(j, s, at(60 * hour)) for j, s, hour in ends], ENDS).coalesce(1).write.mode("append").parquet(f"{self.path}/ends")
        return self.run()

    def run(self):
        events = self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/events")
        ends = self.spark.readStream.schema(ENDS).parquet(f"{self.path}/ends")
        query = JS.run_events(JS.completion_events(events, ends, shards=3), f"{self.path}/out", f"{self.path}/state")
        return JS.state_rows(query) if query.lastProgress else None

    def done(self):
        rows = self.spark.read.schema(JS.DONE).parquet(f"{self.path}/out").collect()
        return sorted((r.job_id, r.processed, r.failed, r.total) for r in rows)


def test_jobs_complete_once_and_expire(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([(1, 1, "pending", 0), (1, 2, "pending", 0), (1, 1, "success", 1), (2, 1, "pending", 0), (2, 1, "failed", 1)])
    assert feed.done() == [(2, 0, 1, 1)]
    full = feed.add([(1, 2, "failed", 2), (1, 1, "failed", 3), (2, 1, "success", 3)], [(1, "done", 4), (2, "error", 4)])
    assert feed.done() == [(1, 0, 2, 2), (2, 0, 1, 1)]  # a later change of a complete job fires nothing
    # a day after their end both are gone from the state; job 3 has one card and its counters
    left = feed.add([(3, 1, "pending", 40)])
    assert left < full and left <= 3
    # later than the watermark: neither counted nor brought back
    assert feed.add([(1, 1, "success", 2), (3, 1, "success", 41)]) <= 3
    assert feed.done() == [(1, 0, 2, 2), (2, 0, 1, 1), (3, 1, 0, 1)]


def test_a_job_that_starts_again_is_announced_anew(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([(1, 1, "pending", 0), (1, 1, "failed", 1)], [(1, "error", 2)])
    feed.add([(1, 1, "pending", 3), (1, 2, "pending", 3)])
    feed.add([(1, 1, "success", 4), (1, 2, "success", 4)])
    assert feed.done() == [(1, 0, 1, 1), (1, 2, 0, 2)]
    feed.add([(9, 1, "pending", 40)])
    assert feed.done() == [(1, 0, 1, 1), (1, 2, 0, 2)]


def test_a_replayed_trigger_fires_nothing_twice(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([(1, 1, "pending", 0), (1, 1, "success", 1), (2, 1, "pending", 0)])
    before = feed.done()
    commits = tmp_path / "state" / "commits"  # a crash after the rows of the last trigger, before its commit
    last = max(int(name) for name in os.listdir(commits) if name.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(commits / name)
    feed.run()
    assert feed.done() == before == [(1, 1, 0, 1)]
    feed.add([(2, 1, "failed", 2)])
    assert feed.done() == [(1, 1, 0, 1), (2, 0, 1, 1)]


def test_stream_of_completions_equals_batch(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(rnd.randint(1, 12), rnd.randint(1, 5), rnd.choice(["pending", "success", "failed"]), rnd.randint(0, 50)) for _ in range(300)]
    frame = spark.createDataFrame(events(rows), SCHEMA)
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = JS.completion_events(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    JS.run_events(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.job_id: (r.processed, r.failed, r.total) for r in spark.read.schema(JS.DONE).parquet(str(tmp_path / "out")).collect()}
    assert got == {j: c for j, c in counters(S.progress(frame)).items() if c[0] + c[1] == c[2]}


KEYED = "k long, v long, note string"


def test_snapshot_is_bounded_by_keys(spark, tmp_path):
    kept = SN.Snapshot(str(tmp_path / "s"), ["k"], spark.createDataFrame([], KEYED).schema, buckets=4, every=3)
    want, sizes = {}, []
    for epoch in range(13):
        rows = [(k, epoch, None if k % 3 else f"n{epoch}") for k in range(20) if (k + epoch) % 2]
        want.update({k: (v, n) for k, v, n in rows})
        kept.sink(spark.createDataFrame(rows, KEYED), epoch)
        sizes.append(kept.size(spark))
        if epoch in (1, 2, 7, 12):
            assert {r.k: (r.v, r.note) for r in kept.rows(spark).collect()} == want
    assert max(sizes) <= 2 * 20 + 6 * 10 and sizes[-1] <= max(sizes[:7])


def test_snapshot_after_a_crash(spark, tmp_path, monkeypatch):
    """A trigger that dies between its rows, its buckets and its commit gives the same when it runs again."""
    kept = SN.Snapshot(str(tmp_path / "s"), ["k"], spark.createDataFrame([], KEYED).schema, buckets=3, every=2)
    batch = lambda e: spark.createDataFrame([(k, 10 * e + k, f"e{e}") for k in range(e % 3, 9, 2)], KEYED)
    want = {}
    for epoch in range(8):
        want.update({r.k: (r.v, r.note) for r in batch(epoch).collect()})
        if epoch % 2:
            kept_clean, crashed = SN.Snapshot._clean, []

            def die(self, *args):
                crashed.append(1)
                raise RuntimeError("lost")

            monkeypatch.setattr(SN.Snapshot, "_clean", die)
            if kept.commits(spark):
                with pytest.raises(RuntimeError):
                    kept.sink(batch(epoch), epoch)
            monkeypatch.setattr(SN.Snapshot, "_clean", kept_clean)
        kept.sink(batch(epoch), epoch)
        kept.sink(batch(epoch), epoch)
        assert {r.k: (r.v, r.note) for r in kept.rows(spark).collect()} == want


def test_kept_leaves_a_schema_alone(spark, tmp_path):
    schema = spark.createDataFrame([], KEYED).schema
    S.keep_batches(str(tmp_path / "k"))(spark.createDataFrame([(1, 2, "x")], KEYED), 0)
    assert S.kept(spark, str(tmp_path / "k"), schema).count() == S.kept(spark, str(tmp_path / "k"), schema).count() == 1
    assert schema.names == ["k", "v", "note"]


class _Calls:
    """State of one key that counts what is asked of it."""

    def __init__(self):
        self.rows, self.value, self.asked = {}, None, 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return _Calls()

    def exists(self):
        return bool(self.rows) or self.value is not None

    def get(self):
        return self.value

    def getValue(self, card):
        self.asked += 1
        return self.rows.get(card)

    def containsKey(self, card):
        self.asked += 1
        return card in self.rows

    def updateValue(self, card, row):
        self.rows[card] = row

    def getCurrentWatermarkInMs(self):
        return 0


def test_new_jobs_ask_for_no_card():
    """the last outcome of a card is found among plain rows, and a job without state asks for none."""
    import pandas as pd

    at = pd.to_datetime([1, 3, 2, 3, 1], unit="s")
    status = ["pending", "failed", "success", "success", "pending"]
    rows = pd.DataFrame({"card": [1, 1, 1, 1, 2], "status": status, "ts": at, "event_id": [1, 9, 3, 4, 5]})
    state, cards = _Calls(), JS._Cards(1000)
    cards.init(state)
    first = pd.concat(cards.handleInputRows((7, 1), iter([rows[:3], rows[3:]]), state))
    assert first[["processed", "failed", "total"]].values.tolist() == [[0, 1, 2]] and state.asked == 0
    later = pd.DataFrame({"card": [1, 2], "status": ["success", "success"], "ts": at[1:2].append(at[:1]), "event_id": [9, 6]})
    second = pd.concat(cards.handleInputRows((7, 1), iter([later]), state))
    assert second[["processed", "failed", "total"]].values.tolist() == [[1, 0, 0]] and state.asked == 2
