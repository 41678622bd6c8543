"""Streams over several files equal the batch operators at the end of the input."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from runledger import schemas
from runledger.operators import jobs, progress, requests
from runledger.streaming import ingest, job_state, outcomes
from runledger.streaming import progress as stream


def write_files(folder, schema, data, parts):
    """JSON-lines files in event order."""
    folder.mkdir()
    names = [c.split()[0] for c in schema.split(", ")]
    size = -(-len(data) // parts)
    for i in range(parts):
        lines = [json.dumps(dict(zip(names, r))) for r in data[i * size:(i + 1) * size]]
        file = folder / f"part{i}.json"
        file.write_text("\n".join(lines))
        os.utime(file, (1_700_000_000 + i,) * 2)  # streams take files by their time


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def finish(query, tmp_path):
    assert query.awaitTermination(180)
    assert query.lastProgress is None or query.exception() is None
    return str(tmp_path / "out")


@pytest.fixture
def log():
    rng = random.Random(8)
    out = []
    for i in range(240):
        kind = rng.choices(["JOB_ADDED", "STEP_COMPLETED", "METRICS_REPORTED", "STATUS_UPDATE", "JOB_FAILED"],
                           [2, 8, 5, 1, 1])[0]
        status = {"STATUS_UPDATE": "COMPLETED", "JOB_FAILED": rng.choice(["FAILED", None])}.get(kind)
        loss = rng.choice(["bad", "NaN", *(f"{rng.random():.3f}" for _ in range(5))])
        out.append(("r", rng.choice(["hot", "hot", "a", "b"]), i, kind, i * 10,
                    1 if kind == "STEP_COMPLETED" else 0,
                    loss if kind in progress.LOSS_EVENTS else None, status,
                    f"e{i}" if kind == "JOB_FAILED" else None))
    return out


def test_progress_equals_batch(spark, tmp_path, log):
    write_files(tmp_path / "in", schemas.JOB_EVENTS, log, 3)
    query = stream.stream_progress(stream_of(spark, tmp_path / "in", schemas.JOB_EVENTS), str(tmp_path / "out"),
                                   str(tmp_path / "checkpoint"), history_window=4)
    got = spark.read.parquet(finish(query, tmp_path) + "/rows")
    batch = spark.createDataFrame(log, schemas.JOB_EVENTS)
    columns = ["job_id", "event_seq", "history_size", "rate"]
    assert repr(rows(got.select(columns))) == repr(rows(progress.rolling_progress(batch, 4).select(columns)))
    newest = got.groupBy("job_id").agg(F.max_by("rate", "event_seq").alias("rate"))
    current = progress.progress_rate(batch, 4).select("job_id", F.col("rate"))
    final = {r["job_id"]: r["rate"] for r in newest.collect()}
    assert all(repr(final[r["job_id"]]) == repr(r["rate"]) for r in current.collect())
    assert any(math.isnan(r["rate"]) for r in got.collect() if r["rate"] is not None)
    assert sorted(p.name for p in (tmp_path / "out" / "state" / "manifest").iterdir() if p.name[0] == "e") == ["epoch=1", "epoch=2"]
    assert not list((tmp_path / "out" / "sorted").iterdir())


def event(i, job, kind="STEP_COMPLETED", ts=None, **more):
    return ("r", job, i, kind, i if ts is None else ts, 1 if kind == "STEP_COMPLETED" else 0,
            str(i), more.get("status"), more.get("error"))


class Triggers:
    """Runs a stream over one file after the other, from its checkpoint."""

    def __init__(self, spark, tmp_path, start):
        self.spark, self.path, self.start, self.files = spark, tmp_path, start, 0
        (tmp_path / "in").mkdir()

    def feed(self, events):
        names = [c.split()[0] for c in schemas.JOB_EVENTS.split(", ")]
        self.files += 1
        lines = [json.dumps(dict(zip(names, e))) for e in events]
        (self.path / "in" / f"part{self.files}.json").write_text("\n".join(lines))
        self.run()

    def run(self):
        query = self.start(stream_of(self.spark, self.path / "in", schemas.JOB_EVENTS), str(self.path / "out"),
                           str(self.path / "checkpoint"))
        assert query.awaitTermination(180)

    def rows(self, epoch):
        return self.spark.read.parquet(str(self.path / "out" / "rows" / f"epoch={epoch}"))

    def repeat(self):
        """Run the last trigger again, as after a failure: its commit is lost."""
        commits = sorted((self.path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        commits[-1].unlink()
        (self.path / "checkpoint" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
        self.run()


def test_silent_jobs_lose_their_state_by_event_time(spark, tmp_path):
    feed = Triggers(spark, tmp_path, lambda events, out, checkpoint: stream.stream_progress(
        events, out, checkpoint, idle_us=100, buckets=4))
    feed.feed([event(1, "a"), event(2, "a"), event(3, "b")])
    feed.feed([event(4, "b", ts=90), event(5, "a", ts=92)])
    feed.feed([event(6, "b", ts=193)])  # a and b were last seen 92 and 90 before it
    feed.feed([event(7, "a", ts=194), event(8, "b", ts=195)])  # a is dead: 92 < 193 - 100
    sizes = {r["event_seq"]: r["history_size"] for e in range(4) for r in feed.rows(e).collect()}
    assert sizes == {1: 1, 2: 2, 3: 1, 4: 2, 5: 3, 6: 3, 7: 1, 8: 4}
    before = rows(feed.rows(3))
    feed.repeat()  # decides by the events, whenever it runs
    assert rows(feed.rows(3)) == before


def test_dead_jobs_leave_the_state(spark, tmp_path):
    feed = Triggers(spark, tmp_path, lambda events, out, checkpoint: job_state.stream_job_state(
        events, out, checkpoint, idle_us=1000, buckets=8))
    feed.feed([event(i, f"j{i}", "JOB_ADDED") for i in range(40)] + [event(50, "j1")])
    feed.feed([event(51, "j1", ts=5000)])
    for i in range(10):
        feed.feed([event(60 + i, "j1", ts=5001 + i)])
    state = tmp_path / "out" / "state"
    manifest = json.loads((state / "manifest" / "epoch=11").read_text())
    assert len(manifest["buckets"]) == 1 and manifest["seen_us"] == 5010
    (bucket, entry), = manifest["buckets"].items()
    alive = spark.read.parquet(str(state / f"epoch={entry['epoch']}" / f"bucket={bucket}"))
    # j1 went as well when it came back after so long: its later events wait for a registration
    assert rows(alive.select("job_id")) in ([], [("j1",)])


def test_a_trigger_writes_what_it_touches(spark, tmp_path):
    feed = Triggers(spark, tmp_path, lambda events, out, checkpoint: job_state.stream_job_state(
        events, out, checkpoint, buckets=16))
    feed.feed([event(i, f"j{i}", "JOB_ADDED") for i in range(300)])
    feed.feed([event(400, "j7")])
    feed.feed([event(401, "j7"), event(402, "j8", status="COMPLETED")])
    state = tmp_path / "out" / "state"
    assert len(list((state / "epoch=0").glob("bucket=*"))) in (14, 15, 16)
    assert [len(list((state / f"epoch={e}").glob("bucket=*"))) for e in (1, 2)] == [1, 2] or len(
        list((state / "epoch=2").glob("bucket=*"))) == 1
    written = sum(f.stat().st_size for f in (state / "epoch=2").rglob("*.parquet"))
    whole = sum(f.stat().st_size for f in (state / "epoch=0").rglob("*.parquet"))
    assert written < whole / 3
    got = {r["job_id"]: (r["status"], r["current_step"]) for r in job_state.latest_state(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 300 and got["j7"] == ("ACTIVE", 2) and got["j8"] == ("COMPLETED", 1) and got["j9"] == ("ACTIVE", 0)
    before = rows(feed.rows(2))
    feed.repeat()
    assert rows(feed.rows(2)) == before and len(before) == 2


def test_events_wait_for_their_registration(spark, tmp_path):
    feed = Triggers(spark, tmp_path, lambda events, out, checkpoint: job_state.stream_job_state(
        events, out, checkpoint, wait_us=1000, buckets=4))
    log = [
        [event(5, "late", ts=50), event(6, "late", ts=60), event(1, "a", "JOB_ADDED"), event(7, "lost", ts=70), event(2, "never")],
        [event(3, "late", "JOB_ADDED", ts=55), event(8, "a", ts=80), event(9, "late", "JOB_FAILED", ts=90, error="e")],
        [event(20, "a", ts=3000)],
        [event(21, "lost", "JOB_ADDED", ts=60), event(22, "late", ts=3001), event(23, "a", "JOB_ADDED", ts=3002)],
    ]
    for events in log:
        feed.feed(events)
    batch = spark.createDataFrame([e for events in log for e in events if e[2] != 7], schemas.JOB_EVENTS)
    registered = batch.filter("event_type = 'JOB_ADDED' AND event_seq <> 23").select(
        "run_id", "job_id", F.col("event_seq").alias("reg_seq"), F.col("ts_us").alias("start_us"))
    columns = ["job_id", "reg_seq", "status", "start_us", "end_us", "current_step", "error_message"]
    got = job_state.latest_state(spark, str(tmp_path / "out"))
    assert rows(got.select(columns)) == rows(jobs.job_rollup(registered, batch).select(columns))
    assert {r["job_id"]: r["current_step"] for r in got.collect()} == {"a": 2, "late": 2, "lost": 0}


def test_job_state_equals_rollup(spark, tmp_path, log):
    write_files(tmp_path / "in", schemas.JOB_EVENTS, log, 3)
    query = job_state.stream_job_state(stream_of(spark, tmp_path / "in", schemas.JOB_EVENTS), str(tmp_path / "out"),
                                       str(tmp_path / "checkpoint"))
    got = job_state.latest_state(spark, finish(query, tmp_path))
    batch = spark.createDataFrame(log, schemas.JOB_EVENTS)
    registered = batch.filter("event_type = 'JOB_ADDED'").groupBy("run_id", "job_id").agg(
        F.min("event_seq").alias("reg_seq"), F.min("ts_us").alias("start_us"))
    columns = ["job_id", "reg_seq", "status", "start_us", "end_us", "current_step", "error_message"]
    assert rows(got.select(columns)) == rows(jobs.job_rollup(registered, batch).select(columns))


def test_outcomes_equal_batch(spark, tmp_path):
    data = [(f"r{i % 3}" if i % 7 else None, str(i), i, i, i + 1, None if i % 4 == 0 else "x", "boom" if i % 4 == 0 else None)
            for i in range(60)]
    write_files(tmp_path / "in", schemas.RESULTS, data, 4)
    query = outcomes.stream_outcomes(stream_of(spark, tmp_path / "in", schemas.RESULTS), str(tmp_path / "out"),
                                     str(tmp_path / "checkpoint"), buckets=4)
    assert query.awaitTermination(120)
    batch = spark.createDataFrame(data, schemas.RESULTS)
    assert rows(outcomes.latest_outcomes(spark, str(tmp_path / "out"))) == rows(requests.request_outcomes(batch))


def test_events_without_an_id_are_streamed(spark, tmp_path):
    from runledger.plans import derived
    from runledger.plans.bindings import Tables

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    odd = events.limit(30).withColumn("event_id", F.when(F.col("event_id") % 2 == 0, F.lit(None).cast("bigint")).otherwise(-5))
    odd.unionByName(events).write.parquet(str(tmp_path / "events.parquet"))
    t = Tables(spark, str(tmp_path))
    assert derived.streamed_submissions(t).count() == events.count() + 30
    assert derived.streamed_outcomes(t).agg(F.sum("total")).first()[0] == events.count() + 30


def test_ingest_resumes_and_keeps_rejects(spark, tmp_path):
    def submission(i):
        kind = ["TRAIN_JOB", "INFERENCE_REQ", "WHAT"][i % 3]
        job = None if i == 3 else f"job{i}"
        return ("r", i, kind, i, job, None, [] if i == 6 else ["s"], None, None, None, None)

    data = [submission(i) for i in range(12)]
    write_files(tmp_path / "in", schemas.SUBMISSIONS, data[:8], 4)

    def intake():
        frame = ingest.read_submissions(spark, str(tmp_path / "in"), files_per_trigger=2)
        query = ingest.stream_ingest(frame, str(tmp_path / "out"), str(tmp_path / "state"))
        assert query.awaitTermination(120)

    intake()
    names = [c.split()[0] for c in schemas.SUBMISSIONS.split(", ")]
    (tmp_path / "in" / "late.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in data[8:]))
    intake()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert rows(out.groupBy("sink").agg(F.count(F.lit(1)))) == [
        ("accepted", 3), ("rejected", 1), ("request", 4), ("unknown", 4)]
    assert rows(out.filter("status = 'FAILED'").select("seq")) == [(6,)]
    assert rows(out.filter("reject_reason IS NOT NULL").select("seq")) == [(3,)]
