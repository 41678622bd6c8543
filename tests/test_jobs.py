import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from runledger import schemas
from runledger.operators import comparison, jobs, submissions

JOBS = schemas.JOBS
EVENTS = schemas.JOB_EVENTS
SUBS = ("run_id string, seq bigint, event_type string, submitted_us bigint, job_id string, "
        "dataset_samples array<string>, batch_size int, lr double, adapter_save_path string")


def job(job_id, status="ACTIVE", start=1, end=None, step=0, limit=None, run="r", seq=0):
    return (run, job_id, seq, status, start, end, step, limit, None)


def test_status_filters_and_limits(spark):
    df = spark.createDataFrame([
        job("a", "ACTIVE", step=5, limit=5), job("b", "PENDING", step=9), job("c", "FAILED", step=4, limit=5),
        job("d", "COMPLETED", step=0, limit=0)], JOBS)
    assert rows(jobs.runnable_jobs(df).select("job_id")) == [("a",), ("b",)]
    assert rows(jobs.completed_steps(df).select("job_id")) == [("a",), ("d",)]
    ready = spark.createDataFrame([("r", "b"), ("r", "c")], "run_id string, job_id string")
    assert rows(jobs.prepared_runnable(df, ready).select("job_id")) == [("b",)]
    assert rows(jobs.runnable_unprepared(df, ready).select("job_id")) == [("a",)]


def test_report_figures_with_missing_and_zero_times(spark):
    second = 1_000_000
    seen = spark.createDataFrame([
        job("a", "COMPLETED", 10 * second, 14 * second), job("b", "FAILED", 11 * second, 13 * second),
        job("c", "ACTIVE", 5 * second), job("z", "COMPLETED", 0, 99 * second),
        job("p", "ACTIVE", 3 * second, run="unfinished")], JOBS)
    expected = spark.createDataFrame(
        [("r", j) for j in "abcxz"] + [("unfinished", "p")], "run_id string, job_id string")
    outcome = jobs.expected_vs_actual_jobs(expected, seen)
    assert rows(outcome.filter("status = 'NOT_FOUND'").select("job_id")) == [("x",)]
    assert rows(jobs.job_status_counts(outcome)) == [("r", 5, 2, 1), ("unfinished", 1, 0, 0)]
    assert rows(jobs.makespan(outcome)) == [("r", 94.0), ("unfinished", None)]
    assert rows(jobs.completion_stats(outcome)) == [("r", 3.0, 1.0), ("unfinished", None, None)]
    assert rows(jobs.run_finished(expected, seen)) == [("r", False, False), ("unfinished", True, False)]
    assert rows(jobs.pending_jobs(expected, seen).select("job_id")) == [("c",), ("p",), ("x",)]


def test_grid_timeline_and_durations(spark):
    second = 1_000_000
    df = spark.createDataFrame([
        job("t_a", "COMPLETED", 10 * second, 14 * second, run="x"),
        job("t_b", "ACTIVE", 2 * second, run="x", seq=1),
        job("t_a", "COMPLETED", 12 * second, 15 * second, run="y"),
        job("t_b", "COMPLETED", 20 * second, 20 * second, run="y")], JOBS).withColumn("strategy", F.col("run_id"))
    expected = df.select("run_id", "job_id")
    grid = jobs.strategy_job_grid(expected, df, ["x", "y", "w"])
    assert rows(grid) == sorted([
        ("x", "t_a", 10 * second, 4.0, False), ("x", "t_b", 0, 0.0, True), ("y", "t_a", 12 * second, 3.0, False),
        ("y", "t_b", 0, 0.0, True), ("w", "t_a", 0, 0.0, True), ("w", "t_b", 0, 0.0, True)], key=repr)
    timeline = jobs.relative_timeline(df).select("run_id", "start_s", "end_s")
    assert rows(timeline) == [("x", 0.0, 4.0), ("y", 2.0, 5.0)]
    assert rows(jobs.relative_timeline(df, per_run=True).select("run_id", "start_s")) == [("x", 0.0), ("y", 0.0)]
    wide = comparison.job_durations(expected, df, ["x", "y"], "t_")
    assert rows(wide) == [("a", 4.0, 3.0), ("b", 0.0, 0.0)]


def test_strategy_comparison_fills_zero(spark):
    summary = spark.createDataFrame(
        [("x", 1.5, None, 2.0, 3.0)],
        "strategy string, makespan_s double, completion_avg_s double, e2e_avg_ms double, throughput double")
    out = comparison.strategy_comparison(summary, ["x", "y"])
    assert rows(out) == [("Avg Inf Latency (ms)", 2.0, 0.0), ("Avg Job Comp (s)", 0.0, 0.0),
                         ("Inf Throughput (req/s)", 3.0, 0.0), ("Makespan (s)", 1.5, 0.0)]


REGISTERED = "run_id string, job_id string, reg_seq bigint, start_us bigint"


def random_log(seed, n=300):
    rng = random.Random(seed)
    log = []
    for i in range(n):
        kind = rng.choices(["JOB_ADDED", "STEP_COMPLETED", "STATUS_UPDATE", "JOB_FAILED"], [2, 6, 1, 1])[0]
        status = {"STATUS_UPDATE": rng.choice(["COMPLETED", "ACTIVE"]),
                  "JOB_FAILED": rng.choice(["FAILED", None])}.get(kind)
        log.append(("r", rng.choice(["hot", "hot", "a", "b", "c", f"solo{i}"]), i, kind, rng.randrange(n),
                    1 if kind == "STEP_COMPLETED" else 0, "0.5" if kind == "STEP_COMPLETED" else None,
                    status, f"e{i}" if kind == "JOB_FAILED" else None))
    return log


@pytest.mark.parametrize("limit", [20, 10_000])
def test_rollup_equals_event_by_event(spark, small_groups, limit):
    small_groups(limit)
    log = random_log(11)
    events = spark.createDataFrame(log, EVENTS)
    added = events.filter("event_type = 'JOB_ADDED'").groupBy("run_id", "job_id").agg(
        F.min(F.struct("ts_us", "event_seq")).alias("at"))
    registrations = added.select("run_id", "job_id", F.col("at.event_seq").alias("reg_seq"),
                                 F.col("at.ts_us").alias("start_us"))
    names = [f.name for f in events.schema.fields]
    Row = __import__("collections").namedtuple("Row", names)
    states = {}
    for job in {r[1] for r in log}:
        own = sorted((Row(*r) for r in log if r[1] == job), key=lambda e: (e.ts_us, e.event_seq))
        begin = next((i for i, e in enumerate(own) if e.event_type == "JOB_ADDED"), None)
        if begin is None:
            continue
        later = own[begin + 1:]
        said = ["FAILED" if e.error_message else e.status for e in later if e.error_message or e.status]
        ends = [e.ts_us for e in later if e.status in ("COMPLETED", "FAILED")] or [e.ts_us for e in later if e.error_message][:1]
        states[job] = {
            "reg_seq": own[begin].event_seq, "status": (["ACTIVE"] + said)[-1], "start_us": own[begin].ts_us,
            "end_us": ([None] + ends)[-1], "current_step": sum(e.step_increment for e in later),
            "error_message": ([None] + [e.error_message for e in later if e.error_message])[-1]}
    got = jobs.job_rollup(registrations, events).select(
        "job_id", "reg_seq", "status", "start_us", "end_us", "current_step", "error_message")
    assert rows(got) == sorted(((j, *s.values()) for j, s in states.items()), key=repr)


@pytest.mark.parametrize("limit", [4, 10_000])
def test_step_progress(spark, small_groups, limit):
    small_groups(limit)
    events = spark.createDataFrame(
        [("r", j, i, "STEP_COMPLETED", i, 1, None, None, None)
         for j, n in (("a", 7), ("b", 2), ("zero", 2), ("free", 3)) for i in range(n)], EVENTS)
    limits = spark.createDataFrame(
        [("r", "a", 5, 5, 2), ("r", "b", 5, 4, 2), ("r", "zero", 0, 4, 2), ("r", "free", None, 0, 1)],
        "run_id string, job_id string, max_steps int, n_samples int, batch_size int")
    known = spark.createDataFrame([("r", j, -1, -1) for j in ("a", "b", "zero", "free")], REGISTERED)
    out = jobs.step_progress(events, limits, known).select("job_id", "step", "epoch", "is_completion", "is_surplus")
    assert rows(out) == sorted([
        *[("a", s, (s - 1) // 3, s == 5, s > 5) for s in range(1, 8)],
        ("b", 1, 0, False, False), ("b", 2, 0, False, False),
        ("zero", 1, 0, True, False), ("zero", 2, 0, False, True),
        *[("free", s, None, False, False) for s in (1, 2, 3)]], key=repr)
    assert rows(jobs.step_completion(events, limits, known).select("job_id", "completed_us", "final_step")) == [
        ("a", 4, 5), ("zero", 0, 1)]


@pytest.mark.parametrize("limit", [4, 10_000])
def test_loss_history_is_whole(spark, small_groups, limit):
    small_groups(limit)
    events = spark.createDataFrame(
        [("r", "a", i, "STEP_COMPLETED", 100 - i, 1, str(i / 10), None, None) for i in range(25)]
        + [("r", "b", 0, "STEP_COMPLETED", 0, 1, "bad", None, None)], EVENTS)
    known = spark.createDataFrame([("r", "a", -1, -1), ("r", "b", -1, -1)], REGISTERED)
    out = jobs.loss_history(events, known, block=10).orderBy("block").collect()
    assert [r["block"] for r in out] == [0, 1, 2]
    assert [x for r in out for x in r["losses"]] == [i / 10 for i in reversed(range(25))]
    assert out[-1]["last_loss"] == 0.0 and out[-1]["losses_so_far"] == 25


def test_steps_and_losses_follow_the_registration_rule(spark):
    log = [r for r in random_log(5) if r[1] != "c"] + [("r", "c", 900, "STEP_COMPLETED", 1, 1, "0.1", None, None)]
    events = spark.createDataFrame(log, EVENTS)
    known = events.filter("event_type = 'JOB_ADDED' AND job_id <> 'c'").groupBy("run_id", "job_id").agg(
        F.min(F.struct("ts_us", "event_seq")).alias("at")).select(
        "run_id", "job_id", F.col("at.event_seq").alias("reg_seq"), F.col("at.ts_us").alias("start_us"))
    state = jobs.job_rollup(known, events)
    limits = events.select("run_id", "job_id", F.lit(5).alias("max_steps"), F.lit(3).alias("n_samples"),
                           F.lit(1).alias("batch_size")).distinct()
    steps = jobs.step_progress(events, limits, known).groupBy("job_id").agg(F.max("step"))
    assert rows(steps) == rows(state.filter("current_step > 0").select("job_id", "current_step"))
    losses = jobs.loss_history(events, known).groupBy("job_id").agg(F.max("losses_so_far"))
    assert rows(losses) == rows(state.filter("n_losses > 0").select("job_id", "n_losses"))


def test_null_run_obeys_the_quota_and_has_steps(spark):
    data = [(run, i, i % 4, 0) for run in ("a", None) for i in range(10)]
    df = spark.createDataFrame(data, "run_id string, seq int, submitted_us int, hour int")
    out = submissions.admission_cap(df, "hour", 3).filter("admission = 'accepted'")
    assert rows(out.groupBy("run_id").count()) == [("a", 3), (None, 3)]


def test_active_set_changes(spark):
    old = spark.createDataFrame([("r", "a"), ("r", "b"), ("same", "q")], "run_id string, job_id string")
    new = spark.createDataFrame([("r", "b"), ("r", "c"), ("same", "q")], "run_id string, job_id string")
    assert rows(jobs.active_set_changes(old, new)) == [("r", "a", "removed"), ("r", "c", "added")]
    assert rows(jobs.active_set_changed(old, new)) == [("r", True), ("same", False)]


def sub(seq, job_id, samples=("x",), kind="TRAIN_JOB", size=None, path=None):
    return ("r", seq, kind, seq * 10, job_id, list(samples) if samples is not None else None, size, None, path)


def test_submissions(spark):
    df = spark.createDataFrame([
        sub(1, "a"), sub(2, None), sub(3, ""), sub(4, "b", ()), sub(5, "c", None), sub(6, "a", ("y", "z"), size=9),
        sub(7, None, kind="INFERENCE_REQ"), sub(8, "q", kind="OTHER"), sub(9, "d", path="")], SUBS)
    routed = submissions.split_submissions(df)
    assert [d.count() for d in routed] == [7, 1, 1]
    accepted, rejected = submissions.validate_submissions(routed.jobs)
    assert rows(rejected.select("seq", "reject_reason")) == [(2, "job_id missing"), (3, "job_id missing")]
    assert rows(accepted.filter("status = 'FAILED'").select("job_id", "error_message")) == [
        ("b", "Missing or invalid dataset_samples"), ("c", "Missing or invalid dataset_samples")]
    first = submissions.first_registration(accepted)
    assert rows(first.select("job_id", "seq", "batch_size", "duplicates")) == [
        ("a", 1, None, 1), ("b", 4, None, 0), ("c", 5, None, 0), ("d", 9, None, 0)]
    filled = submissions.fill_job_defaults(first)
    assert rows(filled.select("job_id", "adapter_save_path", "batch_size", "lr"))[-1] == (
        "d", "./adapters/job_d", 1, 5e-5)
    assert rows(submissions.explode_job_samples(accepted).select("seq", "sample_idx", "text"))[-2:] == [
        (6, 1, "z"), (9, 0, "x")]


@pytest.mark.parametrize("rows_limit", [5, 10_000])
@pytest.mark.parametrize("cap", [0, 1, 3, 1001])
def test_admission_cap(spark, small_groups, rows_limit, cap):
    small_groups(rows_limit)
    rng = random.Random(1)
    data = [("r", i, rng.randrange(5), rng.choice([0, 0, 0, 1, 2])) for i in range(60)]
    df = spark.createDataFrame(data, "run_id string, seq int, submitted_us int, hour int")
    want = []
    for hour in (0, 1, 2):
        inside = sorted((r[2], r[1]) for r in data if r[3] == hour)
        want += [(seq, "accepted" if cap == 0 or i < cap else "rejected") for i, (_, seq) in enumerate(inside)]
    out = submissions.admission_cap(df, "hour", cap)
    assert rows(out.select("seq", "admission")) == sorted(want, key=repr)


def test_sorts_compare_the_job_before_the_run(spark):
    seen = spark.createDataFrame([job("a", "COMPLETED", 1, 2), job("b")], JOBS)
    expected = seen.select("run_id", "job_id")
    joins = [jobs.expected_vs_actual_jobs(expected, seen), jobs.prepared_runnable(seen, expected),
             jobs.runnable_unprepared(seen, expected), jobs.pending_jobs(expected, seen)]
    for df in joins:
        assert df.columns[:2] == ["run_id", "job_id"]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join [job_id#" in plan and "Join [run_id#" not in plan
