"""Training jobs: state, completion, timelines and active sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions.losses import parse_loss
from runledger.functions.timing import elapsed_s, present
from runledger.operators.ordered import null_safe_join, number_rows, running_sums

JOB = ["run_id", "job_id"]
EVENT_ORDER = ["ts_us", "event_seq"]
FINISHED = (schemas.COMPLETED, schemas.FAILED)


def runnable_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(schemas.ACTIVE, schemas.PENDING))


def completed_steps(jobs: DataFrame) -> DataFrame:
    """Jobs that reached their step limit; a job without one never does."""
    return jobs.filter(F.col("max_steps").isNotNull() & (F.col("current_step") >= F.col("max_steps")))


# Joins on (run, job)

def _join_jobs(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (run, job).  Sorts compare the job first, which tells nearly all rows apart by its first
    characters; a run may be that of a third of all rows."""
    joined = left.join(right, ["job_id", "run_id"], how)
    return joined.select(*JOB, *[c for c in joined.columns if c not in JOB])


def expected_vs_actual_jobs(expected: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every expected job with its detail row, or status NOT_FOUND."""
    return _join_jobs(expected.select(*JOB), jobs, "left").withColumn(
        "status", F.coalesce("status", F.lit(schemas.NOT_FOUND)))


def prepared_runnable(jobs: DataFrame, prepared: DataFrame) -> DataFrame:
    return _join_jobs(runnable_jobs(jobs), prepared.select(*JOB), "left_semi")


def runnable_unprepared(jobs: DataFrame, prepared: DataFrame) -> DataFrame:
    return _join_jobs(runnable_jobs(jobs), prepared.select(*JOB), "left_anti")


def strategy_job_grid(expected: DataFrame, jobs: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """One row per (strategy, expected job id) with start and duration.

    ``jobs`` carries a ``strategy`` column.  A job that is absent, or lacks a start
    or a duration, gets (0, 0) and ``missing`` set.
    """
    grid = expected.select("job_id").distinct().withColumn(
        "strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))
    timed = jobs.select("strategy", "job_id", *_start_and_duration())
    placed = grid.join(timed, ["strategy", "job_id"], "left")
    missing = present(F.col("start_us")).isNull() | F.nullif(F.col("duration_s"), F.lit(0.0)).isNull()
    return placed.select(
        "strategy", "job_id",
        F.when(missing, F.lit(0).cast("bigint")).otherwise(F.col("start_us")).alias("start_us"),
        F.when(missing, F.lit(0.0)).otherwise(F.col("duration_s")).alias("duration_s"),
        missing.alias("missing"),
    )


def _start_and_duration() -> list[Column]:
    start, end = present(F.col("start_us")), present(F.col("end_us"))
    return [F.col("start_us"), elapsed_s(start, end).alias("duration_s")]


def earliest_start(jobs: DataFrame) -> Column:
    """First start over all runs of jobs that have a start and a duration, as a scalar."""
    _, duration = _start_and_duration()
    valid = jobs.select("start_us", duration).filter(
        present(F.col("start_us")).isNotNull() & F.nullif(F.col("duration_s"), F.lit(0.0)).isNotNull())
    return valid.agg(F.min("start_us")).scalar()


def relative_timeline(
    jobs: DataFrame, per_run: bool = False, expected: DataFrame | None = None,
) -> DataFrame:
    """Start and end of valid jobs in seconds since the earliest valid start.

    The origin is shared by all runs unless ``per_run``.  With ``expected`` other jobs
    are left out, of the origin too.
    """
    if expected is not None:
        jobs = _join_jobs(jobs, expected.select(*JOB), "left_semi")
    _, duration = _start_and_duration()
    timed = jobs.withColumn("duration_s", duration).filter(
        present(F.col("start_us")).isNotNull() & F.nullif(F.col("duration_s"), F.lit(0.0)).isNotNull())
    if per_run:
        origins = timed.groupBy("run_id").agg(F.min("start_us").alias("__origin"))
        timed = null_safe_join(timed, origins, ["run_id"])
        origin = F.col("__origin")
    else:
        origin = earliest_start(jobs)
    return timed.select(
        "run_id", "job_id", "reg_seq",
        elapsed_s(origin, F.col("start_us")).alias("start_s"),
        elapsed_s(origin, F.col("end_us")).alias("end_s"),
        "duration_s",
    )


def job_gantt(jobs: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Lane numbers (from 0) per run by relative start; ties by registration."""
    timeline = relative_timeline(jobs, expected=expected)
    numbered = number_rows(timeline, ["run_id"], ["start_s", "reg_seq"], "__no")
    return numbered.select(
        "run_id", (F.col("__no") - 1).alias("lane"), "job_id", "start_s", "end_s", "duration_s")


# Aggregates per run.  They read the rows of expected_vs_actual_jobs.

def status_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("expected_jobs"),
        F.count_if(F.col("status") == schemas.COMPLETED).alias("completed_jobs"),
        F.count_if(F.col("status") == schemas.FAILED).alias("failed_jobs"),
    ]


def makespan_seconds() -> Column:
    first, last = F.min(present(F.col("start_us"))), F.max(present(F.col("end_us")))
    return elapsed_s(first, last).alias("makespan_s")


def completion_times() -> list[Column]:
    duration = elapsed_s(present(F.col("start_us")), present(F.col("end_us")))
    return [F.avg(duration).alias("completion_avg_s"),
            F.stddev_pop(duration).alias("completion_stddev_s")]


def job_status_counts(outcome: DataFrame) -> DataFrame:
    return outcome.groupBy("run_id").agg(*status_counts())


def makespan(outcome: DataFrame) -> DataFrame:
    """Last end minus first start over the jobs seen; null unless both exist."""
    return outcome.groupBy("run_id").agg(makespan_seconds())


def completion_stats(outcome: DataFrame) -> DataFrame:
    """Mean and population standard deviation of durations; failed jobs count."""
    return outcome.groupBy("run_id").agg(*completion_times())


def run_finished(expected: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per run: have all expected jobs been seen and ended?"""
    return expected_vs_actual_jobs(expected, jobs).groupBy("run_id").agg(
        F.bool_and(F.col("status") != schemas.NOT_FOUND).alias("all_seen"),
        F.bool_and(F.col("status").isin(*FINISHED)).alias("finished"),
    )


# Event log to state

def registered_events(registrations: DataFrame, events: DataFrame) -> DataFrame:
    """Events of registered jobs after their registration, with reg_seq and start_us.

    ``registrations`` has one row per job (first_registration): run_id, job_id,
    reg_seq and start_us.  Events of unknown jobs, and events before registration
    (ts_us, event_seq) < (start_us, reg_seq), are left out.
    """
    known = registrations.select(*JOB, "reg_seq", "start_us")
    return null_safe_join(events, known, JOB, "inner").filter(
        F.struct("ts_us", "event_seq") > F.struct("start_us", "reg_seq"))


#: Columns of partial states, which may be merged in any order: {name: SQL type}.
STATE = {
    "steps": "bigint", "last_status": "struct<ts_us:bigint,event_seq:bigint,status:string>", "last_end": "bigint",
    "first_error": "bigint", "last_error": "struct<ts_us:bigint,event_seq:bigint,message:string>", "n_losses": "bigint",
}


#: Columns of an event that its state is made of.
STATE_INPUT = ["ts_us", "event_seq", "step_increment", "status", "error_message", "loss_raw"]


def event_state() -> list[Column]:
    """What one event adds to its job's state."""
    is_error = F.col("error_message").isNotNull()
    new_status = F.when(is_error, schemas.FAILED).otherwise(F.col("status"))
    at = [F.col("ts_us"), F.col("event_seq")]
    columns = {
        "steps": F.when(F.col("step_increment") > 0, F.col("step_increment")),
        "last_status": F.when(new_status.isNotNull(), F.struct(*at, new_status.alias("status"))),
        "last_end": F.when(F.col("status").isin(*FINISHED), F.col("ts_us")),
        "first_error": F.when(is_error, F.col("ts_us")),
        "last_error": F.when(is_error, F.struct(*at, F.col("error_message").alias("message"))),
        "n_losses": F.when(parse_loss(F.col("loss_raw")).isNotNull(), 1),
    }
    return [column.cast(STATE[name]).alias(name) for name, column in columns.items()]


def merged_state() -> list[Column]:
    """Aggregates that make one state of any number of partial ones."""
    how = {"steps": F.sum, "n_losses": F.sum, "first_error": F.min}
    return [how.get(name, F.max)(name).alias(name) for name in STATE]


def merge_states(states: DataFrame) -> DataFrame:
    """One state per job from any number of partial ones."""
    return states.groupBy(*JOB).agg(*merged_state())


def finished_states(registrations: DataFrame, states: DataFrame) -> DataFrame:
    """The job's row from its registration and its merged state, if it has one."""
    return state_rows(null_safe_join(registrations.select(*JOB, "reg_seq", "start_us"), states, JOB))


def state_rows(states: DataFrame) -> DataFrame:
    """The jobs' rows from merged states with reg_seq and start_us."""
    return states.select(
        *JOB, "reg_seq",
        F.coalesce("last_status.status", F.lit(schemas.ACTIVE)).alias("status"),
        "start_us",
        F.coalesce("last_end", "first_error").alias("end_us"),
        F.coalesce("steps", F.lit(0)).cast("bigint").alias("current_step"),
        F.coalesce("n_losses", F.lit(0)).cast("bigint").alias("n_losses"),
        F.col("last_error.message").alias("error_message"),
    )


def job_rollup(registrations: DataFrame, events: DataFrame) -> DataFrame:
    """Current state per registered job from its event log (registered_events)."""
    states = registered_events(registrations, events).select(*JOB, *event_state())
    return finished_states(registrations, merge_states(states))


def step_progress(events: DataFrame, jobs: DataFrame, registrations: DataFrame) -> DataFrame:
    """Cumulative step after each step event of a registered job, with its epoch (from 0).

    ``jobs`` gives max_steps, n_samples and batch_size.  ``is_completion`` marks the
    step that reaches max_steps, ``is_surplus`` the ones after it.
    """
    steps = registered_events(registrations, events.filter(F.col("step_increment") > 0)).select(
        *JOB, *EVENT_ORDER, "step_increment")
    counted = running_sums(steps, JOB, EVENT_ORDER, {"step": F.col("step_increment").cast("bigint")})
    limits = jobs.select(*JOB, "max_steps", "n_samples", "batch_size")
    joined = null_safe_join(counted, limits, JOB, "inner")
    before = F.col("step") - F.col("step_increment")
    per_epoch = F.ceil(F.col("n_samples") / F.col("batch_size"))
    limit = F.col("max_steps")
    over = (before >= limit) & (before > 0)
    return joined.select(
        *JOB, *EVENT_ORDER, "step",
        F.when(per_epoch > 0, F.floor((F.col("step") - 1) / per_epoch)).alias("epoch"),
        F.coalesce((F.col("step") >= limit) & ~over, F.lit(False)).alias("is_completion"),
        F.coalesce(over, F.lit(False)).alias("is_surplus"),
    )


def step_completion(events: DataFrame, jobs: DataFrame, registrations: DataFrame) -> DataFrame:
    """Time of the step that reaches max_steps, per job."""
    done = step_progress(events, jobs, registrations).filter("is_completion")
    return done.select(*JOB, F.col("ts_us").alias("completed_us"), F.col("step").alias("final_step"))


def loss_history(events: DataFrame, registrations: DataFrame, block: int = 1000) -> DataFrame:
    """All losses per registered job in event order, in arrays of at most ``block`` values.

    Block 0 holds the first ``block`` losses of the job, block 1 the next, and so
    on, so that a long history never has to fit one row.
    """
    parsed = events.select(*JOB, *EVENT_ORDER, parse_loss(F.col("loss_raw")).alias("loss")).filter(
        F.col("loss").isNotNull())
    losses = registered_events(registrations, parsed).select(*JOB, *EVENT_ORDER, "loss")
    numbered = number_rows(losses, JOB, EVENT_ORDER, "__no")
    blocks = numbered.withColumn("block", F.floor((F.col("__no") - 1) / block))
    ordered = F.array_sort(F.collect_list(F.struct("__no", "loss")))
    return blocks.groupBy(*JOB, "block").agg(
        F.transform(ordered, lambda item: item["loss"]).alias("losses"),
        F.max_by("loss", "__no").alias("last_loss"),
        F.max("__no").alias("losses_so_far"),
    )


# Sets

def active_set_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Jobs that joined or left the active set between two snapshots."""
    old = before.select(*JOB).distinct().withColumn("was", F.lit(True))
    new = after.select(*JOB).distinct().withColumn("now", F.lit(True))
    both = old.join(new, JOB, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed")
    return both.select(*JOB, change.alias("change")).filter(F.col("change").isNotNull())


def active_set_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per run of either snapshot: did its active set change?"""
    runs = before.select("run_id").union(after.select("run_id")).distinct()
    counts = active_set_changes(before, after).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.join(counts, "run_id", "left").select("run_id", F.col("n").isNotNull().alias("changed"))


def pending_jobs(expected: DataFrame, jobs: DataFrame) -> DataFrame:
    """Expected jobs that have not ended."""
    ended = jobs.filter(F.col("status").isin(*FINISHED)).select(*JOB)
    return _join_jobs(expected.select(*JOB), ended, "left_anti")
