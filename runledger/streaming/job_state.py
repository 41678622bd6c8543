"""State of running jobs from a stream of job events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger import schemas
from runledger.operators.jobs import JOB, STATE, STATE_INPUT, event_state, merged_state, state_rows
from runledger.operators.ordered import null_safe_join
from runledger.streaming.tables import BUCKETS, BucketState, each_trigger, latest, write_epoch

REGISTERED = "JOB_ADDED"
DAY_US = 86_400_000_000

_REGISTRATION = "struct<late:boolean,reg_seq:bigint,start_us:bigint>"
_STATE = ("run_id string, job_id string, registration " + _REGISTRATION + ", "
          + ", ".join(f"{c} {t}" for c, t in STATE.items()) + ", seen_us bigint, changed int")
_WAITING = schemas.JOB_EVENTS + ", seen_us bigint"


def stream_job_state(
    events: DataFrame, path: str, checkpoint: str, idle_us: int | None = None, wait_us: int = DAY_US,
    buckets: int = BUCKETS, **trigger,
) -> StreamingQuery:
    """Write the jobs that each trigger changes to ``path``/rows, with their state after it.

    A job begins with its first registration event; repeated registrations, and events before
    it, are ignored.  A trigger aggregates its own events into partial states, as job_rollup
    does, and merges them with those of ``path``/state, kept by hash bucket of the job
    (BucketState).

    Events whose job is not registered yet wait in ``path``/waiting for ``wait_us`` of event time
    and count when the registration comes in a later trigger.  ``idle_us`` drops the state
    of jobs whose last event lies so long before the latest one; later events of theirs wait as
    those of an unknown job.  ``trigger``: as for DataStreamWriter.trigger.
    """
    spark = events.sparkSession
    state = BucketState(spark, f"{path}/state", _STATE, JOB, buckets, idle_us)
    waiting = BucketState(spark, f"{path}/waiting", _WAITING, JOB, buckets, wait_us)

    def save(batch: DataFrame, epoch: int) -> None:
        fresh = batch.select(*[c.split()[0] for c in schemas.JOB_EVENTS.split(", ")]).withColumn("seen_us", F.col("ts_us"))
        touched = state.touched(fresh)
        kept, loaded = state.load(epoch, touched)
        waited, waiting_loaded = waiting.load(epoch, touched)
        events = waited.unionByName(fresh)
        # a registration that is kept comes before new ones
        added = fresh.filter(F.col("event_type") == REGISTERED).select(*JOB, F.struct(
            F.lit(True).alias("late"), F.col("event_seq").alias("reg_seq"), F.col("ts_us").alias("start_us")
        ).alias("registration"), "seen_us")
        known = kept.select(*JOB, "registration").unionByName(added.drop("seen_us")).groupBy(*JOB).agg(
            F.min("registration").alias("registration"))
        located = null_safe_join(events, known, JOB)
        counts = F.struct("ts_us", "event_seq") > F.struct("registration.start_us", "registration.reg_seq")
        partial = located.filter(F.col("registration").isNotNull()).select(
            *JOB, *[F.when(counts, F.col(c)).alias(c) for c in STATE_INPUT], counts.alias("counts"), "seen_us"
        ).select(*JOB, *event_state(), "seen_us", F.when(F.col("counts"), epoch).alias("changed"))
        joined = kept.unionByName(partial, allowMissingColumns=True).unionByName(
            added.withColumn("changed", F.lit(None).cast("int")), allowMissingColumns=True)
        new = F.min("registration")["late"]
        merged = joined.groupBy(*JOB).agg(
            F.min("registration").alias("registration"), *merged_state(), F.max("seen_us").alias("seen_us"),
            F.max(F.coalesce("changed", F.lit(-1))).alias("changed"), new.alias("new"))
        settled = merged.withColumns({
            "changed": F.when(F.col("new"), epoch).otherwise(F.col("changed")),
            "registration": F.struct(F.lit(False).alias("late"), "registration.reg_seq", "registration.start_us")}).drop("new")
        now = state.save(settled, epoch, loaded, touched)
        # what was written is what the trigger's rows are made of
        changed = now.filter(F.col("changed") == epoch).select(*JOB, *STATE, "registration.*")
        write_epoch(state_rows(changed), f"{path}/rows", epoch)
        waiting.save(located.filter(F.col("registration").isNull()).drop("registration"), epoch, waiting_loaded, touched)

    return each_trigger(events, save, checkpoint, **trigger)


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """Current state of each job from what stream_job_state wrote to ``path``."""
    return latest(spark, f"{path}/rows", JOB)
