"""Loss progress of running jobs from a stream of job events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger.functions import losses as loss_functions
from runledger.operators.jobs import EVENT_ORDER, JOB
from runledger.operators.progress import (
    HISTORY_WINDOW, SLOW_THRESHOLD, STAGNATION_THRESHOLD, history_events, newest_changes, rolling_rates,
)
from runledger.streaming.tables import BUCKETS, BucketState, drop_folder, each_trigger, write_epoch

_STATE = ("run_id string, job_id string, ts_us bigint, event_seq bigint, done boolean, loss double, "
          "seen_us bigint")


def stream_progress(
    events: DataFrame,
    path: str,
    checkpoint: str,
    history_window: int = HISTORY_WINDOW,
    stagnation_threshold: float = STAGNATION_THRESHOLD,
    slow_threshold: float = SLOW_THRESHOLD,
    idle_us: int | None = None,
    buckets: int = BUCKETS,
    **trigger,
) -> StreamingQuery:
    """Write one row per usable loss to ``path``/rows: the job's history size, rate and
    classes after it.

    Each trigger rates its events together with the last losses and completions of their
    jobs, by the same expressions as a batch, and keeps the last ones again in
    ``path``/state, by hash bucket of the job (BucketState).  ``idle_us`` drops the history of
    jobs whose last event lies so long before the latest one.  An event that arrives late is
    rated by what is kept.  ``trigger``: as for DataStreamWriter.trigger.
    """
    spark = events.sparkSession
    state = BucketState(spark, f"{path}/state", _STATE, JOB, buckets, idle_us)

    def save(batch: DataFrame, epoch: int) -> None:
        fresh = history_events(batch).withColumn("seen_us", F.col("ts_us"))
        touched = state.touched(fresh)
        kept, loaded = state.load(epoch, touched)
        both = kept.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))
        sorted_rows = f"{path}/sorted/epoch={epoch}"
        rated = rolling_rates(both, history_window, sorted_rows).filter("fresh").select(
            *JOB, *EVENT_ORDER, "history_size", "rate")
        write_epoch(rated.withColumns({
            "forward_class": loss_functions.forward_class(F.col("rate"), stagnation_threshold),
            "reverse_class": loss_functions.reverse_class(F.col("rate"), slow_threshold),
        }), f"{path}/rows", epoch)
        drop_folder(spark, sorted_rows)
        # as many rows for a job as the window has, so that a hot job is no large group here
        newest = newest_changes(both.drop("fresh"), history_window)
        seen = F.max("seen_us").over(Window.partitionBy(*JOB))
        state.save(newest.withColumn("seen_us", seen), epoch, loaded, touched)

    return each_trigger(events, save, checkpoint, **trigger)
