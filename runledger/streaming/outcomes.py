"""Running request outcomes from a stream of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger.operators.ordered import null_safe_join
from runledger.operators.requests import outcome_counts
from runledger.streaming.tables import BUCKETS, BucketState, each_trigger, latest, write_epoch

RUN = ["run_id"]
_COUNTS = ["total", "successful", "failed"]
_STATE = "run_id string, total bigint, successful bigint, failed bigint, seen_us bigint"


def stream_outcomes(
    results: DataFrame, path: str, checkpoint: str, idle_us: int | None = None, buckets: int = BUCKETS, **trigger,
) -> StreamingQuery:
    """Write the runs that each trigger changes to ``path``/rows: total, successful and failed
    results so far.

    A trigger counts its own results and adds them to the counts in ``path``/state, kept by
    hash bucket of the run (BucketState).  A run was last seen at the latest time of its
    results; ``idle_us`` drops runs that were last seen so long before the latest result, so
    that such a run begins anew.  ``trigger``: as for DataStreamWriter.trigger.
    """
    state = BucketState(results.sparkSession, f"{path}/state", _STATE, RUN, buckets, idle_us)

    def save(batch: DataFrame, epoch: int) -> None:
        at = F.greatest("submission_us", "processing_start_us", "processing_end_us")
        fresh = batch.groupBy(*RUN).agg(*outcome_counts(), F.max(F.coalesce(at, F.lit(0).cast("bigint"))).alias("seen_us"))
        touched = state.touched(fresh)
        kept, loaded = state.load(epoch, touched)
        both = kept.unionByName(fresh).groupBy(*RUN).agg(
            *[F.sum(c).alias(c) for c in _COUNTS], F.max("seen_us").alias("seen_us"))
        now = state.save(both, epoch, loaded, touched)
        write_epoch(null_safe_join(now, fresh.select(*RUN), RUN, "inner").select(*RUN, *_COUNTS), f"{path}/rows", epoch)

    return each_trigger(results, save, checkpoint, **trigger)


def latest_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Counts of each run from what stream_outcomes wrote to ``path``."""
    return latest(spark, f"{path}/rows", RUN)
