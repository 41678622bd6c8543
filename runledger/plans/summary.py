"""The report of a run: request and job figures in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators.jobs import (
    completion_times, expected_vs_actual_jobs, makespan_seconds, status_counts,
)
from runledger.operators.requests import latency_summary, outcome_counts, per_second


def run_bounds(results: DataFrame) -> DataFrame:
    """Start and end of each run as seen in its results, where no run log exists."""
    return results.groupBy("run_id").agg(
        F.min("submission_us").alias("run_start_us"), F.max("processing_end_us").alias("run_end_us"))


def run_summary(
    expected: DataFrame, jobs: DataFrame, results: DataFrame, runs: DataFrame | None = None,
    approx: bool = False,
) -> DataFrame:
    """Job counts, makespan, completion times, request outcomes, latencies and
    throughput, one row per run.

    Jobs and results are each aggregated once; only the per-run rows are joined.
    Without ``runs``, a run lasts from its first submission to its last end.
    """
    job_side = expected_vs_actual_jobs(expected, jobs).groupBy("run_id").agg(
        *status_counts(), makespan_seconds(), *completion_times())
    bounds = (
        F.min("submission_us").alias("run_start_us"),
        F.max("processing_end_us").alias("run_end_us"),
    )
    request_side = latency_summary(results, approx, extra=(*outcome_counts(), *bounds))
    if runs is not None:
        request_side = request_side.drop("run_start_us", "run_end_us").join(
            runs.select("run_id", "run_start_us", "run_end_us"), "run_id", "left")
    request_side = request_side.withColumn(
        "throughput", F.coalesce(per_second(F.col("successful")), F.lit(0.0)))
    both = job_side.join(request_side.drop("run_start_us", "run_end_us"), "run_id", "full")
    counts = ["expected_jobs", "completed_jobs", "failed_jobs", "total", "successful", "failed"]
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumn(
        "throughput", F.coalesce("throughput", F.lit(0.0)))
