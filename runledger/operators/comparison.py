"""Comparing runs and strategies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.timing import elapsed_s, present
from runledger.operators.ordered import null_safe_join

# The compared metrics and the labels they are shown under.
COMPARED = {
    "Makespan (s)": "makespan_s",
    "Avg Job Comp (s)": "completion_avg_s",
    "Avg Inf Latency (ms)": "e2e_avg_ms",
    "Inf Throughput (req/s)": "throughput",
}


def strategy_comparison(
    summary: DataFrame, strategies: Sequence[str], key: str = "strategy",
    metrics: Mapping[str, str] = COMPARED,
) -> DataFrame:
    """One row per metric, one column per strategy; a missing value is 0."""
    pairs = [F.struct(F.lit(label).alias("metric"), F.col(column).cast("double").alias("value"))
             for label, column in metrics.items()]
    tall = summary.select(key, F.explode(F.array(*pairs)).alias("m")).select(key, "m.*")
    wide = tall.groupBy("metric").pivot(key, list(strategies)).agg(F.first("value", ignorenulls=True))
    return wide.select("metric", *[F.coalesce(F.col(f"`{s}`"), F.lit(0.0)).alias(s) for s in strategies])


def job_durations(
    expected: DataFrame, jobs: DataFrame, strategies: Sequence[str], prefix: str = "",
) -> DataFrame:
    """Duration of each expected job under each strategy, 0 where it has none.

    ``prefix`` is cut from the label.
    """
    duration = elapsed_s(present(F.col("start_us")), present(F.col("end_us")))
    timed = jobs.groupBy("job_id").agg(*[
        F.max(F.when(F.col("strategy") == s, duration)).alias(s) for s in strategies])
    label = F.replace(F.col("job_id"), F.lit(prefix), F.lit("")) if prefix else F.col("job_id")
    joined = expected.select("job_id").distinct().join(timed, "job_id", "left")
    return joined.select(
        label.alias("job"), *[F.coalesce(F.col(f"`{s}`"), F.lit(0.0)).alias(s) for s in strategies])


def label_lookup(
    df: DataFrame, code: str, labels: DataFrame, label: str = "label",
) -> DataFrame:
    """Add the display label of ``code``; a code without one stands for itself.

    ``labels`` has one row per code: columns ``code`` and ``label``.
    """
    table = labels.select(F.col("code").alias(code), F.col("label").alias(label))
    return null_safe_join(df, table, [code]).withColumn(
        label, F.coalesce(F.col(label), F.col(code).cast("string")))
