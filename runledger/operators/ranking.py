"""Which jobs should train next: four policies and a registry for more.

Each policy reads runnable jobs (run_id, job_id, reg_seq, current_step) and a
progress table (progress_rate), and returns run_id, rank, job_id, score and
is_fallback.  Ties go to the job registered first.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.operators.progress import (
    SLOW_THRESHOLD, STAGNATION_THRESHOLD, classify_progress,
)

Policy = Callable[..., DataFrame]


def _top(
    jobs: DataFrame, score: Column, order: Sequence[Column], k: int, wanted: Column | None = None,
) -> DataFrame:
    """The first ``k`` wanted jobs per run; where a run has none, its smallest job id.

    Unwanted jobs are ordered by id behind the wanted ones, so that one of them ranks
    first only in a run without wanted jobs.
    """
    wanted = F.lit(True) if wanted is None else wanted
    by_run = Window.partitionBy("run_id").orderBy(wanted.desc(), *order, F.col("job_id"))
    flagged = jobs.withColumns({
        "score": F.when(wanted, score.cast("double")),
        "is_fallback": ~wanted,
        "rank": F.row_number().over(by_run),
    })
    return (
        flagged.filter((F.col("rank") <= k) & (~F.col("is_fallback") | (F.col("rank") == 1)))
        .select("run_id", F.col("rank").cast("bigint").alias("rank"), "job_id", "score", "is_fallback")
    )


def rank_least_progress(jobs: DataFrame, progress: DataFrame | None = None, k: int = 1) -> DataFrame:
    """Fewest steps first; jobs whose step is not a whole number are left out."""
    step = F.col("current_step").try_cast("bigint")
    whole = F.col("current_step").try_cast("decimal(38,9)") == step
    counted = jobs.withColumn("__step", step).filter(whole)
    return _top(counted, F.col("__step"), [F.col("__step"), F.col("reg_seq")], k)


def rank_forward(
    jobs: DataFrame, progress: DataFrame, threshold: float = STAGNATION_THRESHOLD, k: int = 1,
) -> DataFrame:
    """Fastest improving first; the smallest job id where no job improves enough."""
    rated = classify_progress(jobs, progress, stagnation_threshold=threshold)
    good = F.col("forward_class") == "progressing"
    rate = F.when(good, F.coalesce("rate", F.lit(0.0)))
    return _top(rated, rate, [rate.desc(), F.when(good, F.col("reg_seq"))], k, good)


def rank_reverse(
    jobs: DataFrame, progress: DataFrame, threshold: float = SLOW_THRESHOLD, k: int = 1,
) -> DataFrame:
    """Slowest improving first; the smallest other job id where none is slow."""
    rated = classify_progress(jobs, progress, slow_threshold=threshold)
    slow = F.col("reverse_class") == "struggling"
    rate = F.when(slow, F.col("rate"))
    return _top(rated, rate, [rate, F.when(slow, F.col("reg_seq"))], k, slow)


def first_by_id(jobs: DataFrame, progress: DataFrame | None = None, k: int = 1) -> DataFrame:
    """Smallest job ids per run, compared as strings."""
    return _top(jobs, F.lit(None), [F.col("job_id")], k)


# The policy names used in run reports.
DEFAULT_POLICY = "RoundRobin"
_POLICIES: dict[str, Policy] = {
    "RoundRobin": first_by_id,
    "LeastProgressFirst": rank_least_progress,
    "ForwardStagnationAware": rank_forward,
    "ReverseStagnationAware": rank_reverse,
}


def register_policy(name: str, policy: Policy) -> None:
    _POLICIES[name] = policy


def policy_names() -> list[str]:
    return list(_POLICIES)


def rank_jobs(name: str, jobs: DataFrame, progress: DataFrame, **params) -> DataFrame:
    """Apply the named policy; an unknown name falls back to RoundRobin with a warning."""
    if name not in _POLICIES:
        warnings.warn(f"unknown policy {name!r}, using {DEFAULT_POLICY}", stacklevel=2)
        name, params = DEFAULT_POLICY, {p: v for p, v in params.items() if p == "k"}
    return _POLICIES[name](jobs, progress, **params)
