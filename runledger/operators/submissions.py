"""Submitted events: routing, validation, defaults, first registration, quotas."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger import schemas
from runledger.operators.ordered import null_safe_join

# Fixed values of the submission format.
TRAIN_JOB, INFERENCE_REQ = "TRAIN_JOB", "INFERENCE_REQ"
MISSING_JOB_ID = "job_id missing"
MISSING_SAMPLES = "Missing or invalid dataset_samples"
DEFAULT_SAVE_PATH = "./adapters/job_"
DEFAULT_BATCH_SIZE = 1
DEFAULT_LEARNING_RATE = 5e-5
REQUEST_QUOTA, JOB_QUOTA = 100, 10


class Routed(NamedTuple):
    jobs: DataFrame
    requests: DataFrame
    unknown: DataFrame


def tag_submissions(events: DataFrame) -> DataFrame:
    """Add ``kind``: job, request or unknown."""
    return events.withColumn(
        "kind",
        F.when(F.col("event_type") == TRAIN_JOB, "job")
        .when(F.col("event_type") == INFERENCE_REQ, "request")
        .otherwise("unknown"),
    )


def split_submissions(events: DataFrame) -> Routed:
    """Route submissions by type; unknown types are set aside."""
    tagged = tag_submissions(events)
    return Routed(*[tagged.filter(F.col("kind") == k).drop("kind") for k in ("job", "request", "unknown")])


def check_jobs(job_subs: DataFrame) -> DataFrame:
    """Add ``reject_reason``, and ``status`` and ``error_message`` at registration."""
    rejected = F.col("job_id").isNull() | (F.col("job_id") == "")
    no_samples = F.col("dataset_samples").isNull() | (F.size("dataset_samples") == 0)
    return job_subs.withColumns({
        "reject_reason": F.when(rejected, F.lit(MISSING_JOB_ID)),
        "status": F.when(~rejected & no_samples, schemas.FAILED).when(~rejected, schemas.ACTIVE),
        "error_message": F.when(~rejected & no_samples, F.lit(MISSING_SAMPLES)),
    })


def validate_submissions(job_subs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) job submissions."""
    checked = check_jobs(job_subs)
    accepted = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = checked.filter(F.col("reject_reason").isNotNull()).drop("status", "error_message")
    return accepted, rejected


def fill_job_defaults(job_subs: DataFrame, batch_size: int | None = None) -> DataFrame:
    path = F.nullif(F.col("adapter_save_path"), F.lit(""))
    return job_subs.withColumns({
        "adapter_save_path": F.coalesce(path, F.concat(F.lit(DEFAULT_SAVE_PATH), F.col("job_id"))),
        "batch_size": F.coalesce("batch_size", F.lit(batch_size or DEFAULT_BATCH_SIZE)),
        "lr": F.coalesce("lr", F.lit(DEFAULT_LEARNING_RATE)),
    })


def explode_job_samples(job_subs: DataFrame) -> DataFrame:
    """One row per training sample, numbered from 0 within its submission."""
    return job_subs.select(
        "run_id", "job_id", "seq",
        F.posexplode("dataset_samples").alias("sample_idx", "text"),
    )


def first_registration(job_subs: DataFrame) -> DataFrame:
    """The first submission of each job wins; later ones are only counted."""
    payload = F.struct(*[c for c in job_subs.columns if c not in ("run_id", "job_id")])
    return (
        job_subs.groupBy("run_id", "job_id")
        .agg(F.min_by(payload, F.col("seq")).alias("first"),
             (F.count(F.lit(1)) - 1).alias("duplicates"))
        .select("run_id", "job_id", "first.*", "duplicates")
    )


def admission_cap(events: DataFrame, interval: str, limit: int, order: tuple[str, str] = ("submitted_us", "seq")) -> DataFrame:
    """Mark the first ``limit`` submissions per (run, interval) ``accepted``, the rest ``rejected``.

    0 means no limit.  The cut is the ``limit``-th submission among the keys alone: ranks beyond
    it are pruned before the shuffle, so that a task hands on ``limit`` rows of a group
    at most.  It is then compared with every row, so that the rows themselves are not
    sorted.  A null key is a group like any other.
    """
    if limit <= 0:
        return events.withColumn("admission", F.lit("accepted"))
    keys = ["run_id", interval]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    cuts = (
        events.select(*keys, *order).withColumn("__rank", place).filter(F.col("__rank") <= limit)
        .groupBy(*keys).agg(F.max("__rank").alias("__rank"), F.max(F.struct(*order)).alias("__cut"))
        .filter(F.col("__rank") == limit).drop("__rank")
    )
    inside = F.col("__cut").isNull() | (F.struct(*order) <= F.col("__cut"))
    return (
        null_safe_join(events, cuts, keys)
        .withColumn("admission", F.when(inside, "accepted").otherwise("rejected"))
        .drop("__cut")
    )
