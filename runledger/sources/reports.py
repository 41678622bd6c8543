"""Run reports: nested JSON documents, and the flat tables that hold the same rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions.timing import elapsed_s, present
from runledger.operators.ordered import null_safe_join
from runledger.session import write_scratch

# Metric names of the report, and the run_summary columns they hold.
REPORT_METRICS = {
    "training_total_jobs_in_scenario": "expected_jobs",
    "training_completed_jobs": "completed_jobs",
    "training_failed_jobs": "failed_jobs",
    "training_makespan_seconds": "makespan_s",
    "training_avg_completion_time_seconds": "completion_avg_s",
    "training_stddev_completion_time_seconds": "completion_stddev_s",
    "inference_total_processed": "total",
    "inference_successful": "successful",
    "inference_failed": "failed",
    "inference_throughput_success_per_sec": "throughput",
    "inference_e2e_latency_ms_avg": "e2e_avg_ms",
    "inference_e2e_latency_ms_p50": "e2e_p50_ms",
    "inference_e2e_latency_ms_p95": "e2e_p95_ms",
    "inference_e2e_latency_ms_p99": "e2e_p99_ms",
    "inference_processing_latency_ms_avg": "proc_avg_ms",
    "inference_processing_latency_ms_p50": "proc_p50_ms",
    "inference_processing_latency_ms_p95": "proc_p95_ms",
    "inference_processing_latency_ms_p99": "proc_p99_ms",
}

_CORRUPT = "_corrupt_record"
_AT, _PART, _PARTS = "__at", "__part", "__parts"


class Reports(NamedTuple):
    runs: DataFrame
    job_details: DataFrame
    request_details: DataFrame
    rejected: DataFrame


def plain_path(uri: Column) -> Column:
    """A file URI without percent escapes."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _micros(seconds: Column) -> Column:
    return F.round(seconds * 1_000_000).cast("bigint")


def _seconds(micros: Column) -> Column:
    return micros / F.lit(1_000_000.0)


def read_run_reports(spark: SparkSession, directory: str, multiline: bool = True) -> Reports:
    """Read every ``*.json`` report below a directory.  ``config_used`` comes as JSON text.

    ``multiline``: one document per file; otherwise one per line, as
    ``write_run_reports`` writes them.  Documents of one run_id are parts of one report, each with
    its header.  Malformed documents are listed in
    ``rejected`` and the others still load.  A report without a run_id takes its
    file name.
    """
    documents = (
        spark.read.schema(f"{schemas.REPORT}, {_CORRUPT} string")
        .option("multiLine", multiline)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .option("pathGlobFilter", "*.json")
        .json(directory)
        .withColumn("file", plain_path(F.col("_metadata.file_path")))
    )
    nameless = F.col("strategy").isNull() | (F.col("run_id").isNull() & F.col("run_timestamp").isNull())
    bad = F.col(_CORRUPT).isNotNull() | nameless
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.json$", "")
    good = documents.filter(~bad).withColumn("run_id", F.coalesce("run_id", name))
    runs = good.select(
        "run_id", "strategy", "strategy_params", "run_timestamp", F.to_json("config_used").alias("config_used"),
        "total_monitor_time_seconds", "summary_metrics",
    ).dropDuplicates(["run_id"])
    jobs = good.select("run_id", "strategy", F.explode("training_job_details").alias("job_id", "d")).select(
        "run_id", "strategy", "job_id", "d.status",
        _micros(F.col("d.start_time")).alias("start_us"),
        _micros(F.col("d.end_time")).alias("end_us"),
        "d.duration_seconds", "d.final_step", F.col("d.error").alias("error_message"),
    )
    requests = good.select("run_id", "strategy", F.explode("inference_request_details").alias("d")).select(
        "run_id", "strategy", "d.request_id",
        _micros(F.col("d.submission_time")).alias("submission_us"),
        _micros(F.col("d.processing_start_time")).alias("processing_start_us"),
        _micros(F.col("d.processing_end_time")).alias("processing_end_us"),
        "d.output", "d.error",
    )
    return Reports(runs, jobs, requests, documents.filter(bad).select("file", _CORRUPT))


def summary_columns(runs: DataFrame) -> DataFrame:
    """The summary metrics of read reports as the columns of run_summary."""
    metrics = [F.try_element_at("summary_metrics", F.lit(key)).alias(c) for key, c in REPORT_METRICS.items()]
    return runs.select("run_id", "strategy", *metrics)


def _job_details(jobs: DataFrame) -> DataFrame:
    duration = elapsed_s(present(F.col("start_us")), present(F.col("end_us")))
    return jobs.select(
        "run_id", "job_id", "status", "start_us", "end_us", duration.alias("duration_seconds"),
        F.col("current_step").cast("bigint").alias("final_step"), "error_message")


def write_run_reports(
    path: str, runs: DataFrame, summary: DataFrame, jobs: DataFrame, results: DataFrame,
    nested: bool = False, most_details: int = 10_000,
) -> None:
    """Write runs with their summary, job details and request details.

    ``runs``: run_id, strategy, strategy_params, run_start_us, run_end_us, and if wanted
    config_used as JSON text.  ``jobs``: the rows of expected_vs_actual_jobs.

    By default three parquet tables below ``path``, partitioned by strategy, however
    large a run is.  ``nested`` writes JSON documents instead: one per run, or for a run with more
    jobs or requests than ``most_details`` several, each with the run's header and some
    ``most_details`` of either, which ``read_run_reports`` puts together again.
    """
    headers = _headers(runs, summary)
    strategies = runs.select("run_id", "strategy")
    details = _job_details(jobs)
    if nested:
        _documents(headers, details, results, most_details).write.partitionBy("strategy").json(path)
        return
    headers.withColumn("config_used", F.to_json("config_used")).write.partitionBy("strategy").parquet(f"{path}/runs")
    null_safe_join(details, strategies, ["run_id"]).write.partitionBy("strategy").parquet(
        f"{path}/job_details")
    null_safe_join(results, strategies, ["run_id"]).write.partitionBy("strategy").parquet(
        f"{path}/request_details")


def _headers(runs: DataFrame, summary: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(key), F.col(c).cast("double")) for key, c in REPORT_METRICS.items()]
    known = F.map_filter(F.map_from_entries(F.array(*pairs)), lambda _, value: value.isNotNull())
    metrics = summary.select("run_id", known.alias("summary_metrics"))
    ended = F.timestamp_micros("run_end_us")
    config = F.col("config_used") if "config_used" in runs.columns else F.lit(None).cast("string")
    return null_safe_join(runs, metrics, ["run_id"]).select(
        "run_id",
        F.date_format(ended, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("run_timestamp"),
        "strategy", "strategy_params", F.try_parse_json(config).alias("config_used"),
        elapsed_s(F.col("run_start_us"), F.col("run_end_us")).alias("total_monitor_time_seconds"),
        "summary_metrics",
    )


def _dealt(details: DataFrame, by: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows, written once, with the number of their part of the run, and the runs with their number of parts.

    Parts are dealt out by the hash of ``by``, which may be the written row's own number (``__at``).
    """
    written = write_scratch(details.withColumn(_AT, F.monotonically_increasing_id()))
    counted = written.groupBy("run_id").agg(F.ceil(F.count(F.lit(1)) / most).alias(_PARTS))
    parts = write_scratch(counted)  # as a written table Spark knows that it is small, and broadcasts it
    dealt = null_safe_join(written, parts, ["run_id"]).withColumn(_PART, F.pmod(F.xxhash64(by), _PARTS))
    return dealt, parts


def _documents(headers: DataFrame, jobs: DataFrame, results: DataFrame, most: int) -> DataFrame:
    job_detail = F.struct(
        "status", _seconds(F.col("start_us")).alias("start_time"), _seconds(F.col("end_us")).alias("end_time"),
        "duration_seconds", "final_step", F.col("error_message").alias("error"))
    request_detail = F.struct(
        "request_id", _seconds(F.col("submission_us")).alias("submission_time"),
        _seconds(F.col("processing_start_us")).alias("processing_start_time"),
        _seconds(F.col("processing_end_us")).alias("processing_end_time"), "output", "error")
    # a job's id is a key of the document's map; requests may be alike in every column
    dealt_jobs, job_parts = _dealt(jobs, "job_id", most)
    dealt_results, result_parts = _dealt(results, _AT, most)
    rows = dealt_jobs.select("run_id", _PART, F.struct("job_id", job_detail.alias("detail")).alias("job")).unionByName(
        dealt_results.select("run_id", _PART, request_detail.alias("request")), allowMissingColumns=True)

    def listed(column: str) -> Column:  # null for none; collect_list leaves out nulls
        return F.when(F.count(column) > 0, F.collect_list(column))

    details = rows.groupBy("run_id", _PART).agg(
        F.map_from_entries(listed("job")).alias("training_job_details"),
        listed("request").alias("inference_request_details")).drop(_PART)
    headers = write_scratch(headers)
    held = job_parts.select("run_id").union(result_parts.select("run_id"))
    bare = null_safe_join(headers, held, ["run_id"], "left_anti")
    return null_safe_join(details, headers, ["run_id"], "inner").unionByName(bare, allowMissingColumns=True)
