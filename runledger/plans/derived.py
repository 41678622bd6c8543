"""Queries that go through files or streams which Spark derives from the tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger.operators import requests
from runledger.operators.jobs import expected_vs_actual_jobs
from runledger.operators.ordered import null_safe_join
from runledger.operators.quantiles import percentiles
from runledger.plans import bindings
from runledger.plans.bindings import Tables
from runledger.plans.summary import run_bounds, run_summary
from runledger.session import scratch_dir, write_scratch
from runledger.sources import adapters
from runledger.sources.bucketed import buckets_for, scratch_bucketed
from runledger.sources.listing import list_files, missing_files
from runledger.sources.reports import Reports, read_run_reports, write_run_reports
from runledger.streaming import ingest, job_state, outcomes, progress


_TRIGGERS = 3


def _write(t: Tables, nested: bool) -> str:
    path = scratch_dir(t.spark)
    results = t.strategy_results()
    outcome = expected_vs_actual_jobs(t.expected(), t.seen_jobs()).withColumn(
        "error_message", F.lit(None).cast("string"))
    runs = run_bounds(results).withColumns({
        "strategy": F.col("run_id"), "strategy_params": F.create_map(F.lit("k"), F.lit("3")),
        "config_used": F.to_json(F.struct(F.struct("run_id").alias("model")))})
    summary = run_summary(t.expected(), t.seen_jobs(), results)
    write_run_reports(path, runs, summary, outcome.drop("strategy"), results, nested=nested)
    return path


def bucketed(*tables: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    """The tables written in as many buckets as the largest needs, to be joined on ``keys`` without a shuffle."""
    buckets = buckets_for(tables[0].sparkSession, max(table.count() for table in tables))
    return [scratch_bucketed(table, keys, buckets) for table in tables]


def written_job_details(t: Tables) -> DataFrame:
    path = _write(t, nested=False)
    return t.spark.read.parquet(f"{path}/job_details").select(
        "run_id", "job_id", "status", "start_us", "end_us", "final_step")


def reread_reports(t: Tables) -> Reports:
    return read_run_reports(t.spark, _write(t, nested=True), multiline=False)


def missing_reports(t: Tables) -> DataFrame:
    """Of the reports of all runs, and of as many runs that never were, those that aren't there."""
    files = list_files(t.spark, _write(t, nested=True)).filter(F.col("path").endswith(".json"))
    runs = t.strategy_results().select("run_id").distinct()
    expected = runs.select(F.explode(F.array("run_id", F.concat("run_id", F.lit("!")))).alias("name"))
    return missing_files(files, expected, F.url_decode(F.regexp_extract("path", "/strategy=([^/]*)/", 1)))


def sketched_latency(t: Tables) -> DataFrame:
    """Counts of merged hourly sketches, and whether their percentiles lie near the exact ones."""
    results = t.results()
    sketched = requests.sketched_latency(write_scratch(requests.latency_sketches(results)))
    near = {"p50": (0.47, 0.53), "p95": (0.93, 0.97), "p99": (0.975, 1.0)}
    bounds = percentiles(requests.request_latency(results), ["run_id"], {f"{kind}_ms": {
        f"{kind}_{name}_{end}": p for name, ends in near.items() for end, p in zip(("low", "high"), ends)} for kind in ("e2e", "proc")})
    both = null_safe_join(sketched, bounds, ["run_id"])
    return both.select("run_id", "e2e_n", "proc_n", *[
        F.col(f"{kind}_{name}_ms").between(F.col(f"{kind}_{name}_low"), F.col(f"{kind}_{name}_high")).alias(f"{kind}_{name}_near")
        for kind in ("e2e", "proc") for name in near])


def _store(t: Tables) -> str:
    """An adapter store with a configuration file for each adapter, made from the parts.
    Spark escapes some characters of folder names."""
    path = scratch_dir(t.spark)
    name = F.concat(F.col("p_brand"), F.lit("_"), F.col("p_size") % 10)
    size = F.col("p_size").cast("int")
    configs = t.raw("part").groupBy(name.alias("adapter")).agg(
        F.min(size).alias("r"), F.max(size).alias("lora_alpha"),
        F.sort_array(F.collect_set("p_type")).alias("target_modules"))
    task = F.when(F.col("r") % 2 == 0, "SEQ_CLS")
    configs.withColumn("task_type", task).repartition("adapter").write.partitionBy("adapter").json(path)
    return path


def scanned_configs(t: Tables) -> DataFrame:
    return adapters.scan_adapter_configs(t.spark, _store(t), "*.json").select(
        F.url_decode(F.replace("adapter_id", F.lit("adapter="), F.lit(""))).alias("adapter_id"), "r", "lora_alpha",
        F.array_join("target_modules", " ").alias("target_modules"), "task_type", "malformed")


def listed_files(t: Tables) -> DataFrame:
    files = adapters.list_adapter_files(t.spark, _store(t)).filter(F.col("path").endswith(".json"))
    folder = F.url_decode(F.url_decode(F.element_at(F.split("path", "/"), -2)))
    return files.groupBy(F.replace(folder, F.lit("adapter="), F.lit("")).alias("adapter_id")).agg(
        F.count(F.lit(1)).alias("files"), F.bool_and(F.col("size") > 0).alias("filled"))


def _stream_events(t: Tables, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Run a stream over the events, oldest first: it is stopped when it has read what is there
    and goes on from its checkpoint when the next part of the table has come.

    Parts are written by as many tasks as read the table; events without an id, or below 0,
    come first.
    """
    path, events = scratch_dir(t.spark), t.raw("events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    stream = t.spark.readStream.schema(events.schema).parquet(f"{path}/*")
    cuts = [-(-(last + 1) * i // _TRIGGERS) for i in range(1, _TRIGGERS)]
    for i in range(_TRIGGERS):
        part = F.lit(True) if i == 0 else F.col("event_id") >= cuts[i - 1]
        if i < len(cuts):
            part &= F.coalesce(F.col("event_id") < cuts[i], F.lit(i == 0))
        events.filter(part).write.parquet(f"{path}/{i}")
        run(bindings.events_in_micros(stream)).awaitTermination()


def streamed_progress(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark)
    _stream_events(t, lambda events: progress.stream_progress(bindings.bind_job_events(events), path, f"{path}/checkpoint"))
    return t.spark.read.parquet(f"{path}/rows").drop("epoch")


def streamed_job_state(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark)
    _stream_events(t, lambda events: job_state.stream_job_state(bindings.bind_job_events(events), path, f"{path}/checkpoint"))
    return job_state.latest_state(t.spark, path).drop("n_losses")


def streamed_outcomes(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark)
    run = (F.col("user_id") % 3).cast("string")
    _stream_events(t, lambda events: outcomes.stream_outcomes(bindings.bind_results(events, run), path, f"{path}/checkpoint"))
    return outcomes.latest_outcomes(t.spark, path)


def streamed_submissions(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark)
    _stream_events(t, lambda events: ingest.stream_ingest(bindings.bind_submissions(events), f"{path}/rows", f"{path}/checkpoint"))
    return t.spark.read.parquet(f"{path}/rows").select("run_id", "seq", "sink")
