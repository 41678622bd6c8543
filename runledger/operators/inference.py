"""Batch inference over many adapters with a caller-supplied model function."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.text import strip_prompt
from runledger.operators.requests import (
    BATCH_KEYS, BATCH_SIZE, fifo_batches, fill_request_params, route_requests,
)

# generate(adapter_id, prompts, params) -> one decoded text per prompt
Generate = Callable[[str, Sequence[str], dict], Sequence[str]]

_OUT = (
    "run_id string, request_ids array<string>, submissions array<bigint>, prompts array<string>, "
    "started_us bigint, ended_us bigint, decoded array<string>, error string"
)


def batch_infer(
    requests: DataFrame,
    catalogue: DataFrame,
    generate: Generate,
    batch_size: int = BATCH_SIZE,
    batches_per_load: int = 64,
    tasks: int | None = None,
) -> DataFrame:
    """Answer requests in batches of one adapter each; returns rows like ``results``.

    Requests whose adapter cannot be loaded fail at once.  The others are batched in
    arrival order; each batch is one row with its requests in arrays.  Runs of
    ``batches_per_load`` batches of one adapter go to the same one of ``tasks`` tasks
    (as many as shuffle partitions by default), so that ``generate`` may keep the
    adapter it used last while a much-used adapter still spreads over all tasks.  An
    exception fails the requests of its batch only.
    """
    spark = requests.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = route_requests(requests, catalogue)
    now = F.unix_micros(F.current_timestamp())
    refused = routed.filter(F.col("route_error").isNotNull()).select(
        "run_id", "request_id", "submission_us",
        F.lit(None).cast("bigint").alias("processing_start_us"),
        now.alias("processing_end_us"),
        F.lit(None).cast("string").alias("output"),
        F.col("route_error").alias("error"),
    )
    batched = fifo_batches(
        fill_request_params(routed.filter(F.col("route_error").isNull())), batch_size)
    item = F.struct("pos", "request_id", "submission_us", "prompt", "generation_params")
    batches = (
        batched.groupBy(*BATCH_KEYS)
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select(
            *BATCH_KEYS,
            F.col("items.request_id").alias("request_ids"),
            F.col("items.submission_us").alias("submissions"),
            F.col("items.prompt").alias("prompts"),
            F.to_json(F.col("items")[0]["generation_params"]).alias("params"),
        )
        .repartition(tasks, "run_id", "adapter_id", F.floor(F.col("batch") / batches_per_load))
        .sortWithinPartitions("adapter_id", "run_id", "batch")
    )
    answered = batches.mapInPandas(_answer(generate), _OUT)
    rows = answered.select(
        "run_id", "started_us", "ended_us", "error",
        F.explode(F.arrays_zip("request_ids", "submissions", "prompts", "decoded")).alias("r"))
    results = rows.select(
        "run_id",
        F.col("r.request_ids").alias("request_id"),
        F.col("r.submissions").alias("submission_us"),
        F.col("started_us").alias("processing_start_us"),
        F.col("ended_us").alias("processing_end_us"),
        F.when(F.col("error").isNull(), strip_prompt(F.col("r.decoded"), F.col("r.prompts"))).alias("output"),
        "error",
    )
    return results.unionByName(refused)


def _answer(generate: Generate) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = []
            for batch in frame.itertuples(index=False):
                prompts = list(batch.prompts)
                started = time.time_ns() // 1000
                try:
                    decoded = list(generate(batch.adapter_id, prompts, json.loads(batch.params)))
                    if len(decoded) != len(prompts):
                        raise ValueError(f"{len(decoded)} outputs for {len(prompts)} prompts")
                    error = None
                except Exception as failure:  # one batch fails, the others go on
                    started, decoded, error = None, [None] * len(prompts), str(failure)
                done.append((batch.run_id, list(batch.request_ids), list(batch.submissions), prompts,
                             started, time.time_ns() // 1000, decoded, error))
            columns = [part.split()[0] for part in _OUT.split(", ")]
            out = pd.DataFrame(done, columns=columns)
            out["started_us"] = out["started_us"].astype("Int64")
            yield out

    return run
