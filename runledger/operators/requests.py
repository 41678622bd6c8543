"""Inference requests and their results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.paths import adapter_id
from runledger.functions.timing import elapsed_ms, elapsed_s
from runledger.functions.text import strip_prompt
from runledger.operators.ordered import null_safe_join, number_rows, running_sums
from runledger.operators.quantiles import percentiles, sketch_quantiles

# Generation defaults, inference batch size, reported percentiles.
MAX_NEW_TOKENS, TEMPERATURE, DO_SAMPLE = 50, 0.7, True
BATCH_SIZE = 4
REPORTED = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
WHISKER = 1.5

# Fixed value: the error of requests whose adapter cannot be loaded.
NOT_LOADED = "Failed to load adapter '%s'"

def success() -> Column:
    return F.col("error").isNull() & F.col("output").isNotNull()


def flag_success(results: DataFrame) -> DataFrame:
    return results.withColumn("success", success())


def request_latency(results: DataFrame) -> DataFrame:
    """End-to-end and processing milliseconds of successful results, else null."""
    return results.withColumns({
        "e2e_ms": F.when(success(), elapsed_ms(F.col("submission_us"), F.col("processing_end_us"))),
        "proc_ms": F.when(success(), elapsed_ms(F.col("processing_start_us"), F.col("processing_end_us"))),
    })


def adapter_id_from_path(requests: DataFrame) -> DataFrame:
    return requests.withColumn("adapter_id", adapter_id(F.col("adapter_path")))


def fill_request_params(requests: DataFrame) -> DataFrame:
    params = F.col("generation_params")
    return requests.withColumn("generation_params", F.struct(
        F.coalesce(params["max_new_tokens"], F.lit(MAX_NEW_TOKENS)).alias("max_new_tokens"),
        F.coalesce(params["temperature"], F.lit(TEMPERATURE)).alias("temperature"),
        F.coalesce(params["do_sample"], F.lit(DO_SAMPLE)).alias("do_sample"),
    ))


def strip_prompts(outputs: DataFrame) -> DataFrame:
    """``decoded`` and ``prompt`` give ``output``."""
    return outputs.withColumn("output", strip_prompt(F.col("decoded"), F.col("prompt")))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    users = conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt"))
    replies = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return users.join(replies, ["conv_id", "turn"])


# Joins

def correlate_requests(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Every request with its result; ``state`` is OK, FAILED or UNANSWERED."""
    answers = results.drop("submission_us").withColumn("answered", F.lit(True))
    return (
        requests.join(answers, ["run_id", "request_id"], "left")
        .withColumn(
            "state",
            F.when(F.col("answered").isNull(), "UNANSWERED").when(success(), "OK").otherwise("FAILED"),
        )
        .drop("answered")
    )


def route_requests(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add ``adapter_id`` and ``route_error``.

    ``catalogue`` has one row per adapter with has_config and has_weights.  Requests
    without an adapter pass; others need both in the store.
    """
    stored = catalogue.select(
        "adapter_id", (F.col("has_config") & F.col("has_weights")).alias("loadable"))
    routed = null_safe_join(adapter_id_from_path(requests), stored, ["adapter_id"])
    on_base = F.col("adapter_path").isNull() | (F.col("adapter_path") == "")
    fails = ~on_base & ~F.coalesce("loadable", F.lit(False))
    message = F.format_string(NOT_LOADED, "adapter_id")
    return routed.withColumn("route_error", F.when(fails, message)).drop("loadable")


# Aggregates

def requests_by_adapter(requests: DataFrame) -> DataFrame:
    return (
        adapter_id_from_path(requests).groupBy("run_id", "adapter_id")
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def outcome_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(success()).alias("successful"),
        F.count_if(~success()).alias("failed"),
    ]


def request_outcomes(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id").agg(*outcome_counts())


def latency_summary(
    results: DataFrame, approx: bool = False, extra: tuple[Column, ...] = (),
) -> DataFrame:
    """Mean and percentiles of both latencies per run; null where a run has none."""
    means = [F.avg(f"{kind}_ms").alias(f"{kind}_avg_ms") for kind in ("e2e", "proc")]
    wanted = {
        f"{kind}_ms": {f"{kind}_{name}_ms": p for name, p in REPORTED.items()}
        for kind in ("e2e", "proc")
    }
    return percentiles(request_latency(results), ["run_id"], wanted, [*extra, *means], approx)


#: Time that one row of latency_sketches covers.
SKETCH_US = 3_600_000_000
_SKETCHED = ("e2e", "proc")


def latency_sketches(results: DataFrame, every_us: int = SKETCH_US, size: int = 200) -> DataFrame:
    """KLL sketches of both latencies per run and hour of submission, to be kept: (run_id, hour,
    e2e_n, e2e_sum_ms, e2e_sketch, proc_n, ...).

    New hours are added to what is kept, and any hours and runs are summed up by
    sketched_latency without the results.  ``size``: the sketches' k, with a rank error of about
    2.3 / k ** 0.9.
    """
    hour = F.floor(F.col("submission_us") / every_us).alias("hour")
    aggs = [a for kind in _SKETCHED for a in (
        F.count(f"{kind}_ms").alias(f"{kind}_n"), F.sum(f"{kind}_ms").alias(f"{kind}_sum_ms"),
        F.kll_sketch_agg_double(F.col(f"{kind}_ms").cast("double"), size).alias(f"{kind}_sketch"))]
    return request_latency(results).groupBy("run_id", hour).agg(*aggs)


def sketched_latency(sketches: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """latency_summary per ``keys``, estimated from the rows of latency_sketches."""
    aggs = [a for kind in _SKETCHED for a in (
        F.sum(f"{kind}_n").alias(f"{kind}_n"), F.sum(f"{kind}_sum_ms").alias(f"{kind}_sum_ms"),
        F.kll_merge_agg_double(F.when(F.col(f"{kind}_n") > 0, F.col(f"{kind}_sketch"))).alias(f"{kind}_sketch"))]
    merged = sketches.groupBy(*keys).agg(*aggs)
    known = merged.withColumns({f"{kind}_sketch": F.when(F.col(f"{kind}_n") > 0, F.col(f"{kind}_sketch")) for kind in _SKETCHED})
    return known.select(*keys, *[c for kind in _SKETCHED for c in (
        F.col(f"{kind}_n"), F.try_divide(f"{kind}_sum_ms", f"{kind}_n").alias(f"{kind}_avg_ms"),
        *sketch_quantiles(f"{kind}_sketch", {f"{kind}_{name}_ms": p for name, p in REPORTED.items()}))])


def throughput(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Successful requests per second of run time; 0 for a run that took no time."""
    counted = request_outcomes(results).select("run_id", "successful")
    return runs.join(counted, "run_id", "left").select(
        "run_id", per_second(F.coalesce("successful", F.lit(0))).alias("throughput"))


def per_second(count: Column) -> Column:
    seconds = elapsed_s(F.col("run_start_us"), F.col("run_end_us"))
    return F.when(seconds > 0, count / seconds).otherwise(F.lit(0.0))


def latency_box(results: DataFrame, key: str = "run_id") -> DataFrame:
    """Box-plot figures of the end-to-end latency per ``key``."""
    boxed = _with_box(results, key)
    inside = ~F.col("outlier")
    return boxed.groupBy(key).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("e2e_ms"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("e2e_ms"))).alias("whisker_high"),
        F.count_if("outlier").alias("outliers"),
    )


def latency_outliers(results: DataFrame, key: str = "run_id") -> DataFrame:
    return _with_box(results, key).filter("outlier").select(key, "request_id", "e2e_ms")


def _with_box(results: DataFrame, key: str) -> DataFrame:
    latencies = request_latency(results).filter(F.col("e2e_ms").isNotNull())
    quartiles = percentiles(latencies, [key], {"e2e_ms": {"q1": 0.25, "median": 0.5, "q3": 0.75}})
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    joined = null_safe_join(latencies.select(key, "request_id", "e2e_ms"), quartiles, [key])
    return joined.withColumn(
        "outlier", (F.col("e2e_ms") < F.col("q1") - reach) | (F.col("e2e_ms") > F.col("q3") + reach))


# Order within a run

def fifo_batches(requests: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Number requests into batches of at most ``batch_size`` per (run, adapter), in arrival order."""
    numbered = number_rows(
        adapter_id_from_path(requests), ["run_id", "adapter_id"], ["submission_us", "request_id"], "__no")
    return numbered.withColumns({
        "batch": F.floor((F.col("__no") - 1) / batch_size),
        "pos": (F.col("__no") - 1) % batch_size,
    }).drop("__no")


BATCH_KEYS = ("run_id", "adapter_id", "batch")


def group_params(batched: DataFrame) -> DataFrame:
    """Parameters of each batch: those of its first request, defaults filled in."""
    filled = fill_request_params(batched)
    return (
        filled.groupBy(*BATCH_KEYS)
        .agg(F.min_by("generation_params", "pos").alias("params"))
        .select(*BATCH_KEYS, "params.*")
    )


def batch_outcomes(batched: DataFrame, results: DataFrame) -> DataFrame:
    """Size, outcomes and busy seconds of each executed batch."""
    done = correlate_requests(batched, results).filter(F.col("state") != "UNANSWERED")
    span = elapsed_s(F.min("processing_start_us"), F.max("processing_end_us"))
    return done.groupBy(*BATCH_KEYS).agg(
        F.count(F.lit(1)).alias("size"),
        F.count_if(F.col("state") == "OK").alias("successes"),
        F.count_if(F.col("state") == "FAILED").alias("failures"),
        span.alias("busy_s"),
    )


def completion_order(results: DataFrame, origin_us: Column) -> DataFrame:
    """Successful completions by time since ``origin_us``, earliest first."""
    done = results.filter(success() & F.col("processing_end_us").isNotNull()
                          & F.col("submission_us").isNotNull())
    return done.select(
        "run_id", "request_id", elapsed_s(origin_us, F.col("processing_end_us")).alias("completed_s"),
    ).orderBy("completed_s", "request_id")


def cumulative_success(results: DataFrame, origin_us: Column) -> DataFrame:
    """Running count of successes per run by completion time, from a (0, 0) point."""
    done = results.filter(success() & F.col("processing_end_us").isNotNull()
                          & F.col("submission_us").isNotNull())
    counted = number_rows(
        done.select("run_id", "request_id", "processing_end_us"),
        ["run_id"], ["processing_end_us", "request_id"], "successes")
    points = counted.select(
        "run_id", elapsed_s(origin_us, F.col("processing_end_us")).alias("at_s"), "successes")
    start = done.select("run_id").distinct().select(
        "run_id", F.lit(0.0).alias("at_s"), F.lit(0).cast("bigint").alias("successes"))
    return start.unionByName(points)


def queue_depth(results: DataFrame) -> DataFrame:
    """Waiting requests after each arrival (+1) and each start (-1) per run.

    Requests that never started leave at their end time.  An arrival comes before
    a start at the same time.
    """
    leaves = F.coalesce("processing_start_us", "processing_end_us")
    changes = results.select("run_id", "request_id", F.explode(F.array(
        F.struct(F.col("submission_us").alias("ts_us"), F.lit(1).cast("bigint").alias("change")),
        F.struct(leaves.alias("ts_us"), F.lit(-1).cast("bigint").alias("change")),
    )).alias("step")).select("run_id", "request_id", "step.*").filter(F.col("ts_us").isNotNull())
    return running_sums(
        changes, ["run_id"], ["ts_us", F.col("change").desc(), "request_id"], {"depth": F.col("change")})


# Sets

def union_results(parts: Mapping[str, DataFrame]) -> DataFrame:
    """All rows of all parts, each tagged with its ``source``; absent columns are null."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in parts.items()]
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


