"""One runnable query per operator, with an independent DuckDB query to check it.

``QUERIES`` maps a name to a function of ``Tables``; ``ORACLES`` maps the same name
to SQL.  Doubles are rounded to 6 places and integers widened on the Spark side so
that both engines print the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions.text import WHITE_SPACE
from runledger.operators import (
    adapters, comparison, examples, inference, jobs, progress, ranking, requests, submissions,
)
from runledger.plans import derived
from runledger.plans.bindings import DAY_US, STRATEGIES, Tables, with_tables
from runledger.plans.summary import run_bounds, run_summary
from runledger.sources.bucketed import JOB_KEYS, REQUEST_KEYS

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def r6(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0"


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda t: comparable(fn(t))
        if sql is not None:
            ORACLES[name] = with_tables(sql, *tables)
        return fn

    return register


# Submissions

@query("split_submissions", """
SELECT run_id, seq, CASE event_type WHEN 'TRAIN_JOB' THEN 'job' WHEN 'INFERENCE_REQ' THEN 'request'
  ELSE 'unknown' END AS kind FROM submissions""", ("submissions",))
def _(t):
    routed = submissions.split_submissions(t.submissions())
    return requests.union_results(
        {"job": routed.jobs, "request": routed.requests, "unknown": routed.unknown}
    ).select("run_id", "seq", F.col("source").alias("kind"))


@query("explode_job_samples", """
SELECT run_id, job_id, seq, i - 1 AS sample_idx, dataset_samples[i] AS text FROM (
  SELECT *, unnest(range(1, len(dataset_samples) + 1)) AS i FROM submissions
  WHERE event_type = 'TRAIN_JOB' AND dataset_samples IS NOT NULL)""", ("submissions",))
def _(t):
    return submissions.explode_job_samples(submissions.split_submissions(t.submissions()).jobs)


@query("fill_job_defaults", f"""
SELECT run_id, seq, coalesce(nullif(adapter_save_path, ''), './adapters/job_' || job_id) AS adapter_save_path,
  coalesce(batch_size, 1) AS batch_size, {r6('coalesce(lr, 5e-5)')} AS lr
FROM submissions WHERE event_type = 'TRAIN_JOB'""", ("submissions",))
def _(t):
    filled = submissions.fill_job_defaults(submissions.split_submissions(t.submissions()).jobs)
    return filled.select("run_id", "seq", "adapter_save_path", "batch_size", "lr")


@query("validate_submissions", """
SELECT run_id, seq, 'rejected' AS verdict, 'job_id missing' AS reason, NULL AS status
FROM submissions WHERE event_type = 'TRAIN_JOB' AND coalesce(job_id, '') = ''
UNION ALL
SELECT run_id, seq, 'accepted',
  CASE WHEN coalesce(len(dataset_samples), 0) = 0 THEN 'Missing or invalid dataset_samples' END,
  CASE WHEN coalesce(len(dataset_samples), 0) = 0 THEN 'FAILED' ELSE 'ACTIVE' END
FROM submissions WHERE event_type = 'TRAIN_JOB' AND coalesce(job_id, '') <> ''""", ("submissions",))
def _(t):
    accepted, rejected = submissions.validate_submissions(
        submissions.split_submissions(t.submissions()).jobs)
    return requests.union_results({
        "accepted": accepted.select("run_id", "seq", F.col("error_message").alias("reason"), "status"),
        "rejected": rejected.select("run_id", "seq", F.col("reject_reason").alias("reason")),
    }).withColumnRenamed("source", "verdict")


@query("first_registration", """
SELECT run_id, job_id, min(seq) AS seq, arg_min(submitted_us, seq) AS submitted_us,
  arg_min(batch_size, seq) FILTER (WHERE seq = lowest) AS batch_size, count(*) - 1 AS duplicates
FROM (SELECT *, min(seq) OVER (PARTITION BY run_id, job_id) AS lowest FROM submissions
      WHERE event_type = 'TRAIN_JOB' AND coalesce(job_id, '') <> '')
GROUP BY run_id, job_id""", ("submissions",))
def _(t):
    accepted, _ = submissions.validate_submissions(submissions.split_submissions(t.submissions()).jobs)
    return submissions.first_registration(accepted).select(
        "run_id", "job_id", "seq", "submitted_us", "batch_size", "duplicates")


@query("admission_cap", f"""
SELECT run_id, seq, event_type, day,
  CASE WHEN row_number() OVER (PARTITION BY event_type, run_id, day ORDER BY submitted_us, seq)
    <= CASE event_type WHEN 'TRAIN_JOB' THEN 10 ELSE 100 END THEN 'accepted' ELSE 'rejected' END AS admission
FROM (SELECT *, submitted_us // {DAY_US} AS day FROM submissions
      WHERE event_type IN ('TRAIN_JOB', 'INFERENCE_REQ'))""", ("submissions",))
def _(t):
    daily = t.submissions().withColumn("day", F.floor(F.col("submitted_us") / DAY_US))
    routed = submissions.split_submissions(daily)
    capped = submissions.admission_cap(routed.jobs, "day", submissions.JOB_QUOTA).unionByName(
        submissions.admission_cap(routed.requests, "day", submissions.REQUEST_QUOTA))
    return capped.select("run_id", "seq", "event_type", "day", "admission")


# Requests and results, row by row

@query("flag_success", """
SELECT run_id, request_id, error IS NULL AND output IS NOT NULL AS success FROM results""", ("results",))
def _(t):
    return requests.flag_success(t.results()).select("run_id", "request_id", "success")


@query("request_latency", f"""
SELECT r.run_id, r.request_id, {r6('e2e_ms')} AS e2e_ms, {r6('proc_ms')} AS proc_ms
FROM results r LEFT JOIN latencies l USING (run_id, request_id)""", ("results", "latencies"))
def _(t):
    return requests.request_latency(t.results()).select("run_id", "request_id", "e2e_ms", "proc_ms")


@query("adapter_id_from_path", "SELECT run_id, request_id, adapter_id FROM store_ids", ("store_ids",))
def _(t):
    return requests.adapter_id_from_path(t.store_requests()).select("run_id", "request_id", "adapter_id")


@query("fill_request_params", f"""
SELECT run_id, request_id, coalesce(max_new_tokens, 50) AS max_new_tokens,
  {r6('coalesce(temperature, 0.7)')} AS temperature, coalesce(do_sample, true) AS do_sample
FROM requests""", ("requests",))
def _(t):
    return requests.fill_request_params(t.requests()).select("run_id", "request_id", "generation_params.*")


def _decoded(t: Tables) -> DataFrame:
    whole = F.concat("prompt", F.lit(" "), "reply")
    return requests.turn_pairs(t.raw("conversations")).withColumn(
        "decoded", F.when(F.col("conv_id") % 2 == 0, whole).otherwise(F.col("reply")))


@query("strip_prompt", f"""
SELECT conv_id, turn, trim(CASE WHEN length(decoded) > length(prompt)
  THEN substr(decoded, length(prompt) + 1) ELSE decoded END, '{WHITE_SPACE}') AS output
FROM (SELECT *, CASE WHEN conv_id % 2 = 0 THEN prompt || ' ' || reply ELSE reply END AS decoded FROM turns)
""", ("turns",))
def _(t):
    return requests.strip_prompts(_decoded(t)).select("conv_id", "turn", "output")


@query("turn_pairs", "SELECT conv_id, turn, prompt, reply FROM turns", ("turns",))
def _(t):
    return requests.turn_pairs(t.raw("conversations"))


@query("label_lookup", """
SELECT event_id, user_id % 30 AS code, coalesce(n_name, CAST(user_id % 30 AS VARCHAR)) AS label
FROM events LEFT JOIN nation ON n_nationkey = user_id % 30""")
def _(t):
    labels = t.raw("nation").select(F.col("n_nationkey").cast("bigint").alias("code"),
                                    F.col("n_name").alias("label"))
    coded = t.raw("events").select("event_id", (F.col("user_id") % 30).alias("code"))
    return comparison.label_lookup(coded, "code", labels).select("event_id", "code", "label")


@query("correlate_requests", """
SELECT q.run_id, q.request_id, r.output, r.error, CASE WHEN r.request_id IS NULL THEN 'UNANSWERED'
  WHEN r.error IS NULL AND r.output IS NOT NULL THEN 'OK' ELSE 'FAILED' END AS state
FROM requests q LEFT JOIN (SELECT * FROM results WHERE output IS DISTINCT FROM 'signup') r
  USING (run_id, request_id)""", ("requests", "results"))
def _(t):
    answered = t.results().filter(~F.col("output").eqNullSafe("signup"))
    return requests.correlate_requests(t.requests(), answered).select(
        "run_id", "request_id", "output", "error", "state")


@query("route_requests", """
SELECT run_id, request_id, q.adapter_id,
  CASE WHEN adapter_path IS NOT NULL AND NOT coalesce(has_config AND has_weights, false)
    THEN 'Failed to load adapter ''' || q.adapter_id || '''' END AS route_error
FROM store_ids q LEFT JOIN catalogue c USING (adapter_id)""", ("store_ids", "catalogue"))
def _(t):
    catalogue = adapters.adapter_completeness(t.adapter_files())
    return requests.route_requests(t.store_requests(), catalogue).select(
        "run_id", "request_id", "adapter_id", "route_error")


# Request aggregates

@query("requests_by_adapter", """
SELECT run_id, adapter_id, count(*) AS requests FROM request_ids GROUP BY ALL""", ("request_ids",))
def _(t):
    return requests.requests_by_adapter(t.requests())


_OUTCOMES = """count(*) AS total, count(*) FILTER (WHERE error IS NULL AND output IS NOT NULL) AS successful,
  count(*) FILTER (WHERE NOT (error IS NULL AND output IS NOT NULL)) AS failed"""


@query("request_outcomes", f"SELECT run_id, {_OUTCOMES} FROM results GROUP BY run_id", ("results",))
def _(t):
    return requests.request_outcomes(t.results())


_LATENCY = ", ".join(
    [f"{r6(f'avg({kind}_ms)')} AS {kind}_avg_ms" for kind in ("e2e", "proc")]
    + [f"{r6(f'quantile_cont({kind}_ms, {p})')} AS {kind}_{name}_ms"
       for kind in ("e2e", "proc") for name, p in requests.REPORTED.items()])


@query("latency_summary", f"""
SELECT run_id, {_LATENCY} FROM (
  SELECT r.run_id, e2e_ms, proc_ms FROM results r LEFT JOIN latencies l USING (run_id, request_id))
GROUP BY run_id""", ("results", "latencies"))
def _(t):
    return requests.latency_summary(t.results())


@query("sketched_latency", """
SELECT run_id, count(e2e_ms) AS e2e_n, count(proc_ms) AS proc_n, true AS e2e_p50_near, true AS e2e_p95_near, true AS e2e_p99_near,
  true AS proc_p50_near, true AS proc_p95_near, true AS proc_p99_near
FROM (SELECT r.run_id, e2e_ms, proc_ms FROM results r LEFT JOIN latencies l USING (run_id, request_id))
GROUP BY run_id""", ("results", "latencies"))
def _(t):
    return derived.sketched_latency(t)


_THROUGHPUT = """count(*) FILTER (WHERE error IS NULL AND output IS NOT NULL)
  / ((max(processing_end_us) - min(submission_us)) / 1e6)"""


@query("throughput", f"""
SELECT run_id, {r6(_THROUGHPUT)} AS throughput FROM strategy_results GROUP BY run_id""", ("strategy_results",))
def _(t):
    return requests.throughput(t.strategy_results(), run_bounds(t.strategy_results()))


@query("latency_box", f"""
SELECT run_id, {r6('any_value(q1)')} AS q1, {r6('any_value(median)')} AS median, {r6('any_value(q3)')} AS q3,
  {r6('min(e2e_ms) FILTER (WHERE inside)')} AS whisker_low,
  {r6('max(e2e_ms) FILTER (WHERE inside)')} AS whisker_high,
  count(*) FILTER (WHERE NOT inside) AS outliers
FROM (
  SELECT *, e2e_ms >= q1 - 1.5 * (q3 - q1) AND e2e_ms <= q3 + 1.5 * (q3 - q1) AS inside
  FROM latencies JOIN (
    SELECT run_id, quantile_cont(e2e_ms, 0.25) AS q1, quantile_cont(e2e_ms, 0.5) AS median,
      quantile_cont(e2e_ms, 0.75) AS q3 FROM latencies GROUP BY run_id) USING (run_id))
GROUP BY run_id""", ("latencies",))
def _(t):
    return requests.latency_box(t.results())


@query("latency_outliers", f"""
SELECT run_id, request_id, {r6('e2e_ms')} AS e2e_ms
FROM latencies JOIN (
  SELECT run_id, quantile_cont(e2e_ms, 0.25) AS q1, quantile_cont(e2e_ms, 0.75) AS q3
  FROM latencies GROUP BY run_id) USING (run_id)
WHERE e2e_ms < q1 - 1.5 * (q3 - q1) OR e2e_ms > q3 + 1.5 * (q3 - q1)""", ("latencies",))
def _(t):
    return requests.latency_outliers(t.results())


@query("batch_outcomes", f"""
SELECT b.run_id, adapter_id, batch, count(*) AS size,
  count(*) FILTER (WHERE r.error IS NULL AND r.output IS NOT NULL) AS successes,
  count(*) FILTER (WHERE NOT (r.error IS NULL AND r.output IS NOT NULL)) AS failures,
  {r6('(max(r.processing_end_us) - min(r.processing_start_us)) / 1e6')} AS busy_s
FROM batched b JOIN results r USING (run_id, request_id) GROUP BY b.run_id, adapter_id, batch""",
       ("batched", "results"))
def _(t):
    return requests.batch_outcomes(requests.fifo_batches(t.requests()), t.results())


@query("union_results", """
SELECT 'events' AS source, run_id, request_id, submission_us, output, error FROM results
UNION ALL
SELECT 'turns', 'turns', conv_id || '-' || turn, NULL, reply, NULL FROM turns""", ("results", "turns"))
def _(t):
    pairs = requests.turn_pairs(t.raw("conversations")).select(
        F.lit("turns").alias("run_id"), F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.col("reply").alias("output"))
    return requests.union_results({"events": t.results(), "turns": pairs}).select(
        "source", "run_id", "request_id", "submission_us", "output", "error")


# Order within a run

@query("completion_order", f"""
SELECT run_id, request_id,
  {r6('(processing_end_us - (SELECT min(start_us) FROM timed)) / 1e6')} AS completed_s
FROM latencies""", ("timed", "latencies"))
def _(t):
    return requests.completion_order(t.results(), jobs.earliest_start(t.jobs()))


@query("cumulative_success", f"""
SELECT run_id, {r6('(processing_end_us - (SELECT min(start_us) FROM timed)) / 1e6')} AS at_s,
  row_number() OVER (PARTITION BY run_id ORDER BY processing_end_us, request_id) AS successes
FROM latencies
UNION ALL SELECT DISTINCT run_id, 0.0, 0 FROM latencies""", ("timed", "latencies"))
def _(t):
    return requests.cumulative_success(t.results(), jobs.earliest_start(t.jobs()))


@query("fifo_batches", """
SELECT run_id, adapter_id, request_id, batch, pos FROM batched""", ("batched",))
def _(t):
    return requests.fifo_batches(t.requests()).select("run_id", "adapter_id", "request_id", "batch", "pos")


@query("group_params", f"""
SELECT run_id, adapter_id, batch, coalesce(max_new_tokens, 50) AS max_new_tokens,
  {r6('coalesce(temperature, 0.7)')} AS temperature, coalesce(do_sample, true) AS do_sample
FROM batched WHERE pos = 0""", ("batched",))
def _(t):
    return requests.group_params(requests.fifo_batches(t.requests()))


@query("queue_depth", """
SELECT run_id, request_id, ts_us, change, CAST(sum(change) OVER (
  PARTITION BY run_id ORDER BY ts_us, change DESC, request_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth
FROM (
  SELECT run_id, request_id, submission_us AS ts_us, CAST(1 AS BIGINT) AS change FROM results
  UNION ALL
  SELECT run_id, request_id, coalesce(processing_start_us, processing_end_us), -1 FROM results)""",
       ("results",))
def _(t):
    return requests.queue_depth(t.results())


# Jobs

@query("runnable_jobs", """
SELECT run_id, job_id FROM jobs WHERE status IN ('ACTIVE', 'PENDING')""", ("jobs",))
def _(t):
    return jobs.runnable_jobs(t.jobs()).select("run_id", "job_id")


@query("is_complete", """
SELECT run_id, job_id, current_step, max_steps FROM jobs
WHERE max_steps IS NOT NULL AND current_step >= max_steps""", ("jobs",))
def _(t):
    return jobs.completed_steps(t.jobs()).select("run_id", "job_id", "current_step", "max_steps")


@query("expected_vs_actual_jobs", "SELECT * FROM outcome", ("outcome",))
def _(t):
    return jobs.expected_vs_actual_jobs(t.expected(), t.seen_jobs()).select(
        "run_id", "job_id", "status", "start_us", "end_us", "current_step")


@query("strategy_job_grid", f"""
SELECT s.strategy, e.job_id, coalesce(d.start_us, 0) AS start_us,
  {r6('coalesce(d.duration_s, 0)')} AS duration_s, d.job_id IS NULL AS missing
FROM (SELECT DISTINCT job_id FROM expected) e
  CROSS JOIN (SELECT DISTINCT o_orderpriority AS strategy FROM orders) s
  LEFT JOIN timed d ON d.job_id = e.job_id AND d.strategy = s.strategy""", ("expected", "timed"))
def _(t):
    return jobs.strategy_job_grid(t.expected(), t.jobs(), STRATEGIES)


@query("prepared_runnable", """
SELECT run_id, job_id FROM jobs SEMI JOIN prepared USING (run_id, job_id) WHERE status = 'ACTIVE'
""", ("jobs", "prepared"))
def _(t):
    return jobs.prepared_runnable(t.jobs(), t.prepared()).select("run_id", "job_id")


@query("runnable_unprepared", """
SELECT run_id, job_id FROM jobs ANTI JOIN prepared USING (run_id, job_id) WHERE status = 'ACTIVE'
""", ("jobs", "prepared"))
def _(t):
    return jobs.runnable_unprepared(t.jobs(), t.prepared()).select("run_id", "job_id")


_TIMELINE = f"""
SELECT run_id, job_id, reg_seq, {r6('(start_us - (SELECT min(start_us) FROM timed)) / 1e6')} AS start_s,
  {r6('(end_us - (SELECT min(start_us) FROM timed)) / 1e6')} AS end_s, {r6('duration_s')} AS duration_s
FROM timed"""


@query("relative_timeline", _TIMELINE, ("timed",))
def _(t):
    return jobs.relative_timeline(t.jobs(), expected=t.expected())


@query("relative_timeline_per_run", f"""
SELECT run_id, job_id, reg_seq, {r6('(start_us - first) / 1e6')} AS start_s, {r6('(end_us - first) / 1e6')} AS end_s,
  {r6('duration_s')} AS duration_s
FROM (SELECT *, min(start_us) OVER (PARTITION BY run_id) AS first FROM timed)""", ("timed",))
def _(t):
    return jobs.relative_timeline(t.jobs(), per_run=True)


@query("job_gantt", f"""
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY start_s, reg_seq) - 1 AS lane,
  job_id, start_s, end_s, duration_s FROM ({_TIMELINE})""", ("timed",))
def _(t):
    return jobs.job_gantt(t.jobs())


def _outcome(t: Tables) -> DataFrame:
    return jobs.expected_vs_actual_jobs(t.expected(), t.seen_jobs())


_STATUS_COUNTS = """count(*) AS expected_jobs, count(*) FILTER (WHERE status = 'COMPLETED') AS completed_jobs,
  count(*) FILTER (WHERE status = 'FAILED') AS failed_jobs"""
_MAKESPAN = r6("(max(end_us) - min(start_us)) / 1e6") + " AS makespan_s"
_COMPLETION = (r6("avg((end_us - start_us) / 1e6)") + " AS completion_avg_s, "
               + r6("stddev_pop((end_us - start_us) / 1e6)") + " AS completion_stddev_s")


@query("job_status_counts", f"SELECT run_id, {_STATUS_COUNTS} FROM outcome GROUP BY run_id", ("outcome",))
def _(t):
    return jobs.job_status_counts(_outcome(t))


@query("makespan", f"SELECT run_id, {_MAKESPAN} FROM outcome GROUP BY run_id", ("outcome",))
def _(t):
    return jobs.makespan(_outcome(t))


@query("completion_stats", f"SELECT run_id, {_COMPLETION} FROM outcome GROUP BY run_id", ("outcome",))
def _(t):
    return jobs.completion_stats(_outcome(t))


@query("run_finished", """
SELECT run_id, bool_and(status <> 'NOT_FOUND') AS all_seen,
  bool_and(status IN ('COMPLETED', 'FAILED')) AS finished FROM outcome GROUP BY run_id""", ("outcome",))
def _(t):
    return jobs.run_finished(t.expected(), t.seen_jobs())


_SUMMARY = f"""
SELECT run_id, {_STATUS_COUNTS}, {_MAKESPAN}, {_COMPLETION}, any_value(total) AS total,
  any_value(successful) AS successful, any_value(failed) AS failed,
  {', '.join(f'any_value({c}) AS {c}' for c in (
      'e2e_avg_ms', 'e2e_p50_ms', 'e2e_p95_ms', 'e2e_p99_ms',
      'proc_avg_ms', 'proc_p50_ms', 'proc_p95_ms', 'proc_p99_ms', 'throughput'))}
FROM outcome LEFT JOIN (
  SELECT run_id, {_OUTCOMES}, {r6(_THROUGHPUT)} AS throughput FROM strategy_results GROUP BY run_id
) USING (run_id) LEFT JOIN (
  SELECT run_id, {_LATENCY} FROM (
    SELECT run_id, (processing_end_us - submission_us) / 1000.0 AS e2e_ms,
      (processing_end_us - processing_start_us) / 1000.0 AS proc_ms
    FROM strategy_results WHERE error IS NULL AND output IS NOT NULL) GROUP BY run_id
) USING (run_id)
GROUP BY run_id"""


def _summary(t: Tables) -> DataFrame:
    return run_summary(t.expected(), t.seen_jobs(), t.strategy_results())


@query("run_summary", _SUMMARY, ("outcome", "strategy_results"))
def _(t):
    return _summary(t)


@query("strategy_comparison", "".join(
    f"""{'UNION ALL' if i else ''} SELECT '{label}' AS metric, {', '.join(
        f"coalesce(max(CASE WHEN run_id = '{s}' THEN {column} END), 0) AS " + f'"{s}"' for s in STRATEGIES)}
    FROM ({_SUMMARY}) """
    for i, (label, column) in enumerate(comparison.COMPARED.items())), ("outcome", "strategy_results"))
def _(t):
    return comparison.strategy_comparison(_summary(t), STRATEGIES, key="run_id")


@query("job_durations", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS job, {', '.join(
    r6(f"coalesce(max(duration_s) FILTER (WHERE strategy = '{s}'), 0)") + f' AS "{s}"' for s in STRATEGIES)}
FROM orders LEFT JOIN timed ON job_id = CAST(o_orderkey AS VARCHAR) GROUP BY o_orderkey""", ("timed",))
def _(t):
    named = F.concat(F.lit("scenario_train_"), F.col("job_id"))
    return comparison.job_durations(
        t.expected().withColumn("job_id", named), t.jobs().withColumn("job_id", named),
        STRATEGIES, "scenario_train_")


@query("job_rollup", "SELECT * FROM rolled_jobs", ("rolled_jobs",))
def _(t):
    return t.rolled_jobs()


@query("loss_history", """
SELECT run_id, job_id, block, string_agg(printf('%.2f', loss), ' ' ORDER BY no) AS losses,
  last(loss ORDER BY no) AS last_loss, max(no) AS losses_so_far
FROM (SELECT *, (no - 1) // 1000 AS block FROM (
  SELECT run_id, job_id, TRY_CAST(loss_raw AS DOUBLE) AS loss,
    row_number() OVER (PARTITION BY run_id, job_id ORDER BY ts_us, event_seq) AS no
  FROM own_events WHERE TRY_CAST(loss_raw AS DOUBLE) IS NOT NULL))
GROUP BY run_id, job_id, block""", ("own_events",))
def _(t):
    history = jobs.loss_history(t.job_events(), t.registrations())
    return history.withColumn("losses", F.array_join(
        F.transform("losses", lambda loss: F.format_string("%.2f", loss)), " "))


_STEPS = """
SELECT run_id, job_id, ts_us, event_seq, step,
  CASE WHEN per_epoch > 0 THEN (step - 1) // per_epoch END AS epoch,
  coalesce(step >= max_steps AND NOT (step - 1 >= max_steps AND step > 1), false) AS is_completion,
  coalesce(step - 1 >= max_steps AND step > 1, false) AS is_surplus
FROM (
  SELECT *, CAST(sum(step_increment) OVER (PARTITION BY run_id, job_id ORDER BY ts_us, event_seq
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS step,
    CAST(ceil(n_samples / batch_size) AS BIGINT) AS per_epoch
  FROM own_events JOIN job_limits USING (run_id, job_id) WHERE step_increment > 0)"""


@query("step_progress", _STEPS, ("own_events", "job_limits"))
def _(t):
    return jobs.step_progress(t.job_events(), t.job_limits(), t.registrations())


@query("step_completion", f"""
SELECT run_id, job_id, ts_us AS completed_us, step AS final_step FROM ({_STEPS}) WHERE is_completion
""", ("own_events", "job_limits"))
def _(t):
    return jobs.step_completion(t.job_events(), t.job_limits(), t.registrations())


# Two moments between which the active set changes (1996-01-01 and 1996-01-05).
_BEFORE, _AFTER = 820_454_400_000_000, 820_800_000_000_000
_ACTIVE_AT = """SELECT run_id, job_id FROM jobs
  WHERE start_us <= {0} AND (end_us IS NULL OR end_us > {0})"""


@query("active_set_changes", f"""
SELECT run_id, job_id, CASE WHEN old IS NULL THEN 'added' ELSE 'removed' END AS change
FROM (SELECT *, true AS old FROM ({_ACTIVE_AT.format(_BEFORE)}))
  FULL JOIN (SELECT *, true AS new FROM ({_ACTIVE_AT.format(_AFTER)})) USING (run_id, job_id)
WHERE old IS NULL OR new IS NULL""", ("jobs",))
def _(t):
    return jobs.active_set_changes(t.active_at(_BEFORE), t.active_at(_AFTER))


@query("active_set_changed", f"""
SELECT run_id, bool_or(old IS NULL OR new IS NULL) AS changed
FROM (SELECT *, true AS old FROM ({_ACTIVE_AT.format(_BEFORE)}))
  FULL JOIN (SELECT *, true AS new FROM ({_ACTIVE_AT.format(_AFTER)})) USING (run_id, job_id)
GROUP BY run_id""", ("jobs",))
def _(t):
    return jobs.active_set_changed(t.active_at(_BEFORE), t.active_at(_AFTER))


@query("pending_jobs", """
SELECT run_id, job_id FROM expected ANTI JOIN (
  SELECT * FROM seen_jobs WHERE status IN ('COMPLETED', 'FAILED')) USING (run_id, job_id)
""", ("expected", "seen_jobs"))
def _(t):
    return jobs.pending_jobs(t.expected(), t.seen_jobs())


# Progress and ranking

@query("parse_loss", """
SELECT run_id, job_id, ts_us, event_seq, loss FROM history WHERE NOT done""", ("history",))
def _(t):
    return progress.parse_losses(t.job_events())


@query("loss_delta", f"""
SELECT run_id, job_id, ts_us, event_seq, loss,
  {r6('lag(loss) OVER (PARTITION BY run_id, job_id ORDER BY ts_us, event_seq) - loss')} AS delta
FROM history WHERE NOT done""", ("history",))
def _(t):
    return progress.loss_delta(progress.parse_losses(t.job_events()))


_ROLLING = f"""
SELECT run_id, job_id, ts_us, event_seq, history_size, {r6('round(rate, 12)')} AS rate FROM (
  SELECT *, count(*) OVER (last ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS history_size,
    avg(delta) OVER (last ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS rate
  FROM (
    SELECT *, lag(loss) OVER last - loss AS delta FROM segments WHERE NOT done
    WINDOW last AS (PARTITION BY run_id, job_id, segment ORDER BY ts_us, event_seq))
  WINDOW last AS (PARTITION BY run_id, job_id, segment ORDER BY ts_us, event_seq))"""


@query("rolling_progress", _ROLLING, ("segments",))
def _(t):
    return progress.rolling_progress(t.job_events()).drop("loss", "segment")


@query("progress_rate", f"""
SELECT run_id, job_id, history_size, last_loss, {r6('rate')} AS rate FROM progress""", ("progress",))
def _(t):
    return progress.progress_rate(t.job_events())


@query("classify_progress", f"""
SELECT run_id, job_id, {r6('rate')} AS rate, forward_class, reverse_class FROM classified""", ("classified",))
def _(t):
    return progress.classify_progress(t.active_jobs(), progress.progress_rate(t.job_events())).select(
        "run_id", "job_id", "rate", "forward_class", "reverse_class")


@query("interleave_jobs", """
SELECT run_id, job_id, event_seq, row_number() OVER (
  PARTITION BY run_id, job_id ORDER BY ts_us, event_seq) AS turn
FROM job_events WHERE step_increment > 0""", ("job_events",))
def _(t):
    steps = t.job_events().filter(F.col("step_increment") > 0)
    return progress.interleave_jobs(steps, ["ts_us", "event_seq"]).select(
        "run_id", "job_id", "event_seq", "turn")


def _ranked_sql(table: str, score: str, order: str, where: str = "true") -> str:
    return f"""
SELECT run_id, rank, job_id, {r6(score)} AS score, false AS is_fallback FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {order}) AS rank FROM {table} WHERE {where})
WHERE rank <= 3"""


def _fallback_sql(wanted: str, among: str) -> str:
    return f"""
UNION ALL SELECT run_id, 1, min(job_id) FILTER (WHERE {among}), NULL, true
FROM classified GROUP BY run_id HAVING NOT bool_or({wanted}) AND count(*) FILTER (WHERE {among}) > 0"""


_RANKED = {
    "RoundRobin": _ranked_sql("active_jobs", "NULL", "job_id"),
    "LeastProgressFirst": _ranked_sql("active_jobs", "current_step", "current_step, reg_seq"),
    "ForwardStagnationAware":
        _ranked_sql("classified", "rate", "rate DESC, reg_seq", "forward_class = 'progressing'")
        + _fallback_sql("forward_class = 'progressing'", "true"),
    "ReverseStagnationAware":
        _ranked_sql("classified", "rate", "rate, reg_seq", "reverse_class = 'struggling'")
        + _fallback_sql("reverse_class = 'struggling'", "reverse_class <> 'struggling'"),
}


@query("rank_least_progress", _RANKED["LeastProgressFirst"], ("active_jobs",))
def _(t):
    return ranking.rank_least_progress(t.active_jobs(), k=3)


@query("rank_forward", _RANKED["ForwardStagnationAware"], ("classified",))
def _(t):
    return ranking.rank_forward(t.active_jobs(), progress.progress_rate(t.job_events()), k=3)


@query("rank_reverse", _RANKED["ReverseStagnationAware"], ("classified",))
def _(t):
    return ranking.rank_reverse(t.active_jobs(), progress.progress_rate(t.job_events()), k=3)


@query("first_by_id", """
SELECT run_id, 1 AS rank, min(job_id) AS job_id FROM jobs WHERE status = 'ACTIVE' GROUP BY run_id""", ("jobs",))
def _(t):
    return ranking.first_by_id(jobs.runnable_jobs(t.jobs())).select("run_id", "rank", "job_id")


@query("ranking_registry", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS policy, * FROM ({sql})" for name, sql in _RANKED.items()),
       ("active_jobs", "classified"))
def _(t):
    active, rates = t.active_jobs(), progress.progress_rate(t.job_events())
    return requests.union_results(
        {name: ranking.rank_jobs(name, active, rates, k=3) for name in _RANKED}
    ).withColumnRenamed("source", "policy")


# Training examples

_JOINED = "array_to_string(list_transform({0}, lambda i: CAST(i AS VARCHAR)), ' ')"


@query("encode_samples", f"""
SELECT job_id, sample_idx,
  {_JOINED.format('list_concat(pad, ids)')} AS input_ids,
  {_JOINED.format('list_concat(pad, list_transform(ids, lambda i: 1))')} AS attention_mask,
  {_JOINED.format('list_transform(list_concat(pad, ids), lambda i: CASE WHEN i = 0 THEN -100 ELSE i END)')}
    AS labels
FROM (
  SELECT *, list_transform(range(0, 128 - len(ids)), lambda i: CAST(0 AS BIGINT)) AS pad FROM (
    SELECT job_id, sample_idx, list_transform(words[1:128],
      lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 32000) AS ids FROM tokens))""", ("tokens",))
def _(t):
    encoded = examples.encode_samples(t.samples())
    arrays = ("input_ids", "attention_mask", "labels")
    return encoded.withColumns({a: F.array_join(F.col(a).cast("array<string>"), " ") for a in arrays})


@query("upsample_cyclic", """
SELECT job_id, position, sample_idx, text FROM (
  SELECT job_id, n, unnest(range(0, 70)) AS position FROM (
    SELECT job_id, count(*) AS n FROM samples GROUP BY job_id))
JOIN samples s USING (job_id) WHERE s.sample_idx = position % n""", ("samples",))
def _(t):
    return examples.upsample_cyclic(t.samples(), 70)


@query("shuffle_batches", """
SELECT job_id, epoch, (no - 1) // 8 AS batch, (no - 1) % 8 AS pos, sample_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, epoch
    ORDER BY md5(job_id || '|' || epoch || '|' || sample_idx || '|42'), sample_idx) AS no
  FROM (SELECT job_id, sample_idx, unnest(range(0, 3)) AS epoch FROM samples))""", ("samples",))
def _(t):
    return examples.shuffle_batches(t.samples(), epochs=3, batch_size=8, seed=42)


@query("sample_stats", """
SELECT job_id, n_samples, n_batches, greatest(max_steps - current_step, 0) AS steps_left,
  CASE WHEN n_batches > 0 THEN CAST(ceil(max_steps / n_batches) AS BIGINT) END AS epochs_needed,
  n_samples = 0 AS empty_dataset
FROM (
  SELECT *, CAST(ceil(n_samples / batch_size) AS BIGINT) AS n_batches FROM (
    SELECT j.*, count(s.sample_idx) AS n_samples FROM sample_jobs j LEFT JOIN samples s USING (job_id)
    GROUP BY ALL))""", ("sample_jobs", "samples"))
def _(t):
    return examples.sample_stats(t.samples(), t.sample_jobs())


@query("truncation_report", """
SELECT job_id, count(*) AS samples, CAST(sum(least(n, 128)) AS BIGINT) AS kept,
  CAST(sum(greatest(n - 128, 0)) AS BIGINT) AS cut, CAST(sum(greatest(128 - n, 0)) AS BIGINT) AS padded,
  count(*) FILTER (WHERE n > 128) AS truncated_samples
FROM (SELECT job_id, len(words) AS n FROM tokens) GROUP BY job_id""", ("tokens",))
def _(t):
    return examples.truncation_report(t.samples())


# Adapter store

@query("adapter_completeness", """
SELECT *, has_config AND has_weights AS servable, has_config AND has_weights AND has_optimizer AS resumable,
  NOT has_config AS first_run FROM catalogue""", ("catalogue",))
def _(t):
    return adapters.adapter_completeness(t.adapter_files())


@query("adapter_demand", """
SELECT adapter_id, coalesce(n, 0) AS requests, has_config IS NOT NULL AS stored,
  n IS NOT NULL AND NOT coalesce(has_config AND has_weights, false) AS requested_unservable,
  n IS NULL AS stored_unused
FROM catalogue FULL JOIN (
  SELECT adapter_id, count(*) AS n FROM store_ids WHERE adapter_path IS NOT NULL GROUP BY adapter_id
) USING (adapter_id)""", ("catalogue", "store_ids"))
def _(t):
    return adapters.adapter_demand(
        adapters.adapter_completeness(t.adapter_files()), t.store_requests())


@query("orphan_adapters", """
SELECT adapter_id FROM catalogue ANTI JOIN store_ids USING (adapter_id)""", ("catalogue", "store_ids"))
def _(t):
    wanted = requests.adapter_id_from_path(t.store_requests()).select("adapter_id").distinct()
    return adapters.orphan_adapters(adapters.adapter_completeness(t.adapter_files()), wanted)


def echo_model(adapter_id: str, prompts: list[str], params: dict) -> list[str]:
    """A stand-in model: repeats the prompt, then names the adapter and a parameter."""
    if adapter_id.endswith("_7"):
        raise RuntimeError(f"{adapter_id} is broken")
    return [f"{p} {adapter_id} {params['max_new_tokens']}" for p in prompts]


@query("batch_infer", """
SELECT run_id, request_id,
  CASE WHEN route_error IS NULL AND adapter_id NOT LIKE '%\\_7' ESCAPE '\\'
    THEN adapter_id || ' ' || first(coalesce(max_new_tokens, 50)) OVER (
      PARTITION BY run_id, adapter_id, (no - 1) // 4 ORDER BY no) END AS output,
  CASE WHEN route_error IS NOT NULL THEN route_error
    WHEN adapter_id LIKE '%\\_7' ESCAPE '\\' THEN adapter_id || ' is broken' END AS error
FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, adapter_id ORDER BY submission_us, request_id) AS no
  FROM (
    SELECT q.*, CASE WHEN adapter_path IS NOT NULL AND NOT coalesce(has_config AND has_weights, false)
      THEN 'Failed to load adapter ''' || q.adapter_id || '''' END AS route_error
    FROM store_ids q LEFT JOIN catalogue c USING (adapter_id)))""", ("store_ids", "catalogue"))
def _(t):
    catalogue = adapters.adapter_completeness(t.adapter_files())
    return inference.batch_infer(t.store_requests(), catalogue, echo_model).select(
        "run_id", "request_id", "output", "error")


# Reports and streams go through files that Spark derives from the tables.

@query("write_run_reports", """
SELECT run_id, job_id, status, start_us, end_us, current_step AS final_step FROM outcome""", ("outcome",))
def _(t):
    return derived.written_job_details(t)


@query("bucketed_outcomes", "SELECT * FROM outcome", ("outcome",))
def _(t):
    expected, seen = derived.bucketed(t.expected(), t.seen_jobs(), keys=JOB_KEYS)
    return jobs.expected_vs_actual_jobs(expected, seen).select(
        "run_id", "job_id", "status", "start_us", "end_us", "current_step")


@query("bucketed_requests", """
SELECT q.run_id, q.request_id, r.output, r.error, CASE WHEN r.request_id IS NULL THEN 'UNANSWERED'
  WHEN r.error IS NULL AND r.output IS NOT NULL THEN 'OK' ELSE 'FAILED' END AS state
FROM requests q LEFT JOIN results r USING (run_id, request_id)""", ("requests", "results"))
def _(t):
    asked, answered = derived.bucketed(t.requests(), t.results(), keys=REQUEST_KEYS)
    return requests.correlate_requests(asked, answered).select("run_id", "request_id", "output", "error", "state")


@query("read_run_reports", """
SELECT run_id, request_id, submission_us, processing_start_us, processing_end_us, output, error
FROM strategy_results""", ("strategy_results",))
def _(t):
    return derived.reread_reports(t).request_details.drop("strategy")


@query("read_report_runs", """
SELECT DISTINCT run_id, run_id AS strategy, '{"model":{"run_id":"' || run_id || '"}}' AS config_used
FROM strategy_results""", ("strategy_results",))
def _(t):
    return derived.reread_reports(t).runs.select("run_id", "strategy", "config_used")


@query("read_report_jobs", """
SELECT o.run_id, o.job_id, o.status, o.start_us, o.end_us, o.current_step AS final_step
FROM outcome o WHERE o.run_id IN (SELECT run_id FROM strategy_results)""", ("outcome", "strategy_results"))
def _(t):
    return derived.reread_reports(t).job_details.select(
        "run_id", "job_id", "status", "start_us", "end_us", "final_step")


@query("scan_adapter_configs", """
SELECT p_brand || '_' || (p_size % 10) AS adapter_id, CAST(min(p_size) AS BIGINT) AS r,
  CAST(max(p_size) AS BIGINT) AS lora_alpha, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS target_modules,
  CASE WHEN min(p_size) % 2 = 0 THEN 'SEQ_CLS' ELSE 'CAUSAL_LM' END AS task_type, false AS malformed
FROM part GROUP BY ALL""")
def _(t):
    return derived.scanned_configs(t)


@query("list_adapter_files", """
SELECT DISTINCT p_brand || '_' || (p_size % 10) AS adapter_id, 1 AS files, true AS filled FROM part""")
def _(t):
    return derived.listed_files(t)


@query("missing_reports", """
SELECT DISTINCT run_id || '!' AS name, 'missing' AS reason FROM strategy_results""", ("strategy_results",))
def _(t):
    return derived.missing_reports(t)


@query("stream_progress", f"""
SELECT *, CASE WHEN coalesce(rate, 0) >= 0.001 THEN 'progressing' ELSE 'stagnated' END AS forward_class,
  CASE WHEN rate < 0.005 THEN 'struggling' ELSE 'other' END AS reverse_class FROM ({_ROLLING})
""", ("segments",))
def _(t):
    return derived.streamed_progress(t)


@query("stream_job_state", "SELECT * EXCLUDE (n_losses) FROM rolled_jobs", ("rolled_jobs",))
def _(t):
    return derived.streamed_job_state(t)


@query("stream_outcomes", f"SELECT run_id, {_OUTCOMES} FROM results GROUP BY run_id", ("results",))
def _(t):
    return derived.streamed_outcomes(t)


@query("stream_ingest", """
SELECT run_id, seq, CASE WHEN event_type = 'INFERENCE_REQ' THEN 'request'
  WHEN event_type <> 'TRAIN_JOB' THEN 'unknown'
  WHEN coalesce(job_id, '') = '' THEN 'rejected' ELSE 'accepted' END AS sink
FROM submissions""", ("submissions",))
def _(t):
    return derived.streamed_submissions(t)
