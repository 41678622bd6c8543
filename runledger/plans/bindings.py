"""The canonical tables, derived from the given parquet tables.

Each table exists twice: as a DataFrame (``Tables``) and as DuckDB SQL (``SQL``),
so that every operator can be compared with an independent query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions.timing import to_micros
from runledger.operators.jobs import job_rollup
from runledger.operators.ordered import number_rows
from runledger.operators.submissions import first_registration

# The order priorities, which stand for the compared strategies.
STRATEGIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
DAY_US = 86_400_000_000


def _text(column: Column) -> Column:
    return column.cast("string")


class Tables:
    """Canonical tables over the parquet files of one directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def events(self) -> DataFrame:
        return events_in_micros(self.raw("events"))

    def results(self) -> DataFrame:
        return bind_results(self.events(), _text(F.col("user_id") % 3))

    def strategy_results(self) -> DataFrame:
        strategies = F.array(*[F.lit(s) for s in STRATEGIES])
        return bind_results(self.events(), F.get(strategies, (F.col("user_id") % 5).cast("int")))

    def requests(self) -> DataFrame:
        user = F.col("user_id") % 4
        path = F.when(user != 0, F.concat(F.lit("./adapters/job_"), user, F.lit("/")))
        return _bind_requests(self.events(), path)

    def store_requests(self) -> DataFrame:
        """The same requests, asking for adapters of the store in ``adapter_files``."""
        name = F.concat(F.lit("./adapters//Brand#"), F.col("user_id") % 40, F.lit("_"),
                        F.col("event_id") % 10, F.lit("/./"))
        return _bind_requests(self.events(), F.when(F.col("user_id") % 4 != 0, name))

    def job_events(self) -> DataFrame:
        return bind_job_events(self.events())

    def registrations(self) -> DataFrame:
        added = self.job_events().filter(F.col("event_type") == "JOB_ADDED")
        subs = added.select("run_id", "job_id", F.col("event_seq").alias("seq"), F.col("ts_us").alias("start_us"))
        return first_registration(subs).select("run_id", "job_id", F.col("seq").alias("reg_seq"), "start_us")

    def rolled_jobs(self) -> DataFrame:
        return job_rollup(self.registrations(), self.job_events())

    def active_jobs(self) -> DataFrame:
        return self.job_events().groupBy("run_id", "job_id").agg(
            F.min("event_seq").alias("reg_seq"),
            F.count_if(F.col("event_type") == "STEP_COMPLETED").alias("current_step"),
            F.lit(schemas.ACTIVE).alias("status"),
        )

    def job_limits(self) -> DataFrame:
        """Step limit, samples and batch size of the jobs in ``job_events``."""
        jobs = self.job_events().select("run_id", "job_id").distinct()
        number = F.col("job_id").cast("bigint")
        return jobs.select(
            "run_id", "job_id", (number % 8).alias("max_steps"),
            (number % 5 + 3).alias("n_samples"), (number % 2 + 1).alias("batch_size"))

    def expected(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderpriority").alias("run_id"), _text(F.col("o_orderkey")).alias("job_id"))

    def jobs(self) -> DataFrame:
        lines = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.count(F.lit(1)).alias("n"))
        key, step = F.col("o_orderkey"), F.coalesce("n", F.lit(0))
        start = to_micros(F.col("o_orderdate"))
        status = (F.when(F.col("o_orderstatus") == "F", schemas.COMPLETED)
                  .when(F.col("o_orderstatus") == "O", schemas.FAILED).otherwise(schemas.ACTIVE))
        return self.raw("orders").join(lines, "o_orderkey", "left").select(
            F.col("o_orderpriority").alias("run_id"),
            F.col("o_orderpriority").alias("strategy"),
            _text(key).alias("job_id"),
            key.alias("reg_seq"),
            status.alias("status"),
            start.alias("start_us"),
            F.when(F.col("o_orderstatus") != "P", start + step * DAY_US).alias("end_us"),
            step.alias("current_step"),
            F.when(key % 11 != 0, key % 8).alias("max_steps"),
        )

    def seen_jobs(self) -> DataFrame:
        """Jobs with at least one line item; the other expected ones are NOT_FOUND."""
        return self.jobs().filter(F.col("current_step") > 0)

    def prepared(self) -> DataFrame:
        keys = self.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
        return self.raw("orders").join(keys, "o_orderkey").select(
            F.col("o_orderpriority").alias("run_id"), _text(F.col("o_orderkey")).alias("job_id"))

    def active_at(self, time_us: int) -> DataFrame:
        still = F.col("end_us").isNull() | (F.col("end_us") > time_us)
        return self.jobs().filter((F.col("start_us") <= time_us) & still)

    def submissions(self) -> DataFrame:
        return bind_submissions(self.events())

    def samples(self) -> DataFrame:
        numbered = number_rows(
            self.raw("documents").select("source", "doc_id", "text"), ["source"], ["doc_id"], "no")
        return numbered.select(
            F.col("source").alias("job_id"), (F.col("no") - 1).alias("sample_idx"), "text")

    def sample_jobs(self) -> DataFrame:
        """Training parameters per document source, and one job without samples."""
        jobs = self.raw("documents").select(F.col("source").alias("job_id")).distinct()
        numbered = jobs.withColumn("n", F.substring("job_id", 4, 10).cast("bigint"))
        empty = self.raw("region").agg(F.lit("none").alias("job_id"), F.count(F.lit(1)).alias("n"))
        return numbered.unionByName(empty).select(
            "job_id", (F.col("n") % 4 + 1).alias("batch_size"),
            (F.col("n") * 7).alias("max_steps"), (F.col("n") % 3).alias("current_step"))

    def adapter_files(self) -> DataFrame:
        kind = F.col("p_type")
        name = F.concat(F.col("p_brand"), F.lit("_"), F.col("p_size") % 10)
        file = (F.when(kind == "ECONOMY", "adapter_config.json")
                .when(kind == "LARGE", "adapter_model.safetensors")
                .when(kind == "MEDIUM", "adapter_model.bin")
                .when(kind == "PROMO", "optimizer.pt").otherwise("README.md"))
        inner = F.when(kind.isin("ECONOMY", "LARGE", "MEDIUM"), F.concat(name, F.lit("/"))).otherwise("")
        return self.raw("part").select(
            F.concat(F.lit("./adapters/"), name, F.lit("/"), inner, file).alias("path"),
            F.col("p_size").cast("bigint").alias("size"))


def events_in_micros(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", to_micros(F.col("ts")).alias("us"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def bind_results(events: DataFrame, run_id: Column) -> DataFrame:
    failed = F.col("event_type") == "error"
    start = F.col("us") + F.col("k") * 1000
    return events.select(
        run_id.alias("run_id"),
        _text(F.col("event_id")).alias("request_id"),
        F.col("us").alias("submission_us"),
        F.when(~failed, start).alias("processing_start_us"),
        (start + F.round(F.col("value") * 1000).cast("bigint")).alias("processing_end_us"),
        F.when(~failed, F.col("event_type")).alias("output"),
        F.when(failed, F.lit("boom")).alias("error"),
    )


def _bind_requests(events: DataFrame, path: Column) -> DataFrame:
    event = F.col("event_id")
    params = F.struct(
        F.when(event % 7 != 0, event % 64 + 1).cast("int").alias("max_new_tokens"),
        F.when(event % 3 != 0, (event % 10) / 10.0).cast("double").alias("temperature"),
        F.when(event % 4 != 0, event % 2 == 0).alias("do_sample"),
    )
    return events.select(
        _text(F.col("user_id") % 3).alias("run_id"),
        _text(event).alias("request_id"),
        F.col("us").alias("submission_us"),
        F.col("event_type").alias("prompt"),
        path.alias("adapter_path"),
        F.when(event % 5 != 0, params).alias("generation_params"),
    )


def bind_job_events(events: DataFrame) -> DataFrame:
    kind, event = F.col("event_type"), F.col("event_id")
    names = {"view": "STEP_COMPLETED", "click": "METRICS_REPORTED", "purchase": "STATUS_UPDATE",
             "error": "JOB_FAILED", "signup": "JOB_ADDED"}
    renamed = F.lit(None).cast("string")
    for old, new in names.items():
        renamed = F.when(kind == old, new).otherwise(renamed)
    return events.select(
        _text(F.col("user_id") % 3).alias("run_id"),
        _text(F.col("user_id")).alias("job_id"),
        event.alias("event_seq"),
        renamed.alias("event_type"),
        F.col("us").alias("ts_us"),
        F.when(kind == "view", 1).otherwise(0).alias("step_increment"),
        F.when(event % 50 == 0, "invalid").when(kind.isin("view", "click"), _text(F.col("value"))).alias("loss_raw"),
        F.when(kind == "purchase", schemas.COMPLETED)
        .when((kind == "error") & (event % 2 == 0), schemas.FAILED).alias("status"),
        F.when(kind == "error", F.concat(F.lit("boom "), event)).alias("error_message"),
    )


def bind_submissions(events: DataFrame) -> DataFrame:
    kind, event = F.col("event_type"), F.col("event_id")
    is_job = kind == "signup"
    samples = F.transform(F.sequence(F.lit(0), (event % 3).cast("int")),
                          lambda i: F.concat(F.lit("s"), event, F.lit("_"), i))
    return events.select(
        _text(F.col("user_id") % 3).alias("run_id"),
        event.alias("seq"),
        F.when(is_job, "TRAIN_JOB").when(kind.isin("click", "view"), "INFERENCE_REQ")
        .otherwise(kind).alias("event_type"),
        F.col("us").alias("submitted_us"),
        F.when(event % 19 == 0, F.lit(None)).when(event % 17 == 0, "")
        .otherwise(_text(F.col("user_id"))).alias("job_id"),
        F.when(event % 13 == 0, F.lit(None)).when(event % 11 == 0, F.array().cast("array<string>"))
        .otherwise(samples).alias("dataset_samples"),
        F.when(event % 5 != 0, event % 5).cast("int").alias("batch_size"),
        F.when(event % 4 != 0, (event % 4) / 1000.0).cast("double").alias("lr"),
        F.when(event % 6 == 0, F.lit(None)).when(event % 9 == 0, "")
        .otherwise(F.concat(F.lit("./saved/"), event)).alias("adapter_save_path"),
    )


# The same tables for DuckDB.

def _result_sql(run_id: str) -> str:
    return f"""
    SELECT {run_id} AS run_id, CAST(event_id AS VARCHAR) AS request_id, us AS submission_us,
      CASE WHEN event_type <> 'error' THEN us + k * 1000 END AS processing_start_us,
      us + k * 1000 + CAST(round(value * 1000) AS BIGINT) AS processing_end_us,
      CASE WHEN event_type <> 'error' THEN event_type END AS output,
      CASE WHEN event_type = 'error' THEN 'boom' END AS error
    FROM ev"""


def _request_sql(path: str) -> str:
    return f"""
    SELECT CAST(user_id % 3 AS VARCHAR) AS run_id, CAST(event_id AS VARCHAR) AS request_id,
      us AS submission_us, event_type AS prompt, {path} AS adapter_path,
      CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN event_id % 64 + 1 END AS max_new_tokens,
      CASE WHEN event_id % 5 <> 0 AND event_id % 3 <> 0 THEN (event_id % 10) / 10.0 END AS temperature,
      CASE WHEN event_id % 5 <> 0 AND event_id % 4 <> 0 THEN event_id % 2 = 0 END AS do_sample
    FROM ev"""


_STRATEGY = "['" + "', '".join(STRATEGIES) + "'][CAST(user_id % 5 AS INTEGER) + 1]"
_ADAPTER_OF = """CASE WHEN adapter_path IS NULL THEN 'Base Model'
      ELSE regexp_extract(adapter_path, '([^/]+)(/|/\\./)$', 1) END"""

# name -> (tables it reads, query)
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """
    SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events"""),
    "results": (("ev",), _result_sql("CAST(user_id % 3 AS VARCHAR)")),
    "strategy_results": (("ev",), _result_sql(_STRATEGY)),
    "latencies": (("results",), """
    SELECT *, (processing_end_us - submission_us) / 1000.0 AS e2e_ms,
      (processing_end_us - processing_start_us) / 1000.0 AS proc_ms
    FROM results WHERE error IS NULL AND output IS NOT NULL"""),
    "requests": (("ev",), _request_sql(
        "CASE WHEN user_id % 4 <> 0 THEN './adapters/job_' || (user_id % 4) || '/' END")),
    "store_requests": (("ev",), _request_sql(
        "CASE WHEN user_id % 4 <> 0 THEN './adapters//Brand#' || (user_id % 40) || '_' "
        "|| (event_id % 10) || '/./' END")),
    "batched": (("requests",), f"""
    SELECT *, (no - 1) // 4 AS batch, (no - 1) % 4 AS pos FROM (
      SELECT *, row_number() OVER (
        PARTITION BY run_id, adapter_id ORDER BY submission_us, request_id) AS no
      FROM (SELECT *, {_ADAPTER_OF} AS adapter_id FROM requests))"""),
    "store_ids": (("store_requests",), f"SELECT *, {_ADAPTER_OF} AS adapter_id FROM store_requests"),
    "request_ids": (("requests",), f"SELECT *, {_ADAPTER_OF} AS adapter_id FROM requests"),
    "job_events": (("ev",), """
    SELECT CAST(user_id % 3 AS VARCHAR) AS run_id, CAST(user_id AS VARCHAR) AS job_id,
      event_id AS event_seq,
      CASE event_type WHEN 'view' THEN 'STEP_COMPLETED' WHEN 'click' THEN 'METRICS_REPORTED'
        WHEN 'purchase' THEN 'STATUS_UPDATE' WHEN 'error' THEN 'JOB_FAILED'
        WHEN 'signup' THEN 'JOB_ADDED' END AS event_type,
      us AS ts_us, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS step_increment,
      CASE WHEN event_id % 50 = 0 THEN 'invalid'
        WHEN event_type IN ('view', 'click') THEN CAST(value AS VARCHAR) END AS loss_raw,
      CASE WHEN event_type = 'purchase' THEN 'COMPLETED'
        WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'FAILED' END AS status,
      CASE WHEN event_type = 'error' THEN 'boom ' || event_id END AS error_message
    FROM ev"""),
    "history": (("job_events",), """
    SELECT run_id, job_id, ts_us, event_seq, status IS NOT DISTINCT FROM 'COMPLETED' AS done,
      CASE WHEN event_type IN ('STEP_COMPLETED', 'METRICS_REPORTED')
        THEN TRY_CAST(loss_raw AS DOUBLE) END AS loss
    FROM job_events
    WHERE status IS NOT DISTINCT FROM 'COMPLETED' OR (
      event_type IN ('STEP_COMPLETED', 'METRICS_REPORTED') AND TRY_CAST(loss_raw AS DOUBLE) IS NOT NULL)"""),
    "segments": (("history",), """
    SELECT *, sum(CASE WHEN done THEN 1 ELSE 0 END) OVER (
      PARTITION BY run_id, job_id ORDER BY ts_us, event_seq ROWS UNBOUNDED PRECEDING) AS segment
    FROM history"""),
    "progress": (("segments",), """
    SELECT run_id, job_id, count(*) AS history_size, last(loss ORDER BY ts_us, event_seq) AS last_loss,
      round(avg(delta), 12) + 0.0 AS rate
    FROM (
      SELECT *, lag(loss) OVER (PARTITION BY run_id, job_id ORDER BY ts_us, event_seq) - loss AS delta
      FROM (
        SELECT *, row_number() OVER (
            PARTITION BY run_id, job_id ORDER BY ts_us DESC, event_seq DESC) AS back
        FROM (SELECT *, max(segment) OVER (PARTITION BY run_id, job_id) AS latest FROM segments)
        WHERE NOT done AND segment = latest)
      WHERE back <= 10)
    GROUP BY run_id, job_id"""),
    "active_jobs": (("job_events",), """
    SELECT run_id, job_id, min(event_seq) AS reg_seq,
      count(*) FILTER (WHERE event_type = 'STEP_COMPLETED') AS current_step
    FROM job_events GROUP BY run_id, job_id"""),
    "classified": (("active_jobs", "progress"), """
    SELECT j.*, p.rate,
      CASE WHEN coalesce(p.rate, 0) >= 0.001 THEN 'progressing' ELSE 'stagnated' END AS forward_class,
      CASE WHEN p.rate < 0.005 THEN 'struggling' ELSE 'other' END AS reverse_class
    FROM active_jobs j LEFT JOIN progress p USING (run_id, job_id)"""),
    "reg": (("job_events",), """
    SELECT run_id, job_id, min(event_seq) AS reg_seq, arg_min(ts_us, event_seq) AS start_us
    FROM job_events WHERE event_type = 'JOB_ADDED' GROUP BY run_id, job_id"""),
    "own_events": (("reg", "job_events"), """
    SELECT e.* FROM job_events e JOIN reg r ON e.run_id = r.run_id AND e.job_id = r.job_id
      AND (e.ts_us > r.start_us OR (e.ts_us = r.start_us AND e.event_seq > r.reg_seq))"""),
    "rolled_jobs": (("reg", "job_events"), """
    SELECT r.run_id, r.job_id, r.reg_seq,
      coalesce(last(new_status ORDER BY ts_us, event_seq) FILTER (WHERE new_status IS NOT NULL), 'ACTIVE') AS status,
      r.start_us,
      coalesce(max(ts_us) FILTER (WHERE status IN ('COMPLETED', 'FAILED')),
               min(ts_us) FILTER (WHERE error_message IS NOT NULL)) AS end_us,
      CAST(coalesce(sum(step_increment), 0) AS BIGINT) AS current_step,
      count(TRY_CAST(loss_raw AS DOUBLE)) AS n_losses,
      last(error_message ORDER BY ts_us, event_seq) FILTER (WHERE error_message IS NOT NULL) AS error_message
    FROM reg r LEFT JOIN (
      SELECT *, CASE WHEN error_message IS NOT NULL THEN 'FAILED' ELSE status END AS new_status
      FROM job_events) e
      ON e.run_id = r.run_id AND e.job_id = r.job_id
        AND (e.ts_us > r.start_us OR (e.ts_us = r.start_us AND e.event_seq > r.reg_seq))
    GROUP BY r.run_id, r.job_id, r.reg_seq, r.start_us"""),
    "job_limits": (("job_events",), """
    SELECT DISTINCT run_id, job_id, CAST(job_id AS BIGINT) % 8 AS max_steps,
      CAST(job_id AS BIGINT) % 5 + 3 AS n_samples, CAST(job_id AS BIGINT) % 2 + 1 AS batch_size
    FROM job_events"""),
    "expected": ((), """
    SELECT o_orderpriority AS run_id, CAST(o_orderkey AS VARCHAR) AS job_id FROM orders"""),
    "jobs": ((), f"""
    SELECT o_orderpriority AS run_id, o_orderpriority AS strategy, CAST(o_orderkey AS VARCHAR) AS job_id,
      o_orderkey AS reg_seq,
      CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'FAILED' ELSE 'ACTIVE' END AS status,
      epoch_us(o_orderdate) AS start_us,
      CASE WHEN o_orderstatus <> 'P' THEN epoch_us(o_orderdate) + coalesce(n, 0) * {DAY_US} END AS end_us,
      coalesce(n, 0) AS current_step,
      CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 8 END AS max_steps
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
      ON l_orderkey = o_orderkey"""),
    "seen_jobs": (("jobs",), "SELECT * FROM jobs WHERE current_step > 0"),
    "outcome": (("expected", "seen_jobs"), """
    SELECT e.run_id, e.job_id, coalesce(j.status, 'NOT_FOUND') AS status, nullif(j.start_us, 0) AS start_us,
      nullif(j.end_us, 0) AS end_us, j.current_step
    FROM expected e LEFT JOIN seen_jobs j USING (run_id, job_id)"""),
    "prepared": ((), """
    SELECT DISTINCT o_orderpriority AS run_id, CAST(o_orderkey AS VARCHAR) AS job_id
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""),
    "timed": (("jobs",), """
    SELECT *, (end_us - start_us) / 1e6 AS duration_s FROM jobs
    WHERE start_us <> 0 AND end_us <> 0 AND end_us <> start_us"""),
    "submissions": (("ev",), """
    SELECT CAST(user_id % 3 AS VARCHAR) AS run_id, event_id AS seq,
      CASE WHEN event_type = 'signup' THEN 'TRAIN_JOB'
        WHEN event_type IN ('click', 'view') THEN 'INFERENCE_REQ' ELSE event_type END AS event_type,
      us AS submitted_us,
      CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 17 = 0 THEN ''
        ELSE CAST(user_id AS VARCHAR) END AS job_id,
      CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST([] AS VARCHAR[])
        ELSE list_transform(range(0, event_id % 3 + 1), lambda i: 's' || event_id || '_' || i) END
        AS dataset_samples,
      CASE WHEN event_id % 5 <> 0 THEN event_id % 5 END AS batch_size,
      CASE WHEN event_id % 4 <> 0 THEN (event_id % 4) / 1000.0 END AS lr,
      CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 9 = 0 THEN ''
        ELSE './saved/' || event_id END AS adapter_save_path
    FROM ev"""),
    "samples": ((), """
    SELECT source AS job_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS sample_idx, text
    FROM documents"""),
    "sample_jobs": ((), """
    SELECT job_id, n % 4 + 1 AS batch_size, n * 7 AS max_steps, n % 3 AS current_step FROM (
      SELECT DISTINCT source AS job_id, CAST(substr(source, 4, 10) AS BIGINT) AS n FROM documents
      UNION ALL SELECT 'none', count(*) FROM region)"""),
    "tokens": (("samples",), r"""
    SELECT job_id, sample_idx,
      list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda w: w <> '') AS words
    FROM samples"""),
    "adapter_files": ((), """
    SELECT p_brand || '_' || (p_size % 10) AS adapter_id, p_type FROM part"""),
    "catalogue": (("adapter_files",), """
    SELECT adapter_id, bool_or(p_type = 'ECONOMY') AS has_config,
      bool_or(p_type IN ('LARGE', 'MEDIUM')) AS has_weights, bool_or(p_type = 'PROMO') AS has_optimizer
    FROM adapter_files GROUP BY adapter_id"""),
    "turns": ((), """
    SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS reply
    FROM conversations u JOIN conversations a
      ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    WHERE u.role = 'user'"""),
}


def with_tables(query: str, *names: str) -> str:
    """Prefix a DuckDB query with the canonical tables it reads."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in SQL[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    tables = ",\n".join(f"{name} AS ({SQL[name][1]})" for name in ordered)
    return f"WITH {tables}\n{query}" if tables else query
