import uuid

import pytest
from pyspark.sql import functions as F

from helpers import rows
from runledger import schemas
from runledger.operators import jobs, requests
from runledger.sources.bucketed import JOB_KEYS, REQUEST_KEYS, buckets_for, save_bucketed, scratch_bucketed


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def job_tables(spark):
    made = spark.createDataFrame(
        [(f"r{i % 5}", f"j{i}", i, ("ACTIVE", "COMPLETED")[i % 2], 10 + i, None, 3, 1, None) for i in range(200)]
        + [(None, "j1", 1, "ACTIVE", 1, None, 3, 1, None), ("r1", None, 2, "ACTIVE", 1, None, 3, 1, None)], schemas.JOBS)
    listed = spark.range(150).select(
        F.concat(F.lit("r"), F.col("id") % 5).alias("run_id"), F.concat(F.lit("j"), F.col("id") * 2).alias("job_id"))
    return made, listed


@pytest.mark.parametrize("join", [jobs.prepared_runnable, jobs.runnable_unprepared,
                                  lambda made, listed: jobs.expected_vs_actual_jobs(listed, made)])
def test_job_joins_without_a_shuffle(spark, no_broadcast, job_tables, join):
    made, listed = job_tables
    want = join(made, listed)
    got = join(scratch_bucketed(made, JOB_KEYS, 8), scratch_bucketed(listed, JOB_KEYS, 8))
    assert rows(got) == rows(want)
    assert "Exchange" in plan(want) and "Exchange" not in plan(got)
    # one file for each bucket and sorted: no sort either, once Spark may rely on it
    assert got.count() == want.count() > 0


def test_request_join_without_a_shuffle(spark, no_broadcast):
    asked = spark.createDataFrame(
        [("r", f"q{i}", i, None, "p") for i in range(100)], "run_id string, request_id string, submission_us bigint, adapter_path string, prompt string")
    results = spark.createDataFrame(
        [("r", f"q{i}", i, i + 1, i + 2, "out" if i % 3 else None, None) for i in range(0, 100, 2)], schemas.RESULTS)
    want = requests.correlate_requests(asked, results)
    got = requests.correlate_requests(scratch_bucketed(asked, REQUEST_KEYS, 4), scratch_bucketed(results, REQUEST_KEYS, 4))
    assert rows(got) == rows(want)
    assert "Exchange" not in plan(got)


def test_rows_files_and_errors(spark, job_tables, tmp_path):
    made, _ = job_tables
    name = f"t_{uuid.uuid4().hex}"
    path = tmp_path / "jobs"
    table = save_bucketed(made, name, JOB_KEYS, 4, str(path))
    assert rows(table) == rows(made)  # null keys among them
    assert len(list(path.glob("*.parquet"))) <= 4
    with pytest.raises(ValueError, match="nothing"):
        save_bucketed(made, name, ["nothing"], 4)
    with pytest.raises(ValueError, match="none given"):
        save_bucketed(made, name, [], 4)
    with pytest.raises(ValueError, match="1 or more"):
        save_bucketed(made, name, JOB_KEYS, 0)
    empty = scratch_bucketed(made.limit(0), JOB_KEYS, 4)
    assert empty.count() == 0 and empty.columns == made.columns
    assert buckets_for(spark, 0) >= 4 and buckets_for(spark, 40_000_000_000) == 8192
