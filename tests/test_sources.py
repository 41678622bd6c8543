import json

import pytest
from pyspark.sql import functions as F

from helpers import rows
from runledger import schemas
from runledger.operators.jobs import expected_vs_actual_jobs
from runledger.plans.summary import run_summary
from runledger.sources import adapters, listing, reports


def report(strategy):
    return {
        "run_timestamp": "2025-04-30T23:09:23.000001",
        "strategy": strategy,
        "strategy_params": {"history_window": 5},
        "config_used": {"model": {"name": "m"}},
        "total_monitor_time_seconds": 40.5,
        "summary_metrics": {"training_makespan_seconds": 12.5, "training_total_jobs_in_scenario": 2,
                            "inference_e2e_latency_ms_avg": None},
        "training_job_details": {
            "j1": {"status": "COMPLETED", "start_time": 1746047360.123456, "end_time": 1746047365.25,
                   "duration_seconds": 5.126544, "final_step": 5, "error": None},
            "j2": {"status": "NOT_FOUND"}},
        "inference_request_details": [
            {"request_id": "q1", "submission_time": 1746047361.0, "processing_start_time": 1746047361.5,
             "processing_end_time": 1746047362.0, "output": "hi", "error": None},
            {"request_id": "q2", "submission_time": 1746047361.0, "processing_start_time": None,
             "processing_end_time": 1746047362.0, "output": None, "error": "boom"}],
    }


def test_reports_one_file_malformed(spark, tmp_path):
    for name in ("RoundRobin", "LeastProgressFirst"):
        (tmp_path / f"eval_{name}_1.json").write_text(json.dumps(report(name), indent=4))
    (tmp_path / "eval_Broken_1.json").write_text('{"strategy": "Broken", "summary')
    (tmp_path / "plot.png").write_bytes(b"png")
    read = reports.read_run_reports(spark, str(tmp_path))
    assert rows(read.runs.select("run_id", "strategy", "total_monitor_time_seconds")) == [
        ("eval_LeastProgressFirst_1", "LeastProgressFirst", 40.5), ("eval_RoundRobin_1", "RoundRobin", 40.5)]
    assert {r.config_used for r in read.runs.collect()} == {'{"model":{"name":"m"}}'}
    details = read.job_details.filter("strategy = 'RoundRobin'").select(
        "job_id", "status", "start_us", "end_us", "duration_seconds", "final_step")
    assert rows(details) == [
        ("j1", "COMPLETED", 1746047360123456, 1746047365250000, 5.126544, 5),
        ("j2", "NOT_FOUND", None, None, None, None)]
    requests = read.request_details.filter("strategy = 'RoundRobin'").select(
        "request_id", "processing_start_us", "error")
    assert rows(requests) == [("q1", 1746047361500000, None), ("q2", None, "boom")]
    assert [r["file"].split("/")[-1] for r in read.rejected.collect()] == ["eval_Broken_1.json"]
    summary = reports.summary_columns(read.runs).filter("strategy = 'RoundRobin'").first()
    assert (summary["makespan_s"], summary["expected_jobs"], summary["e2e_avg_ms"]) == (12.5, 2.0, None)


@pytest.fixture
def run(spark):
    runs = spark.createDataFrame(
        [("r1", "RoundRobin", 0, 9_000_000), ("r2", "Least Progress", 0, 5_000_000), ("r3", "RoundRobin", 0, 1)],
        schemas.RUNS).withColumn("strategy_params", F.create_map(F.lit("k"), F.lit("1")))
    results = spark.createDataFrame(
        [(r, f"{r}-{i}", i, i + 1, i + 2_000_001, f"out {i}", None) for r in ("r1", "r2") for i in range(30)],
        schemas.RESULTS)
    jobs = spark.createDataFrame(
        [("r1", f"j{i}", i, "COMPLETED", 10 + i, 2_000_010, 3, 3, None) for i in range(8)], schemas.JOBS)
    expected = jobs.select("run_id", "job_id").unionByName(
        spark.createDataFrame([("r2", "lost")], "run_id string, job_id string"))
    return runs, run_summary(expected, jobs, results, runs), expected_vs_actual_jobs(expected, jobs), results


def test_nested_reports_come_back_whole(spark, tmp_path, run):
    runs, summary, outcome, results = run
    path = str(tmp_path / "out")
    config = '{"model":{"name":"m","sizes":[1,2]}}'
    reports.write_run_reports(path, runs.withColumn("config_used", F.lit(config)), summary, outcome, results, nested=True)
    assert spark.read.schema(schemas.REPORT).json(path).count() == 3
    read = reports.read_run_reports(spark, path, multiline=False)
    assert rows(read.request_details.drop("strategy")) == rows(results)
    assert rows(read.job_details.select("run_id", "job_id", "status", "start_us", "end_us", "final_step")) == rows(
        outcome.select("run_id", "job_id", "status", "start_us", "end_us", "current_step"))
    assert rows(read.runs.select("run_id", "strategy", "config_used")) == [
        ("r1", "RoundRobin", config), ("r2", "Least Progress", config), ("r3", "RoundRobin", config)]
    back = reports.summary_columns(read.runs).select("run_id", "completed_jobs", "throughput", "e2e_p95_ms")
    want = summary.select("run_id", F.col("completed_jobs").cast("double"), "throughput", "e2e_p95_ms")
    assert [r for r in rows(back) if r[0] != "r3"] == rows(want)
    assert read.rejected.count() == 0


def test_large_nested_reports_come_in_parts(spark, tmp_path, run):
    runs, summary, _, _ = run
    path = str(tmp_path / "out")
    # most requests are alike in every column; no header tells of run x
    results = spark.range(25_000).select(
        F.when(F.col("id") < 24_000, "r1").when(F.col("id") < 24_990, "r2").otherwise("x").alias("run_id"),
        F.greatest(F.lit(20_000), "id").cast("string").alias("request_id"), F.lit(1_000_000).cast("bigint").alias("submission_us"),
        F.lit(2_000_000).cast("bigint").alias("processing_start_us"), F.lit(3_000_000).cast("bigint").alias("processing_end_us"),
        F.lit("out").alias("output"), F.lit(None).cast("string").alias("error"))
    outcome = spark.range(12_000).select(
        F.lit("r1").alias("run_id"), F.col("id").cast("string").alias("job_id"), F.lit("COMPLETED").alias("status"),
        F.lit(1_000_000).cast("bigint").alias("start_us"), F.lit(2_000_000).cast("bigint").alias("end_us"),
        F.col("id").alias("current_step"), F.lit(None).cast("string").alias("error_message"))
    reports.write_run_reports(path, runs, summary, outcome, results, nested=True)
    documents = spark.read.schema(schemas.REPORT).json(path)
    assert documents.agg(F.max(F.size("inference_request_details")), F.max(F.size("training_job_details"))).first() <= (11_000, 11_000)
    assert {r.run_id: r["count"] for r in documents.groupBy("run_id").count().collect()} == {"r1": 3, "r2": 1, "r3": 1}
    read = reports.read_run_reports(spark, path, multiline=False)
    assert rows(read.request_details.drop("strategy")) == rows(results.filter("run_id <> 'x'"))
    assert rows(read.job_details.select("run_id", "job_id", "final_step")) == rows(outcome.select("run_id", "job_id", "current_step"))
    assert rows(read.runs.select("run_id", "strategy")) == [("r1", "RoundRobin"), ("r2", "Least Progress"), ("r3", "RoundRobin")]


def test_flat_reports(spark, tmp_path, run):
    runs, summary, outcome, results = run
    path = str(tmp_path / "flat")
    reports.write_run_reports(path, runs, summary, outcome, results)
    assert spark.read.parquet(f"{path}/runs").count() == 3
    written = spark.read.parquet(f"{path}/request_details")
    assert rows(written.select(results.columns)) == rows(results)
    assert written.filter("strategy = 'Least Progress'").count() == 30
    assert spark.read.parquet(f"{path}/job_details").count() == outcome.count()


@pytest.fixture
def store(tmp_path):
    def put(path, content=""):
        file = tmp_path / "store" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(content)

    config = {"base_model_name_or_path": "base", "peft_type": "LORA", "r": 8, "lora_alpha": 16,
              "lora_dropout": 0.05, "target_modules": ["q_proj", "v_proj"], "bias": "none"}
    put("full/full/adapter_config.json", json.dumps({**config, "task_type": "SEQ_CLS"}, indent=2))
    put("full/full/adapter_model.safetensors", "12345")
    put("full/optimizer.pt", "1")
    put("conf #1+/conf #1+/adapter_config.json", json.dumps(config))
    put("weights/weights/adapter_model.bin", "1")
    put("weights/weights/adapter_config.json")
    put("bad/bad/adapter_config.json", "{")
    put("empty/README.md", "1")
    return str(tmp_path / "store")


def test_adapter_configs(spark, store):
    got = {r["adapter_id"]: r for r in adapters.scan_adapter_configs(spark, store).collect()}
    assert set(got) == {"full", "conf #1+", "bad"}  # the empty file is not listed
    assert got["full"]["task_type"] == "SEQ_CLS" and got["conf #1+"]["task_type"] == "CAUSAL_LM"
    assert got["full"]["target_modules"] == ["q_proj", "v_proj"] and got["full"]["r"] == 8
    assert got["bad"]["malformed"] and not got["full"]["malformed"]


def test_adapter_listing_feeds_the_audit(spark, store):
    from runledger.operators.adapters import adapter_completeness

    files = adapters.list_adapter_files(spark, store)
    assert files.count() == 8
    assert files.filter("path LIKE '%safetensors'").first()["size"] == 5
    assert rows(files.filter("size = 0").select(listing.file_name())) == [("adapter_config.json",)]
    # an empty file exists: an interrupted save counts as present
    servable = adapter_completeness(files).filter("servable").select("adapter_id")
    assert rows(servable) == [("full",), ("weights",)]


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_listing_walks_every_folder_once(spark, tmp_path, partitions):
    for i in range(40):
        folder = tmp_path / "s" / f"a{i % 7}" / f"b {i}%41" / "c"
        folder.mkdir(parents=True)
        (folder / f"f{i}.bin").write_bytes(b"x" * (i % 3))
        (folder / "_hidden").write_text("x")
    (tmp_path / "s" / "top.txt").write_text("abc")
    (tmp_path / "s" / "none").mkdir()
    for root in (str(tmp_path / "s"), f"file:{tmp_path}/s", f"file://{tmp_path}/s"):
        files = listing.list_files(spark, root, partitions)
        want = sorted([("top.txt", 3), *((f"f{i}.bin", i % 3) for i in range(40))])
        assert sorted(map(tuple, files.select(listing.file_name(), "size").collect())) == want
        assert files.rdd.getNumPartitions() <= partitions
        assert files.filter(~F.col("path").startswith(f"file:{tmp_path}/s/")).count() == 0
    assert listing.list_files(spark, str(tmp_path / "nowhere")).count() == 0


def test_missing_files(spark, tmp_path):
    for name, text in {"eval_a.json": "{}", "eval_b.json": "", "other.json": "1"}.items():
        (tmp_path / name).write_text(text)
    expected = spark.createDataFrame([("eval_a.json",), ("eval_b.json",), ("eval_c.json",), ("eval_c.json",)], "name string")
    got = listing.missing_files(listing.list_files(spark, str(tmp_path)), expected)
    assert rows(got) == [("eval_b.json", "empty"), ("eval_c.json", "missing")]
