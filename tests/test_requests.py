import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from helpers import rows
from runledger import schemas
from runledger.operators import adapters, inference, requests
from runledger.plans.summary import run_summary

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def result(i, run="r", sub=0, start=1000, end=3000, output="ok", error=None):
    return (run, str(i), sub, start, end, output, error)


def test_success_and_latency(spark):
    df = spark.createDataFrame([
        result(1), result(2, error="boom"), result(3, output=None), result(4, start=None), result(5, end=None),
        result(6, sub=None), result(7, output="")], schemas.RESULTS)
    flags = requests.flag_success(df).filter("success").select("request_id")
    assert rows(flags) == [("1",), ("4",), ("5",), ("6",), ("7",)]
    got = {r["request_id"]: (r["e2e_ms"], r["proc_ms"]) for r in requests.request_latency(df).collect()}
    assert got["1"] == (3.0, 2.0) and got["2"] == got["3"] == got["5"] == (None, None)
    assert got["4"] == (3.0, None) and got["6"] == (None, 2.0)


def test_run_where_everything_failed(spark):
    df = spark.createDataFrame([result(i, error="boom", output=None) for i in range(3)], schemas.RESULTS)
    summary = requests.latency_summary(df).first()
    assert all(summary[c] is None for c in summary.asDict() if c != "run_id")
    assert rows(requests.request_outcomes(df)) == [("r", 3, 0, 3)]
    expected = spark.createDataFrame([("r", "a")], "run_id string, job_id string")
    jobs = spark.createDataFrame([], schemas.JOBS)
    row = run_summary(expected, jobs, df).first()
    assert (row["expected_jobs"], row["failed"], row["throughput"], row["e2e_p50_ms"]) == (1, 3, 0.0, None)


def test_summary_of_runs_with_one_side_only(spark):
    expected = spark.createDataFrame([("jobs_only", "a")], "run_id string, job_id string")
    df = spark.createDataFrame([result(1, run="requests_only")], schemas.RESULTS)
    runs = spark.createDataFrame([("requests_only", "s", 0, 2_000_000)], schemas.RUNS)
    got = {r["run_id"]: r for r in run_summary(expected, spark.createDataFrame([], schemas.JOBS), df, runs).collect()}
    assert got["jobs_only"]["total"] == 0 and got["jobs_only"]["throughput"] == 0.0
    assert got["requests_only"]["expected_jobs"] == 0 and got["requests_only"]["throughput"] == 0.5


def test_run_without_time_has_no_throughput(spark):
    df = spark.createDataFrame([result(1)], schemas.RESULTS)
    runs = spark.createDataFrame([("r", "s", 5, 5)], schemas.RUNS)
    assert rows(requests.throughput(df, runs)) == [("r", 0.0)]


@pytest.mark.parametrize("limit", [10, 10_000])
def test_box(spark, small_groups, limit):
    small_groups(limit)
    np = pytest.importorskip("numpy")
    rng = random.Random(2)
    data = [result(i, end=rng.randrange(1000, 9000)) for i in range(60)] + [result(60, end=90_000)]
    df = spark.createDataFrame(data, schemas.RESULTS)
    values = np.array([r[4] / 1000 for r in data])
    q1, median, q3 = np.percentile(values, [25, 50, 75])
    inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
    got = requests.latency_box(df).first()
    assert [got[c] for c in ("q1", "median", "q3", "whisker_low", "whisker_high")] == pytest.approx(
        [q1, median, q3, inside.min(), inside.max()])
    assert got["outliers"] == len(values) - len(inside)
    assert requests.latency_outliers(df).count() == got["outliers"]


def test_approximate_percentiles_are_close(spark):
    df = spark.createDataFrame([result(i, end=1000 * i) for i in range(1, 1001)], schemas.RESULTS)
    got = requests.latency_summary(df, approx=True).first()
    assert got["e2e_p50_ms"] == pytest.approx(500, abs=2)


def request(i, run="r", at=None, path=None, params=None):
    return (run, str(i), i if at is None else at, f"p{i}", path, params)


@pytest.mark.parametrize("limit", [6, 10_000])
def test_batches(spark, small_groups, limit):
    small_groups(limit)
    rng = random.Random(4)
    data = [request(i, at=rng.randrange(30), path=rng.choice([None, "", "./x/a", "./x/a/", "b"])) for i in range(80)]
    df = spark.createDataFrame(data, schemas.REQUESTS)
    batched = requests.fifo_batches(df, 4)
    by_id = {str(r[1]): r for r in data}
    order = {}
    for r in batched.collect():
        order.setdefault(r["adapter_id"], []).append((r["batch"] * 4 + r["pos"], r["request_id"]))
    assert set(order) == {"Base Model", "a", "b"}
    for members in order.values():
        ids = [i for _, i in sorted(members)]
        assert [n for n, _ in sorted(members)] == list(range(len(members)))
        assert ids == sorted(ids, key=lambda i: (by_id[i][2], i))
    assert sum(r["requests"] for r in requests.requests_by_adapter(df).collect()) == 80
    results = spark.createDataFrame([result(i) for i in range(70)], schemas.RESULTS)
    executed = requests.batch_outcomes(batched, results).collect()
    assert sum(r["size"] for r in executed) == 70 and max(r["size"] for r in executed) <= 4


def test_first_request_sets_parameters(spark):
    df = spark.createDataFrame([
        request(1, params=(7, None, False)), request(2, params=(9, 0.1, True)), request(3, run="q")], schemas.REQUESTS)
    params = requests.group_params(requests.fifo_batches(df, 4))
    assert rows(params.select("run_id", "max_new_tokens", "temperature", "do_sample")) == [
        ("q", 50, 0.7, True), ("r", 7, 0.7, False)]


@pytest.mark.parametrize("limit", [10, 10_000])
def test_queue_depth_and_cumulative_success(spark, small_groups, limit):
    small_groups(limit)
    rng = random.Random(6)
    data = []
    for i in range(50):
        at = rng.randrange(20)
        failed = rng.random() < 0.3
        start = None if failed else at + rng.randrange(5)
        data.append(result(i, sub=at, start=start, end=at + 6, output=None if failed else "x",
                           error="boom" if failed else None))
    df = spark.createDataFrame(data, schemas.RESULTS)
    changes = sorted([(r[2], -1, r[1], 1) for r in data]
                     + [(r[4] if r[3] is None else r[3], 1, r[1], -1) for r in data])
    depth, want = 0, []
    for ts, _, request_id, change in changes:
        depth += change
        want.append((request_id, ts, change, depth))
    got = requests.queue_depth(df).select("request_id", "ts_us", "change", "depth")
    assert rows(got) == sorted(want, key=repr) and depth == 0
    done = sorted(r[4] for r in data if r[6] is None)
    points = requests.cumulative_success(df, F.lit(0)).orderBy("successes").collect()
    assert [p["successes"] for p in points] == list(range(len(done) + 1))
    assert [p["at_s"] for p in points] == [0.0, *[t / 1e6 for t in done]]


def test_correlate_and_union(spark):
    asked = spark.createDataFrame([request(1), request(2), request(3)], schemas.REQUESTS)
    answers = spark.createDataFrame([result(1), result(2, error="boom", output=None)], schemas.RESULTS)
    states = requests.correlate_requests(asked, answers).select("request_id", "state")
    assert rows(states) == [("1", "OK"), ("2", "FAILED"), ("3", "UNANSWERED")]
    both = requests.union_results({"x": answers, "y": answers.drop("error")})
    assert both.count() == 4 and both.filter("source = 'y' AND error IS NULL").count() == 2


STORE = [
    "/s/full/full/adapter_config.json", "/s/full/full/adapter_model.bin", "/s/full/optimizer.pt",
    "/s/safe/safe/adapter_config.json", "/s/safe/safe/adapter_model.safetensors",
    "/s/conf/conf/adapter_config.json", "/s/weights/weights/adapter_model.bin",
    "/s/misplaced/adapter_config.json", "/s/misplaced/adapter_model.bin",
    "/s/bad_opt/bad_opt/optimizer.pt",
]


def store(spark):
    return adapters.adapter_completeness(spark.createDataFrame([(p, 1) for p in STORE], schemas.ADAPTER_FILES))


def test_store_audit(spark):
    got = {r["adapter_id"]: tuple(r)[1:] for r in store(spark).collect()}
    assert got == {
        "full": (True, True, True, True, True, False), "safe": (True, True, False, True, False, False),
        "conf": (True, False, False, False, False, False), "weights": (False, True, False, False, False, True),
        "misplaced": (False, False, False, False, False, True), "bad_opt": (False, False, False, False, False, True)}
    asked = spark.createDataFrame(
        [request(1, path="/s/full"), request(2, path="/s/conf/"), request(3, path="gone"), request(4)],
        schemas.REQUESTS)
    demand = {r["adapter_id"]: tuple(r)[1:] for r in adapters.adapter_demand(store(spark), asked).collect()}
    assert demand["full"] == (1, True, False, False) and demand["conf"] == (1, True, True, False)
    assert demand["gone"] == (1, False, True, False) and demand["safe"] == (0, True, False, True)
    keep = spark.createDataFrame([("full",), ("safe",)], "adapter_id string")
    assert rows(adapters.orphan_adapters(store(spark), keep)) == [
        ("bad_opt",), ("conf",), ("misplaced",), ("weights",)]


def model(adapter, prompts, params):
    if adapter == "safe":
        raise RuntimeError("out of memory")
    if "p13" in prompts:
        return prompts[:-1]
    return [f"{p}  {adapter}/{params['max_new_tokens']} " for p in prompts]


@pytest.mark.parametrize("limit", [5, 10_000])
def test_batch_infer(spark, small_groups, limit):
    small_groups(limit)
    where = {0: None, 1: "/s/full", 2: "/s/safe", 3: "/s/conf", 4: "/s/nowhere"}
    data = [request(i, path=where[i % 5], params=(i, None, None)) for i in range(10, 60)]
    out = inference.batch_infer(spark.createDataFrame(data, schemas.REQUESTS), store(spark), model, batch_size=2)
    assert [f.name for f in out.schema.fields] == [c.split()[0] for c in schemas.RESULTS.split(", ")]
    got = {int(r["request_id"]): r for r in out.collect()}
    assert len(got) == 50
    for i, r in got.items():
        kind = i % 5
        if kind == 0:
            assert r["output"] == f"Base Model/{10 + (i - 10) // 10 * 10}"
            assert r["error"] is None and r["processing_start_us"] <= r["processing_end_us"]
            continue
        if kind == 1:
            assert r["output"] == f"full/{11 + (i - 11) // 10 * 10}"
            continue
        reason = {2: "out of memory", 3: "Failed to load adapter 'conf'",
                  4: "Failed to load adapter 'nowhere'"}[kind]
        assert (r["output"], r["error"], r["processing_start_us"]) == (None, reason, None)
        assert r["processing_end_us"] is not None and r["submission_us"] == i


def test_short_answer_fails_its_batch_only(spark):
    data = [request(i) for i in range(12, 16)]
    out = inference.batch_infer(spark.createDataFrame(data, schemas.REQUESTS), store(spark), model, batch_size=2)
    errors = {int(r["request_id"]): r["error"] for r in out.collect()}
    assert errors[12] == errors[13] == "1 outputs for 2 prompts"
    assert errors[14] is errors[15] is None


def test_latency_sketches_merge(spark):
    """Hours that are sketched one after the other give what all results give, within the error."""
    np = pytest.importorskip("numpy")
    data = [(f"r{i % 2}" if i % 5 else None, str(i), i * 10_000_000, i * 10_000_000, i * 10_000_000 + 1000 * (i * i % 977),
             None if i % 9 == 0 else "x", None) for i in range(3000)]
    results = spark.createDataFrame(data, schemas.RESULTS)
    early = requests.latency_sketches(results.filter("submission_us < 15000000000"))
    late = requests.latency_sketches(results.filter("submission_us >= 15000000000"))
    assert early.select("hour").distinct().count() == 5
    got = {r["run_id"]: r for r in requests.sketched_latency(early.unionByName(late)).collect()}
    for run in ("r0", "r1", None):
        values = sorted(i * i % 977 for i in range(3000) if (f"r{i % 2}" if i % 5 else None) == run and i % 9)
        assert got[run]["proc_n"] == len(values)
        assert got[run]["proc_avg_ms"] == pytest.approx(np.mean(values))
        for name, p in requests.REPORTED.items():
            rank = np.searchsorted(values, got[run][f"proc_{name}_ms"], side="right") / len(values)
            assert abs(rank - p) < 0.03
    failed = spark.createDataFrame([("r", "1", 1, 2, 3, None, "boom")], schemas.RESULTS)
    row = requests.sketched_latency(requests.latency_sketches(failed)).first()
    assert row["e2e_n"] == 0 and row["e2e_p50_ms"] is None and row["e2e_avg_ms"] is None
