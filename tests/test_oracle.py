"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from check_oracle import duck, normal
from runledger.plans import catalog

DIRECTORY = "/root/testdata/sf0.001"
QUERIES = {name: entry_module.queries()[name] for name in catalog.QUERIES}
ORACLES = {name: entry_module.oracle_sql()[name] for name in catalog.ORACLES}

pytestmark = pytest.mark.skipif(not Path(DIRECTORY).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return duck(DIRECTORY)


def compare(spark, connection, name):
    frame = QUERIES[name](spark, DIRECTORY)
    result = connection.execute(ORACLES[name])
    want = normal([d[0] for d in result.description], result.fetchall())
    assert normal(frame.columns, [tuple(r) for r in frame.collect()]) == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, connection, name):
    compare(spark, connection, name)


@pytest.mark.parametrize("name", [
    "batch_infer", "cumulative_success", "fifo_batches", "interleave_jobs", "job_gantt", "job_rollup",
    "latency_box", "latency_summary", "loss_delta", "loss_history", "queue_depth", "rolling_progress",
    "route_requests", "run_summary", "shuffle_batches", "step_progress", "upsample_cyclic",
])
def test_query_with_large_groups(spark, connection, small_groups, name):
    small_groups(40_000_000)
    compare(spark, connection, name)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 5
