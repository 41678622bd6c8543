"""The registered queries: their names, and those with SQL against it on the smallest tables."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from check_oracle import duck, normal
from runledger.llm import entry

DIRECTORY = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    names = entry_module.queries()
    numbers = [int(m[1]) for name in names if (m := re.match(r"op(\d+)_", name))]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in names
    assert set(entry.ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.skipif(not Path(DIRECTORY).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_query_equals_its_sql(spark, name):
    frame = entry.QUERIES[name](spark, DIRECTORY)
    result = duck(DIRECTORY).execute(entry.ORACLES[name])
    want = normal([d[0] for d in result.description], result.fetchall())
    assert normal(frame.columns, [tuple(r) for r in frame.collect()]) == want
