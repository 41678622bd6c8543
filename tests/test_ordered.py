"""Chunked windows against brute force, with one group of half the rows and a null key."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import rows
from runledger.operators.ordered import (
    cut_by_range, null_safe_join, number_rows, running_sums, with_lookback,
)
from runledger.operators.quantiles import percentiles


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    keys = ["hot"] * 300 + ["a"] * 40 + ["b"] * 7 + [None] * 60 + [f"k{i}" for i in range(50)]
    table = [(k, rng.randrange(20), i, rng.randrange(-3, 9)) for i, k in enumerate(keys)]
    rng.shuffle(table)
    return table


@pytest.fixture
def frame(spark, data):
    return spark.createDataFrame(data, "k string, ts int, id int, v int")


def grouped(data):
    groups = defaultdict(list)
    for row in data:
        groups[row[0]].append(row)
    return {k: sorted(g, key=lambda r: (r[1], r[2])) for k, g in groups.items()}


@pytest.mark.parametrize("limit", [1, 5, 10_000])
def test_numbers_and_sums(frame, data, small_groups, limit):
    small_groups(limit)
    numbered = number_rows(frame, ["k"], ["ts", "id"], "no")
    assert rows(numbered.select("id", "no")) == sorted(
        ((r[2], i) for g in grouped(data).values() for i, r in enumerate(g, 1)), key=repr)
    summed = running_sums(frame, ["k"], ["ts", "id"], {"s": F.col("v")}, {"s": "all"})
    want = []
    for group in grouped(data).values():
        total = 0
        for row in group:
            total += row[3]
            want.append((row[2], total, sum(r[3] for r in group)))
    assert rows(summed.select("id", "s", "all")) == sorted(want, key=repr)


def test_a_run_of_one_second_is_dealt_evenly(spark):
    """Nearly all rows belong to one run and lie inside one second."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "211")
    spark.conf.set(names[1], "false")
    try:
        busy = spark.range(60_000).select(F.lit("r").alias("run"), (F.col("id") * 7919 % 60_000 + 1_000_000).alias("ts"), "id")
        other = spark.range(300).select(F.lit("q").alias("run"), (F.col("id") * 3_600_000_000).alias("ts"), "id")
        sizes = sorted(r["count"] for r in cut_by_range(busy.union(other), ["run"], ["ts"]).groupBy("__chunk").count().collect())
        assert len(sizes) == 211 and sizes[-1] < 3 * sizes[105] and sum(sizes) == 60_300
        numbered = number_rows(busy.union(other), ["run"], ["ts"], "no")
        assert numbered.filter("run = 'r' AND no <> ts - 999999").count() == 0
        assert numbered.filter("run = 'q' AND no <> id + 1").count() == 0
        summed = running_sums(busy, ["run"], ["ts"], {"s": F.col("ts") - 1_000_000})
        assert summed.filter("s <> (ts - 1000000) * (ts - 999999) / 2").count() == 0
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


@pytest.mark.parametrize("limit, lookback", [(5, 4), (7, 1), (3, 9), (10_000, 4)])
def test_lookback(frame, data, small_groups, limit, lookback):
    small_groups(limit)
    out = with_lookback(
        frame, ["k"], ["ts", "id"], lookback,
        lambda w: {"recent": F.collect_list("v").over(w.rowsBetween(-lookback, 0))})
    want = [(r[2], [x[3] for x in g[max(0, i - lookback):i + 1]])
            for g in grouped(data).values() for i, r in enumerate(g)]
    assert rows(out.select("id", "recent")) == sorted(want, key=repr)


def test_percentiles(spark, frame, data):
    np = pytest.importorskip("numpy")
    named = frame.withColumn("x", F.when(~F.col("k").eqNullSafe("b"), F.col("v") / 7.0))
    wanted = {"x": {"p50": 0.5, "p99": 0.99}}
    out = percentiles(named, ["k"], wanted, [F.count("id").alias("n")])
    got = {r["k"]: (r["n"], r["p50"], r["p99"]) for r in out.collect()}
    for key, group in grouped(data).items():
        n, p50, p99 = got[key]
        assert n == len(group)
        if key == "b":
            assert p50 is None and p99 is None
            continue
        values = [r[3] / 7.0 for r in group]
        assert p50 == pytest.approx(np.percentile(values, 50))
        assert p99 == pytest.approx(np.percentile(values, 99))
    for parts in (1, 7):  # the same digits however the rows lie
        again = percentiles(named.repartition(parts), ["k"], wanted, [F.count("id").alias("n")])
        assert rows(again) == rows(out)


def test_percentiles_by_selection(spark):
    """Groups large enough for brackets, one of them with few different values, one with NaN."""
    np = pytest.importorskip("numpy")
    df = spark.range(90_000).selectExpr(
        "CASE id % 3 WHEN 0 THEN 'wide' WHEN 1 THEN 'few' END AS k",
        "CASE id % 3 WHEN 1 THEN id % 30 / 8 WHEN 0 THEN pmod(xxhash64(id), 1000003) / 7 "
        "ELSE if(id = 2, double('NaN'), log(id)) END AS x", "cast(id % 1000 as int) AS y")
    wanted = {"x": {"x0": 0.0, "x25": 0.25, "x99": 0.99}, "y": {"y50": 0.5, "y100": 1.0}}
    data = df.toPandas()
    for accuracy in (100, 10_000):
        got = {r["k"]: r.asDict() for r in percentiles(df, ["k"], wanted, [F.sum("y").alias("s")], accuracy=accuracy).collect()}
        for key in ("wide", "few", None):
            group = data[data.k.isna()] if key is None else data[data.k == key]
            assert got[key]["s"] == group.y.sum()
            for column, named in wanted.items():
                values = np.sort(group[column].to_numpy())
                for name, p in named.items():
                    assert got[key][name] == pytest.approx(np.percentile(values[~np.isnan(values)], 100 * p), rel=1e-3 if key is None else 1e-12)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_null_safe_join(spark, frame, data, how):
    lookup = spark.createDataFrame([("hot", 1), ("a", 2), ("zzz", 3), (None, 4)], "k string, x int")
    want = {"hot": 1, "a": 2, None: 4}
    out = null_safe_join(frame, lookup, ["k"], how).select("id", "x")
    expected = [(r[2], want.get(r[0])) for r in data if how == "left" or r[0] in want]
    assert rows(out) == sorted(expected, key=repr)


def test_empty_input(spark):
    empty = spark.createDataFrame([], "k string, ts int, id int, v int")
    assert number_rows(empty, ["k"], ["ts", "id"], "no").count() == 0
