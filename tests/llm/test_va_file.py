import numpy as np
from pyspark.sql import functions as F

from runledger.llm.va_file import top_k


def brute(vectors, k, queries):
    out = set()
    for q in queries:
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i)
                        for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def found(df):
    return {tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


def test_equals_brute_force_with_ties_blocks_and_outliers(spark):
    rng = np.random.default_rng(3)
    rows = {i: rng.normal(0, 0.2, 16).tolist() for i in range(300)}
    for i in range(40, 120):
        rows[i] = rows[40]  # a third of all rows alike
    rows[7] = [x * 1e4 for x in rows[7]]
    df = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<float>").withColumn("tile", F.lit("x"))
    ints = {r.vec_id: [int(np.floor(64 * float(x))) for x in r.embedding] for r in df.collect()}
    queries = [i for i in rows if i % 20 == 0]
    for bits, block in ((6, 32), (2, 1000)):
        assert found(top_k(df, F.col("vec_id") % 20 == 0, 5, bits=bits, block_rows=block)) == brute(ints, 5, queries)


def test_large_values_stay_exact(spark):
    rows = [(0, [2.0 ** 24, 3.0]), (1, [2.0 ** 24, 1.0]), (2, [2.0 ** 24, 2.0]), (3, [-(2.0 ** 24), 9.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    ints = {i: [int(64 * x) for x in v] for i, v in rows}
    assert found(top_k(df, F.lit(True), 3)) == brute(ints, 3, range(4))


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    same = 64 * 64 + 128 * 64
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 20 == 0).collect()), key=repr) == [
        (0, 1, 1, same), (0, 2, 1, same), (0, 3, None, same)]
    assert top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [3.0, 1.0]), (20, [3.0, 1.0]), (5, [2.0, 0.0]), (None, [9.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = top_k(df, F.col("vec_id") % 20 == 0, 3).collect()
    by_query = sorted(tuple(r) for r in got if r.vec_id is not None)
    assert len(got) == 9 and [r for r in got if r.vec_id is None and r.rank == 1].__len__() == 3
    assert by_query == [(20, 2, 20, 3 * 64 * 64), (20, 2, 20, 10 * 64 * 64), (20, 2, 20, 10 * 64 * 64),
                        (20, 3, 5, 6 * 64 * 64), (20, 3, 5, 6 * 64 * 64), (20, 3, 20, 3 * 64 * 64)]


def test_copies_of_the_queries_are_not_broadcast(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(0, 0.2, 8).tolist()) for i in range(400)], "vec_id bigint, embedding array<float>")
    plan = top_k(df, F.col("vec_id") % 20 == 0, 5, block_rows=16)._jdf.queryExecution().executedPlan().toString()
    tiled = [line for line in plan.splitlines() if "Join" in line and "tile#" in line]
    assert len(tiled) == 2 and all("SortMergeJoin" in line for line in tiled), tiled
