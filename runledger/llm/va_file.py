"""Exact top-k search by inner product with a vector-approximation file.

The vectors are packed into blocks.  A block holds the exact integer vectors and, for
each component, its cell on a grid of ``2 ** bits`` equal steps between the block's
smallest and largest value.  A query's inner product with the low corner of a vector's
cells, plus constants of the query, bounds its score from both sides.

1. Scan: every query block meets every vector block and gives, for each query, the k-th
   largest lower bound.  The largest of these over the blocks is a score that k
   vectors reach.
2. Read: vectors whose upper bound reaches that score are read exactly, in order of
   their bounds, until no unread one can enter the block's k best.
3. The blocks' results are merged, k rows for each query.

Blocks meet by an equi-join on a tile number, so that neither side passes through the
driver or one task whole.  A tile holds several vector blocks, by their bytes, and a copy of
every query block; the copies are shuffled, never broadcast.  Work is rows x queries, as the set of
queries demands, but only on one byte for a component; exact vectors are read for the
survivors alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.operators.ordered import cut_by_range
from runledger.session import write_scratch

_BLOCK = "block_key bigint, dim int, n int, ids binary, low binary, step binary, cells binary, vectors binary"
_FOUND = "query_id bigint, vec_id bigint, score bigint"
#: Bytes of vector blocks in a tile.  Each tile gets a copy of all queries, so that more tiles than tasks are a waste.
_TILE_BYTES = 32 << 20
_EXACT = 2.0 ** 53


def integer_vectors(embeddings: DataFrame, id_column: str, vector_column: str, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, for every row but those with a null
    vector or a null, NaN or infinite component."""
    x = F.col(vector_column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        embeddings.filter(finite)
        .select(
            F.col(id_column).cast("bigint").alias("vec_id"),
            F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"),
        )
    )


def _pack(rows: int, bits: int):
    cells = 1 << bits

    def block(number: int, ids: np.ndarray, v: np.ndarray) -> tuple:
        kind = next(t for t in (np.int16, np.int32, np.int64)
                    if not v.size or (v.min() >= np.iinfo(t).min and v.max() <= np.iinfo(t).max))
        low, high = (v.min(0), v.max(0)) if v.size else (np.zeros(v.shape[1], np.int64),) * 2
        # object arithmetic: the range of a component may exceed 64 bits
        step = np.array([(int(h) - int(b)) // cells + 1 for b, h in zip(low, high)], np.float64)
        code = np.minimum((v.astype(np.float64) - low) // np.maximum(step, 1), cells - 1).astype(np.uint8)
        return (number, v.shape[1], len(ids), ids.tobytes(), low.astype(np.int64).tobytes(),
                step.astype(np.int64).tobytes(), code.tobytes(), v.astype(kind).tobytes())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def flush(dim: int) -> pd.DataFrame:
            nonlocal number
            ids, vectors = zip(*held.pop(dim))
            made = block(number, np.array(ids, np.int64),
                         np.array(vectors, np.int64).reshape(len(ids), dim))
            number += 1
            return pd.DataFrame([made], columns=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for vec_id, v in zip(batch["vec_id"], batch["v"]):
                held.setdefault(len(v), []).append((vec_id, v))
                if len(held[len(v)]) >= rows:
                    yield flush(len(v))
        for dim in list(held):
            yield flush(dim)

    return pack


def _narrow(packed: bytes, n: int, dim: int) -> np.ndarray:
    width = len(packed) // max(1, n * dim)
    return np.frombuffer(packed, {2: np.int16, 4: np.int32}.get(width, np.int64)).reshape(n, dim)


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.ids, np.int64), _narrow(row.vectors, row.n, row.dim)


def _unpack_queries(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.q_ids, np.int64), _narrow(row.q_vectors, row.q_n, row.dim).astype(np.int64)


def _bounds(row, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Low-corner products (vectors x queries); what bounds add below and above; whether
    all products fit a double without rounding."""
    low, step = np.frombuffer(row.low, np.int64), np.frombuffer(row.step, np.int64)
    cells = np.frombuffer(row.cells, np.uint8).reshape(row.n, row.dim)
    q = queries.astype(np.float64)
    corner = low.astype(np.float64) + cells * step.astype(np.float64)
    reach = float((np.abs(q).max(0, initial=0) * (np.abs(corner).max(0, initial=0) + step)).sum())
    product = corner @ q.T
    spread = step.astype(np.float64) - 1
    under, over = np.minimum(q, 0) @ spread, np.maximum(q, 0) @ spread
    exact = reach < _EXACT
    if not exact:  # rounding must not narrow the bounds
        under, over = under - reach * 1e-9, over + reach * 1e-9
    return product, under, over, exact


def _scan(k: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                query_ids, queries = _unpack_queries(row)
                ids, _ = _unpack(row)
                product, under, _, _ = _bounds(row, queries)
                lower = product + under
                # a query's own row is no candidate
                place = {i: p for p, i in enumerate(ids)}
                for j, own in enumerate(query_ids):
                    if own in place:
                        lower[place[own], j] = -np.inf
                if row.n >= k:
                    reached = np.partition(lower, row.n - k, axis=0)[row.n - k]
                    yield pd.DataFrame({"q_key": row.q_key, "place": np.arange(row.q_n), "reached": reached})

    return scan


def _read(k: int, chunk: int = 256):
    def products(vectors: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return vectors.astype(np.float64) @ query
        full = [sum(int(a) * int(b) for a, b in zip(v, query)) for v in vectors]
        return np.array(full, dtype=object)

    def best(ids, vectors, upper, own, query, reached, exact) -> list[tuple[int, int]]:
        found: list[tuple] = []  # (-score, id), the k best so far
        open_ = np.flatnonzero((upper >= reached) & (ids != own))
        open_ = open_[np.lexsort((ids[open_], -upper[open_]))]
        for at in range(0, len(open_), chunk):
            part = open_[at:at + chunk]
            if len(found) == k and upper[part[0]] < -found[-1][0]:
                break  # certain: no unread vector reaches the k-th score
            score = products(vectors[part], query, exact)
            found = sorted([*found, *zip((-score).tolist(), ids[part].tolist())])[:k]
        return [(i, -s) for s, i in found]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, bottom = 2 ** 63 - 1, -2 ** 63
        for batch in batches:
            for row in batch.itertuples(index=False):
                query_ids, queries = _unpack_queries(row)
                ids, vectors = _unpack(row)
                product, _, over, exact = _bounds(row, queries)
                rows = []
                reached = np.full(row.q_n, -np.inf)
                if row.places is not None:
                    reached[np.asarray(row.places, np.int64)] = row.values
                for j in range(row.q_n):
                    query = queries[j].astype(np.float64) if exact else queries[j]
                    for vec_id, score in best(ids, vectors, product[:, j] + over[j], query_ids[j],
                                              query, reached[j], exact):
                        rows.append((int(query_ids[j]), vec_id, min(top, max(bottom, int(score)))))
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"], dtype=np.int64)

    return read


def top_k(
    embeddings: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    bits: int = 6,
    block_rows: int = 4096,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Each query's ``k`` highest integer inner products: (query_id, rank, vec_id, score).

    ``is_query`` picks the queries, as a condition on ``vec_id``; candidates are all rows
    but the query's own.  Ties go to the smaller id, null last; with fewer than k candidates
    all are returned.  Rows that share an id, or have none, are rows like any other: each is a
    candidate, and each that ``is_query`` picks a query with results of its own under
    that id.  Vectors of other lengths than the query's are no candidates.
    Components beyond a long are cut to it by ``floor``, scores beyond one by this
    operator.  Empty tables give no rows; other columns are not read.
    """
    spark = embeddings.sparkSession
    # rows are numbered in the order of their ids, so that ties go by the number
    numbered = cut_by_range(integer_vectors(embeddings, id_column, vector_column, scale), [], [F.col("vec_id").asc_nulls_last()])
    vectors = numbered.select(F.col("__at").alias("row"), "vec_id", "v")
    as_rows = [F.col("row").alias("vec_id"), "v"]
    parts = max(spark.sparkContext.defaultParallelism, -(-vectors.count() // block_rows))
    blocks = write_scratch(vectors.select(as_rows).repartition(parts).mapInPandas(_pack(block_rows, bits), _BLOCK))
    asked = vectors.filter(is_query)
    query_parts = -(-asked.count() // block_rows) or 1
    packed = asked.select(as_rows).repartition(query_parts).mapInPandas(_pack(block_rows, bits), _BLOCK)
    queries = write_scratch(packed.select(
        F.col("block_key").alias("q_key"), "dim", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"),
        F.col("vectors").alias("q_vectors")))
    size = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("cells") + F.length("vectors")).alias("bytes")).first()
    tasks = 4 * spark.sparkContext.defaultParallelism
    tiles = max(1, min(size.n, max(tasks, -(-(size.bytes or 0) // _TILE_BYTES))))
    # the upper bits number the tasks that packed the blocks, so that tiles are even
    placed = blocks.withColumn("tile", F.pmod(F.shiftright("block_key", 32), F.lit(tiles)))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint")))

    def tiled(side: DataFrame) -> DataFrame:
        # Spark takes the copies for as small as what is copied: without the hint it would broadcast them all
        return side.withColumn("tile", copies).hint("merge").join(placed, ["tile", "dim"])

    reached = (
        tiled(queries).mapInPandas(_scan(k), "q_key bigint, place int, reached double")
        .groupBy("q_key", "place").agg(F.max("reached").alias("reached"))
        # at most block_rows entries for a query block
        .groupBy("q_key").agg(F.collect_list(F.struct("place", "reached")).alias("reached"))
        .select("q_key", F.col("reached.place").alias("places"), F.col("reached.reached").alias("values"))
    )
    found = tiled(queries.join(reached, "q_key", "left")).mapInPandas(_read(k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def ids(name: str) -> DataFrame:
        return vectors.select(F.col("row").alias(f"{name}_row"), F.col("vec_id").alias(name))

    return (
        ranked.select(F.col("query_id").alias("query_id_row"), "rank", F.col("vec_id").alias("vec_id_row"), "score")
        .join(ids("query_id"), "query_id_row").join(ids("vec_id"), "vec_id_row")
        .select("query_id", "rank", "vec_id", "score")
    )
