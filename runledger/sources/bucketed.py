"""Tables that are bucketed by their join keys, so that joins between them need no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from runledger.session import scratch_dir

#: Keys of the canonical tables by which they are joined again and again.
JOB_KEYS = ("run_id", "job_id")
REQUEST_KEYS = ("run_id", "request_id")


def save_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Write ``df`` as the catalog table ``table`` in ``buckets`` buckets of ``keys``, sorted by them, and return it.

    One shuffle here saves one for each later join or aggregation on these keys: tables with the same keys
    in the same order and the same number of buckets are read bucket by bucket.  Rows are dealt out by
    the buckets' own hash first, so that each bucket is one file.  This is for tables of one row
    for each key, as of jobs or requests, whose buckets are even.  A key that holds a large share of the rows
    fills one bucket, and a bucket is one task: keep events of few jobs, or rows whose keys are mostly null,
    in plain tables, which the adaptive skew join splits.  Rows with null keys are kept.  ``path``: where the
    files lie; otherwise the warehouse.  A table of that name is an error.
    """
    missing = [k for k in keys if k not in df.columns]
    if missing or not keys:
        raise ValueError(f"no columns to bucket by: {missing or 'none given'}")
    if buckets < 1:
        raise ValueError(f"buckets must be 1 or more, not {buckets}")
    writer = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def scratch_bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """As ``save_bucketed``, under a name of its own below the shared folder."""
    path = scratch_dir(df.sparkSession)
    return save_bucketed(df, f"runledger_{path.rsplit('/', 1)[-1]}", keys, buckets, path)


def buckets_for(spark: SparkSession, rows: int, rows_a_bucket: int = 5_000_000) -> int:
    """Buckets of some ``rows_a_bucket`` rows, a power of two, so that tables of unlike size still fit:
    where one number of buckets divides the other, Spark can read the larger one's together
    (``spark.sql.bucketing.coalesceBucketsInJoin.enabled``).  At least as many as the session's tasks, rounded up."""
    least = max(spark.sparkContext.defaultParallelism, -(-rows // rows_a_bucket), 1)
    return 1 << (least - 1).bit_length()
