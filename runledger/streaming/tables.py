"""Tables that a stream writes in every trigger, and the state it carries from one to the next.

A trigger overwrites the folders of its own number only, and reads what the one before it
wrote, so that a trigger which runs again after a failure writes the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Buckets of a state table: one has to fit a task.
BUCKETS = 32


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that no later trigger reads."""
    place, files = _at(spark, path)
    files.delete(place, True)


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    place, files = _at(spark, path)
    out = files.create(place, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def _get_text(spark: SparkSession, path: str) -> str:
    place, files = _at(spark, path)
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of all triggers' rows the newest for each key."""
    saved = spark.read.parquet(path)
    row = F.struct(*[c for c in saved.columns if c not in (*keys, "epoch")])
    return saved.groupBy(*keys).agg(F.max_by(row, F.col("epoch")).alias("r")).select(*keys, "r.*")


def each_trigger(
    stream: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str, **trigger,
) -> StreamingQuery:
    """Run ``save`` on every trigger; all available data if no trigger is given."""
    def kept(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            save(batch, epoch)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(kept)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


class BucketState:
    """State rows by hash bucket of their keys; a trigger rewrites only the buckets it touches.

    ``path``/epoch=e/bucket=b holds the rows of a bucket that trigger e wrote.  The manifest
    of a trigger names for each bucket the trigger that wrote it last, so that other buckets are
    carried on without being read, and the latest event time so far.

    Rows have a column ``seen_us``.  With ``idle_us`` those that were last seen so long before the
    latest event time of all earlier triggers are dead: they are not loaded any more, a bucket of
    dead rows alone leaves the manifest, and a few buckets with dead rows are rewritten in
    every trigger.  That time comes from the events, so that a trigger decides alike when
    it runs again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str],
                 buckets: int = BUCKETS, idle_us: int | None = None):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, list(keys)
        self.buckets, self.idle_us = buckets, idle_us

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifest(self, epoch: int) -> dict:
        if epoch < 0:
            return {"seen_us": None, "buckets": {}}
        found = json.loads(_get_text(self.spark, f"{self.path}/manifest/epoch={epoch}"))
        return found | {"buckets": {int(b): entry for b, entry in found["buckets"].items()}}

    def _dead_before(self, manifest: dict) -> int | None:
        if self.idle_us is None or manifest["seen_us"] is None:
            return None
        return manifest["seen_us"] - self.idle_us

    def touched(self, batch: DataFrame) -> dict[int, int | None]:
        """Buckets of the keys in ``batch``, with the latest seen_us in each."""
        found = batch.groupBy(self.bucket().alias("b")).agg(F.max("seen_us").alias("seen_us")).collect()
        return {r.b: r.seen_us for r in found}

    def load(self, epoch: int, touched: Mapping[int, int | None]) -> tuple[DataFrame, set[int]]:
        """Living rows of the buckets that trigger ``epoch`` rewrites, and their numbers: those
        that are touched, and some with dead rows."""
        before = self._manifest(epoch - 1)
        loaded, dead = set(touched), self._dead_before(before)
        if dead is not None:
            old = sorted((e["oldest"], b) for b, e in before["buckets"].items() if e["oldest"] < dead <= e["newest"])
            loaded |= {b for _, b in old[:max(1, self.buckets // 16)]}
        written: dict[int, list[int]] = {}
        for b in loaded & set(before["buckets"]):
            written.setdefault(before["buckets"][b]["epoch"], []).append(b)
        if not written:
            return self.spark.createDataFrame([], self.schema), loaded
        rows = self.spark.read.option("basePath", self.path).schema(f"{self.schema}, epoch int, bucket int").parquet(
            *[f"{self.path}/epoch={e}" for e in written])
        wanted = F.lit(False)
        for e, buckets in written.items():
            wanted |= (F.col("epoch") == e) & F.col("bucket").isin(buckets)
        rows = rows.filter(wanted).drop("epoch", "bucket")
        return (rows if dead is None else rows.filter(F.col("seen_us") >= dead)), loaded

    def save(self, rows: DataFrame, epoch: int, loaded: set[int], touched: Mapping[int, int | None]) -> DataFrame:
        """Write ``rows``, all that the loaded buckets hold now, and the manifest; read the
        rows back."""
        before = self._manifest(epoch - 1)
        folder = f"{self.path}/epoch={epoch}"
        rows.withColumn("bucket", self.bucket()).repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema(f"{self.schema}, bucket int").parquet(folder)
        dead = self._dead_before(before)
        entries = {b: e for b, e in before["buckets"].items() if b not in loaded and (dead is None or e["newest"] >= dead)}
        if self.idle_us is None:
            place, files = _at(self.spark, folder)
            names = [f.getPath().getName() for f in files.listStatus(place)]
            entries |= {int(n.removeprefix("bucket=")): {"epoch": epoch} for n in names if n.startswith("bucket=")}
        else:
            stats = written.groupBy("bucket").agg(F.min("seen_us").alias("oldest"), F.max("seen_us").alias("newest"))
            entries |= {r.bucket: {"epoch": epoch, "oldest": r.oldest, "newest": r.newest} for r in stats.collect()}
        times = [t for t in (before["seen_us"], *touched.values()) if t is not None]
        manifest = {"seen_us": max(times, default=None), "buckets": entries}
        _put_text(self.spark, f"{self.path}/manifest/epoch={epoch}", json.dumps(manifest))
        self._clean(epoch, before)
        return written.drop("bucket")

    def _clean(self, epoch: int, before: dict) -> None:
        """Remove what only trigger ``epoch`` - 1 could have read: that trigger is done."""
        place, files = _at(self.spark, f"{self.path}/manifest/epoch={epoch - 2}")
        if not files.exists(place):  # a trigger that runs again may have cleaned up before
            return
        older = self._manifest(epoch - 2)
        kept = {e["epoch"] for e in before["buckets"].values()}
        for written in {e["epoch"] for e in older["buckets"].values()}:
            gone = [b for b, e in older["buckets"].items()
                    if e["epoch"] == written and before["buckets"].get(b, {}).get("epoch") != written]
            for folder in [f"epoch={written}"] if written not in kept else [f"epoch={written}/bucket={b}" for b in gone]:
                drop_folder(self.spark, f"{self.path}/{folder}")
        files.delete(place, False)
