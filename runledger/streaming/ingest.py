"""Continuous intake of submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger import schemas
from runledger.operators.submissions import check_jobs, tag_submissions


def read_submissions(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream over JSON-lines submission files, a bounded number per trigger."""
    return (
        spark.readStream.schema(schemas.SUBMISSIONS)
        .option("maxFilesPerTrigger", files_per_trigger).json(path)
    )


def sort_submissions(events: DataFrame) -> DataFrame:
    """Add ``sink``: accepted or rejected jobs, requests, or unknown types."""
    checked = check_jobs(tag_submissions(events))
    sink = (
        F.when(F.col("kind") != "job", F.col("kind"))
        .when(F.col("reject_reason").isNotNull(), "rejected").otherwise("accepted")
    )
    is_job = F.col("kind") == "job"
    return checked.withColumns({
        "sink": sink,
        **{c: F.when(is_job, F.col(c)) for c in ("reject_reason", "status", "error_message")},
    }).drop("kind")


def stream_ingest(
    submissions: DataFrame, path: str, checkpoint: str, **trigger,
) -> StreamingQuery:
    """Write each trigger's submissions below ``path``, one folder per sink.

    All sinks of a trigger are one write, and a trigger that is run again overwrites
    its own folder, so no submission is lost or doubled.  ``trigger``: as for
    DataStreamWriter.trigger; all available data if not given.
    """
    def save(batch: DataFrame, epoch: int) -> None:
        sort_submissions(batch).write.mode("overwrite").partitionBy("sink").parquet(f"{path}/epoch={epoch}")

    return (
        submissions.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
