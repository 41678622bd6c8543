"""Training examples from text samples (job_id, sample_idx, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.tokens import Tokenizer, count_words, hashed_words
from runledger.operators.ordered import null_safe_join, number_rows

# Example length, and the label that marks padding.
MAX_LENGTH = 128
IGNORED_LABEL = -100

_COPIES = 10_000


def encode_samples(
    samples: DataFrame,
    tokenizer: Tokenizer | None = None,
    max_length: int = MAX_LENGTH,
    pad_id: int = 0,
    pad_side: str = "left",
) -> DataFrame:
    """Fixed-length input ids, attention mask and labels of each sample.

    Every id equal to ``pad_id`` becomes -100 in the labels, padding or not.
    """
    if pad_side not in ("left", "right"):
        raise ValueError("pad_side must be left or right")
    tokenizer = tokenizer or hashed_words()
    tokens = samples.withColumn("__ids", F.slice(tokenizer(F.col("text"), max_length), 1, max_length))
    gap = F.lit(max_length) - F.size("__ids")

    def padded(values: Column, fill: int) -> Column:
        padding = F.array_repeat(F.lit(fill), gap)
        return F.concat(padding, values) if pad_side == "left" else F.concat(values, padding)

    ids = padded(F.col("__ids"), pad_id)
    mask = padded(F.transform("__ids", lambda _: F.lit(1)), 0)
    encoded = tokens.withColumns({"input_ids": ids, "attention_mask": mask})
    labels = F.transform("input_ids", lambda i: F.when(i == pad_id, IGNORED_LABEL).otherwise(i))
    return encoded.withColumn("labels", labels).select(
        "job_id", "sample_idx", "input_ids", "attention_mask", "labels")


def upsample_cyclic(samples: DataFrame, rows: int) -> DataFrame:
    """Exactly ``rows`` samples per job: position i takes sample i mod count.

    Samples are numbered anew from 0 in the order of ``sample_idx``, which may have gaps.
    """
    numbered = number_rows(samples, ["job_id"], ["sample_idx"], "__no")
    renumbered = numbered.withColumn("sample_idx", F.col("__no") - 1).drop("__no")
    counts = samples.groupBy("job_id").agg(F.count(F.lit(1)).alias("__n"))
    used = renumbered.filter(F.col("sample_idx") < rows)
    # Copies are numbered in two steps, so that no array grows with ``rows``.
    last = F.floor((F.lit(rows - 1) - F.col("sample_idx")) / F.col("__n"))
    first = F.col("__run") * _COPIES
    return (
        null_safe_join(used, counts, ["job_id"], "inner")
        .withColumn("__last", last)
        .withColumn("__run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("__last") / _COPIES))))
        .repartition("job_id", "sample_idx", "__run")  # copies of one sample are made on many tasks
        .withColumn("__copy", F.explode(F.sequence(first, F.least(F.col("__last"), first + (_COPIES - 1)))))
        .select("job_id", (F.col("sample_idx") + F.col("__copy") * F.col("__n")).alias("position"),
                "sample_idx", "text")
    )


def shuffle_batches(samples: DataFrame, epochs: int, batch_size: int, seed: int = 0) -> DataFrame:
    """A repeatable order of each job's samples for every epoch, cut into batches."""
    tickets = samples.select("job_id", "sample_idx", F.explode(
        F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")).withColumn(
        "__draw", F.md5(F.concat_ws("|", "job_id", "epoch", "sample_idx", F.lit(seed))))
    numbered = number_rows(tickets, ["job_id", "epoch"], ["__draw", "sample_idx"], "__no")
    place = F.col("__no") - 1
    return numbered.select(
        "job_id", "epoch", F.floor(place / batch_size).alias("batch"),
        (place % batch_size).alias("pos"), "sample_idx")


def sample_stats(samples: DataFrame, jobs: DataFrame) -> DataFrame:
    """Batches per epoch, steps to finish and epochs needed, per job.

    ``jobs`` gives job_id, batch_size, max_steps and current_step; jobs without a
    sample are flagged.
    """
    counts = samples.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    joined = jobs.join(counts, "job_id", "left").withColumn("n_samples", F.coalesce("n", F.lit(0)))
    batches = F.ceil(F.col("n_samples") / F.col("batch_size"))
    left = F.greatest(F.col("max_steps") - F.col("current_step"), F.lit(0))
    return joined.withColumn("n_batches", batches).select(
        "job_id", "n_samples", "n_batches",
        left.cast("bigint").alias("steps_left"),
        F.when(F.col("n_batches") > 0, F.ceil(F.col("max_steps") / F.col("n_batches")))
        .alias("epochs_needed"),
        (F.col("n_samples") == 0).alias("empty_dataset"),
    )


def truncation_report(
    samples: DataFrame, max_length: int = MAX_LENGTH,
    count_tokens: Callable[[Column], Column] = count_words,
) -> DataFrame:
    """Tokens kept, cut and padded per job at ``max_length``."""
    n = F.coalesce(count_tokens(F.col("text")), F.lit(0))
    counted = samples.select("job_id", n.cast("bigint").alias("n"))
    zero = F.lit(0).cast("bigint")
    return counted.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum(F.least(F.col("n"), F.lit(max_length))).alias("kept"),
        F.sum(F.greatest(F.col("n") - max_length, zero)).alias("cut"),
        F.sum(F.greatest(max_length - F.col("n"), zero)).alias("padded"),
        F.count_if(F.col("n") > max_length).alias("truncated_samples"),
    )
