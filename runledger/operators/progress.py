"""Loss progress of training jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions import losses as loss_functions
from runledger.operators.jobs import EVENT_ORDER, JOB
from runledger.operators.ordered import look_back, number_rows, running_sums, with_lookback

# Event types and the defaults of the progress policies.
LOSS_EVENTS = ("STEP_COMPLETED", "METRICS_REPORTED")
COMPLETION_EVENTS = ("STEP_COMPLETED", "METRICS_REPORTED", "STATUS_UPDATE")
HISTORY_WINDOW = 10
STAGNATION_THRESHOLD = 0.001
SLOW_THRESHOLD = 0.005


def history_events(events: DataFrame) -> DataFrame:
    """Events that change a loss history: usable losses, and completions (``done``).

    A loss on a completion event does not count.
    """
    named = events.filter(F.col("job_id").isNotNull() & (F.col("job_id") != ""))
    completed = (F.col("status") == schemas.COMPLETED) & F.col("event_type").isin(*COMPLETION_EVENTS)
    done = F.coalesce(completed, F.lit(False))
    loss = F.when(~done & F.col("event_type").isin(*LOSS_EVENTS),
                  loss_functions.parse_loss(F.col("loss_raw")))
    return named.select(*JOB, *EVENT_ORDER, done.alias("done"), loss.alias("loss")).filter(
        F.col("done") | F.col("loss").isNotNull())


def parse_losses(events: DataFrame) -> DataFrame:
    """Events that carry a usable loss."""
    return history_events(events).filter(~F.col("done")).drop("done")


def loss_delta(losses: DataFrame) -> DataFrame:
    """Previous loss minus this one, per job in event order; positive is improving."""
    return with_lookback(
        losses, JOB, EVENT_ORDER, 1,
        lambda window: {"delta": F.lag("loss").over(window) - F.col("loss")})


def rolling_progress(events: DataFrame, history_window: int = HISTORY_WINDOW) -> DataFrame:
    """Progress rate after each loss, over the last ``history_window`` losses since
    the job's latest completion."""
    if history_window < 2:
        raise ValueError("history_window must be at least 2")
    return rolling_rates(history_events(events), history_window)


def rolling_rates(changes: DataFrame, history_window: int, path: str | None = None) -> DataFrame:
    """rolling_progress over rows of history_events; other columns stay.  ``path``: as for
    running_sums."""
    # one pass numbers the histories of a job and the losses in them
    done = F.col("done").cast("bigint")
    marked = running_sums(changes, JOB, EVENT_ORDER, {"segment": done, "__row": 1 - done}, path=path)
    losses = marked.filter(~F.col("done")).drop("done")

    def rate(window):
        size = F.count("loss").over(window.rowsBetween(1 - history_window, 0))
        drops = F.sum("__drop").over(window.rowsBetween(2 - history_window, 0))
        return {
            "__drop": F.lag("loss").over(window) - F.col("loss"),
            "history_size": size.cast("int"),
            "rate": loss_functions.mean_of_drops(drops, F.col("history_size")),
        }

    return look_back(losses, [*JOB, "segment"], "__row", history_window - 1, rate).drop("__row", "__drop")


def newest_changes(changes: DataFrame, history_window: int) -> DataFrame:
    """The last ``history_window`` losses and completions of each job; only so many leave
    each task."""
    newest = [F.col(c).desc() for c in EVENT_ORDER]
    place = F.row_number().over(Window.partitionBy(*JOB, "done").orderBy(*newest))
    return changes.withColumn("__rank", place).filter(F.col("__rank") <= history_window).drop("__rank")


def progress_rate(events: DataFrame, history_window: int = HISTORY_WINDOW) -> DataFrame:
    """Current rate per job: its last ``history_window`` losses after its last completion.

    Jobs without such a loss have no row.  Only that many losses and one completion
    per job leave each task.
    """
    at = F.struct(*EVENT_ORDER)
    kept = newest_changes(history_events(events), history_window).groupBy(*JOB).agg(
        F.max(F.when(F.col("done"), at)).alias("cleared"),
        F.array_sort(F.collect_list(F.when(~F.col("done"), F.struct(*EVENT_ORDER, "loss")))).alias("items"),
    )
    cleared = F.col("cleared")
    live = F.filter("items", lambda item: cleared.isNull()
                    | (F.struct(*[item[c].alias(c) for c in EVENT_ORDER]) > cleared))
    histories = kept.select(*JOB, F.transform(live, lambda item: item["loss"]).alias("losses"))
    return histories.filter(F.size("losses") > 0).select(
        *JOB,
        F.size("losses").alias("history_size"),
        F.element_at("losses", -1).alias("last_loss"),
        loss_functions.mean_decrease(F.col("losses")).alias("rate"),
    )


def classify_progress(
    jobs: DataFrame,
    progress: DataFrame,
    stagnation_threshold: float = STAGNATION_THRESHOLD,
    slow_threshold: float = SLOW_THRESHOLD,
) -> DataFrame:
    """Rate and both classes of every job, with or without a history."""
    rated = jobs.join(progress.select(*JOB, "rate"), JOB, "left")
    return rated.withColumns({
        "forward_class": loss_functions.forward_class(F.col("rate"), stagnation_threshold),
        "reverse_class": loss_functions.reverse_class(F.col("rate"), slow_threshold),
    })


def interleave_jobs(items: DataFrame, order: list[str]) -> DataFrame:
    """Fair order: the first item of every job by job id, then the second of each, ..."""
    numbered = number_rows(items, JOB, order, "turn")
    return numbered.orderBy("run_id", "turn", "job_id")
