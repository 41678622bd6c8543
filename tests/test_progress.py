"""Loss progress and the ranking policies on small literal inputs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from helpers import rows
from runledger.operators import progress, ranking

EVENTS = ("run_id string, job_id string, event_seq bigint, event_type string, ts_us bigint, "
          "loss_raw string, status string")
JOBS = "run_id string, job_id string, reg_seq int, current_step string"


def events_of(spark, histories):
    data = [("r", job, i, "STEP_COMPLETED", i, str(loss), None)
            for job, losses in histories.items() for i, loss in enumerate(losses)]
    return spark.createDataFrame(data, EVENTS)


def jobs_of(spark, steps):
    return spark.createDataFrame([("r", job, i, step) for i, (job, step) in enumerate(steps.items())], JOBS)


def rates(spark, histories, window=5):
    return {r["job_id"]: r["rate"] for r in
            progress.progress_rate(events_of(spark, histories), window).collect()}


def chosen(df):
    found = [r["job_id"] for r in df.collect()]
    assert len(found) <= 1
    return found[0] if found else None


@pytest.mark.parametrize("losses, rate", [
    ([1.0], None), ([1.0, 0.9, 0.8, 0.7], 0.1), ([0.7, 0.8, 0.9, 1.0], -0.1), ([0.8] * 4, 0.0),
])
def test_rate(spark, losses, rate):
    found = rates(spark, {"job1": losses})["job1"]
    assert found == (None if rate is None else pytest.approx(rate))


def test_rate_without_history(spark):
    assert rates(spark, {}) == {}


def histories(spark, events):
    data = [("r", "job1", i, kind, i, loss, status) for i, (kind, loss, status) in enumerate(events)]
    changes = progress.progress_rate(spark.createDataFrame(data, EVENTS), 5)
    return [(r["history_size"], r["last_loss"]) for r in changes.collect()]


def test_losses_from_both_event_types(spark):
    assert histories(spark, [("STEP_COMPLETED", "0.95", None), ("METRICS_REPORTED", "0.90", None)]) == [(2, 0.9)]


def test_bad_loss_is_ignored(spark):
    assert histories(spark, [("STEP_COMPLETED", "invalid", None)]) == []


def test_completion_clears_history(spark):
    events = [("STEP_COMPLETED", "0.8", None), ("STEP_COMPLETED", "0.7", None),
              ("STEP_COMPLETED", "0.6", "COMPLETED")]
    assert histories(spark, events) == []
    assert histories(spark, [*events, ("STEP_COMPLETED", "0.5", None)]) == [(1, 0.5)]


def test_failure_and_other_events_keep_history(spark):
    events = [("STEP_COMPLETED", "0.8", None), ("ANY_EVENT", "0.1", None), ("JOB_FAILED", None, "FAILED"),
              ("ANY_EVENT", None, "COMPLETED")]
    assert histories(spark, events) == [(1, 0.8)]


@pytest.mark.parametrize("losses, winner", [
    ({"job1": [.5, .4, .3], "job2": [.6, .6, .6], "job3": [.7, .7, .6995]}, "job1"),
    ({"job1": [.5, .5, .5], "job2": [.6, .7, .8]}, "job1"),
    ({"job2": [.5, .3], "job1": [.5, .3]}, "job2"),
    ({"job2": [float("nan"), .3], "job1": [.5, .5]}, "job1"),
    ({}, None),
])
def test_forward(spark, losses, winner):
    jobs = jobs_of(spark, dict.fromkeys(losses, "0"))
    rate = progress.progress_rate(events_of(spark, losses), 5)
    assert chosen(ranking.rank_forward(jobs, rate, 0.001)) == winner


@pytest.mark.parametrize("losses, winner", [
    ({"job1": [.5, .4, .3], "job2": [.6, .598, .597], "job3": [.7, .7, .6999]}, "job3"),
    ({"job1": [.5, .4, .3], "job2": [.6, .55, .5]}, "job1"),
    ({"job1": [.6, .598, .597], "job2": [.5, .4, .3], "job3": []}, "job1"),
    ({"job1": [], "job2": []}, "job1"),
    ({"job9": [.5, .5], "job1": [.5, .5]}, "job9"),
    ({"job1": [.5, float("nan")]}, "job1"),
    ({}, None),
])
def test_reverse(spark, losses, winner):
    jobs = jobs_of(spark, dict.fromkeys(losses, "0"))
    rate = progress.progress_rate(events_of(spark, losses), 5)
    assert chosen(ranking.rank_reverse(jobs, rate, 0.005)) == winner


@pytest.mark.parametrize("steps, winner", [
    ({"job1": "5"}, "job1"),
    ({"job1": "10", "job2": "5", "job3": "15"}, "job2"),
    ({"job1": "10", "job2": "5", "job3": "15", "job4": "5"}, "job2"),
    ({"job1": "10", "job2": "invalid", "job3": "5"}, "job3"),
    ({"job1": "10", "job2": None, "job3": "5"}, "job3"),
    ({"job1": "1.5"}, None),
    ({}, None),
])
def test_least_progress(spark, steps, winner):
    assert chosen(ranking.rank_least_progress(jobs_of(spark, steps))) == winner


def test_first_by_id_compares_strings(spark):
    assert chosen(ranking.first_by_id(jobs_of(spark, {"job2": "0", "job10": "0"}))) == "job10"


def test_registry(spark):
    jobs, none = jobs_of(spark, {"b": "1", "a": "2"}), progress.progress_rate(events_of(spark, {}))
    assert chosen(ranking.rank_jobs("LeastProgressFirst", jobs, none)) == "b"
    with pytest.warns(UserWarning, match="unknown policy"):
        assert chosen(ranking.rank_jobs("Nope", jobs, none)) == "a"
    ranking.register_policy("Newest", lambda j, p, k=1: j.orderBy(F.col("reg_seq").desc()).limit(k))
    assert chosen(ranking.rank_jobs("Newest", jobs, none)) == "a"
    assert "Newest" in ranking.policy_names()


def random_events(seed, n=400):
    rng = random.Random(seed)
    kinds = [("STEP_COMPLETED", None), ("METRICS_REPORTED", None), ("STATUS_UPDATE", "COMPLETED"),
             ("JOB_FAILED", "FAILED"), ("STEP_COMPLETED", "COMPLETED")]
    data = []
    for i in range(n):
        kind, status = rng.choices(kinds, [8, 6, 1, 1, 1])[0]
        loss = rng.choice(["bad", None, *(f"{rng.random():.4f}" for _ in range(6))])
        job = "hot" if rng.random() < 0.5 else f"j{rng.randrange(5)}"
        data.append(("r", job, i, kind, rng.randrange(n), loss, status))
    return data


def replay(data, window):
    """One event at a time: rate after each usable loss."""
    kept, out = {}, {}
    for _, job, seq, kind, ts, loss, status in sorted(data, key=lambda r: (r[4], r[2])):
        if kind in progress.COMPLETION_EVENTS and status == "COMPLETED":
            kept.pop(job, None)
            continue
        if kind not in progress.LOSS_EVENTS or loss in (None, "bad"):
            continue
        recent = kept.setdefault(job, deque(maxlen=window))
        recent.append(float(loss))
        drops = [a - b for a, b in zip(list(recent), list(recent)[1:])]
        out[seq] = (job, len(recent), round(sum(drops) / len(drops), 9) if drops else None)
    return kept, out


@pytest.mark.parametrize("limit", [9, 10_000])
@pytest.mark.parametrize("window", [2, 5])
def test_rolling_and_current_rate_equal_a_replay(spark, small_groups, limit, window):
    small_groups(limit)
    data = random_events(3)
    events = spark.createDataFrame(data, EVENTS)
    kept, steps = replay(data, window)
    rolling = progress.rolling_progress(events, window).select(
        "event_seq", "job_id", "history_size", F.round("rate", 9))
    assert rows(rolling) == sorted(((s, *v) for s, v in steps.items()), key=repr)
    current = progress.progress_rate(events, window).select("job_id", "history_size", "last_loss")
    assert rows(current) == sorted(((j, len(d), d[-1]) for j, d in kept.items()), key=repr)


@pytest.mark.parametrize("limit", [9, 10_000])
def test_loss_delta(spark, small_groups, limit):
    small_groups(limit)
    data = random_events(5, 120)
    losses = progress.parse_losses(spark.createDataFrame(data, EVENTS))
    previous, want = {}, []
    for _, job, seq, kind, ts, loss, status in sorted(data, key=lambda r: (r[4], r[2])):
        if status != "COMPLETED" and kind in progress.LOSS_EVENTS and loss not in (None, "bad"):
            want.append((seq, round(previous[job] - float(loss), 9) if job in previous else None))
            previous[job] = float(loss)
    got = progress.loss_delta(losses).select("event_seq", F.round("delta", 9))
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("limit", [3, 10_000])
def test_interleave(spark, small_groups, limit):
    small_groups(limit)
    items = spark.createDataFrame(
        [("r", "b", 1), ("r", "a", 2), ("r", "a", 5), ("r", "b", 4), ("r", "a", 9), ("r", "a", 11)],
        "run_id string, job_id string, at int")
    out = [(r["turn"], r["job_id"], r["at"]) for r in progress.interleave_jobs(items, ["at"]).collect()]
    assert out == [(1, "a", 2), (1, "b", 1), (2, "a", 5), (2, "b", 4), (3, "a", 9), (4, "a", 11)]
