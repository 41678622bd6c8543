import hashlib

import pytest
from pyspark.sql import functions as F

from helpers import rows
from runledger import schemas
from runledger.functions.tokens import from_encoder
from runledger.operators import examples


@pytest.fixture
def samples(spark):
    data = [("a", i, f"word{i} " * (i + 1)) for i in range(6)] + [("b", 0, "x"), ("b", 1, "")]
    return spark.createDataFrame(data, schemas.SAMPLES)


@pytest.mark.parametrize("side", ["left", "right"])
def test_encoding(samples, side):
    for row in examples.encode_samples(samples, max_length=4, pad_side=side).collect():
        text = f"word{row['sample_idx']} " * (row["sample_idx"] + 1) if row["job_id"] == "a" else (
            "x" if row["sample_idx"] == 0 else "")
        ids = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 32000 for w in text.split()][:4]
        gap = 4 - len(ids)
        pad = (lambda v, fill: [fill] * gap + v) if side == "left" else (lambda v, fill: v + [fill] * gap)
        assert row["input_ids"] == pad(ids, 0)
        assert row["attention_mask"] == pad([1] * len(ids), 0)
        assert row["labels"] == [-100 if i == 0 else i for i in row["input_ids"]]


def test_own_tokenizer_and_pad_id_in_text(spark, samples):
    encoded = examples.encode_samples(
        samples.filter("job_id = 'b'"), from_encoder(lambda s: [ord(c) for c in s]), max_length=2, pad_id=120)
    assert rows(encoded.select("sample_idx", "input_ids", "labels")) == [
        (0, [120, 120], [-100, -100]), (1, [120, 120], [-100, -100])]
    assert rows(encoded.select("sample_idx", "attention_mask")) == [(0, [0, 1]), (1, [0, 0])]


@pytest.mark.parametrize("limit", [2, 10_000])
@pytest.mark.parametrize("n", [1, 4, 6, 20])
def test_upsample(samples, small_groups, monkeypatch, limit, n):
    small_groups(limit)
    monkeypatch.setattr(examples, "_COPIES", 3)
    out = examples.upsample_cyclic(samples, n).select("job_id", "position", "sample_idx")
    assert rows(out) == sorted(
        ((j, i, i % count) for j, count in (("a", 6), ("b", 2)) for i in range(n)), key=repr)


def test_upsample_renumbers_samples_with_gaps(spark):
    samples = spark.createDataFrame([("a", 5, "x"), ("a", 9, "y")], "job_id string, sample_idx bigint, text string")
    out = examples.upsample_cyclic(samples, 4).select("position", "sample_idx", "text")
    assert rows(out) == [(0, 0, "x"), (1, 1, "y"), (2, 0, "x"), (3, 1, "y")]


@pytest.mark.parametrize("limit", [3, 10_000])
def test_shuffle(samples, small_groups, limit):
    small_groups(limit)
    out = examples.shuffle_batches(samples, epochs=2, batch_size=4, seed=3)
    got = rows(out)
    assert got == rows(examples.shuffle_batches(samples.repartition(3), epochs=2, batch_size=4, seed=3))
    for epoch in (0, 1):
        mine = sorted((b, p, i) for j, e, b, p, i in got if j == "a" and e == epoch)
        assert [(b, p) for b, p, _ in mine] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)]
        drawn = sorted(range(6), key=lambda i: hashlib.md5(f"a|{epoch}|{i}|3".encode()).hexdigest())
        assert [i for _, _, i in mine] == drawn


def test_stats(spark, samples):
    jobs = spark.createDataFrame(
        [("a", 4, 10, 3), ("b", 5, None, 0), ("none", 1, 2, 9)],
        "job_id string, batch_size int, max_steps int, current_step int")
    assert rows(examples.sample_stats(samples, jobs)) == [
        ("a", 6, 2, 7, 5, False), ("b", 2, 1, 0, None, False), ("none", 0, 0, 0, None, True)]
    report = examples.truncation_report(samples, max_length=3)
    assert rows(report) == [("a", 6, 15, 6, 3, 3), ("b", 2, 1, 0, 5, 0)]
