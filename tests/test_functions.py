import math
import os.path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runledger.functions import losses, paths, text, timing, tokens


def evaluate(spark, schema, data, column):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column).collect()]


def test_adapter_id_equals_normalised_basename(spark):
    given_paths = [
        "./adapters/job_1", "./adapters/job_1/", "adapters//job_1/./", "/srv/a/b/", "a/b/..", "a/b/../c",
        "a/./b/../../d/", "..", "../..", "a/..", "/", "/a/..", ".", "x", "a/.hidden", "a/b./", "./", "//", "a/b/././/.", "/..", "./../y/../z", "a/../..",
    ]
    got = evaluate(spark, "i int, p string", list(enumerate(given_paths)), paths.adapter_id(F.col("p")))
    assert got == [os.path.basename(os.path.normpath(p)) for p in given_paths]


def test_no_path_is_the_base_model(spark):
    assert evaluate(spark, "p string", [(None,), ("",)], paths.adapter_id(F.col("p"))) == ["Base Model"] * 2


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=12), st.text(max_size=6)), min_size=20, max_size=40))
def test_strip_prompt_equals_python(spark, pairs):
    clean = [(a.replace("\x00", ""), b.replace("\x00", "")) for a, b in pairs]
    clean = [(a.encode("utf8", "ignore").decode(), b.encode("utf8", "ignore").decode()) for a, b in clean]
    clean += [("hello world", "hello"), ("hi", "hi"), ("  x　", ""), ("short", "longer prompt")]
    got = evaluate(spark, "d string, p string", clean, text.strip_prompt(F.col("d"), F.col("p")))
    assert got == [(d[len(p):] if len(d) > len(p) else d).strip() for d, p in clean]


def test_parse_loss_equals_float(spark):
    raw = ["0.90", " 1e-3 ", "-.5", "5.", "invalid", "", "1.0f", "2d", "0x1p3", "nan", "inf", "-Infinity",
           "1,5", "--1", "+3", None]
    got = evaluate(spark, "i int, r string", list(enumerate(raw)), losses.parse_loss(F.col("r")))

    def as_float(value):
        try:
            return None if value is None else float(value)
        except ValueError:
            return None

    for value, have in zip(raw, got):
        want = as_float(value)
        assert have == want or (want is not None and math.isnan(want) and math.isnan(have)), value


@pytest.mark.parametrize("rate, forward, reverse", [
    (None, "stagnated", "other"), (0.001, "progressing", "struggling"), (0.0009, "stagnated", "struggling"),
    (0.005, "progressing", "other"), (float("nan"), "stagnated", "other"), (float("inf"), "progressing", "other"),
])
def test_classes(spark, rate, forward, reverse):
    df = spark.createDataFrame([(rate,)], "rate double").select(
        losses.forward_class(F.col("rate"), 0.001), losses.reverse_class(F.col("rate"), 0.005))
    assert tuple(df.first()) == (forward, reverse)


def test_micros_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'1970-01-02 00:00:00.000001' AS ts")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert df.select(timing.to_micros(F.col("ts"))).first()[0] == 86_400_000_001
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_tokenizers(spark):
    df = spark.createDataFrame([("  a b\ta\n",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(tokens.words(F.col("text"))).collect()] == [["a", "b", "a"], [], None]
    for limit in (1, 2, 3, 4):
        assert df.select(tokens.words(F.col("text"), limit)).first()[0] == ["a", "b", "a"][:limit]
    assert [r[0] for r in df.select(tokens.count_words(F.col("text"))).collect()] == [3, 0, None]
    encode = tokens.from_encoder(lambda s: [len(w) for w in s.split()])
    assert [r[0] for r in df.select(encode(F.col("text"), 9)).collect()] == [[1, 1, 1], [], []]
