import hashlib
from fractions import Fraction
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from runledger.llm.mixing import mix

TREE = ["domain", "lang", "source"]


def fill(budget, children):
    """{name: tokens} by water-filling in fractions, rounded as documented."""
    open_, given = dict(children), {}
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = {n for n, (w, c) in open_.items() if c <= Fraction(budget * w, weight or 1)} if budget or weight else set(open_)
        if not full:
            parts = {n: budget * w // weight for n, (w, _) in open_.items()}
            odd = budget - sum(parts.values())
            given |= {n: p + (i < odd) for i, (n, p) in enumerate(sorted(parts.items()))}
            break
        for n in full:
            given[n] = open_.pop(n)[1]
            budget -= given[n]
    return given


def brute(rows, weights, share, epochs, seed):
    """{doc_id: copies}; rows are (doc_id, domain, lang, source, tokens)."""
    def weight(path):
        return weights.get(path, 1)

    def capacity(path):
        return sum(t for _, *p, t in rows if tuple(p[:len(path)]) == path
                   and all(weight(tuple(p[:i])) for i in (1, 2, 3))) * epochs

    out = {}

    def down(path, budget):
        names = sorted({tuple(p[:len(path) + 1]) for _, *p, _ in rows if tuple(p[:len(path)]) == path}, key=lambda p: p[-1])
        for child, given in fill(budget, {n: (weight(n), capacity(n)) for n in names}).items():
            if len(child) < 3:
                down(child, given)
                continue
            mine = [(i, t) for i, *p, t in rows if tuple(p) == child]
            total = sum(t for _, t in mine)
            full, rest = divmod(given, total) if total else (0, 0)
            keyed = sorted((hashlib.md5(f"{seed}:{full}:{i}".encode()).hexdigest(), i, t) for i, t in mine)
            before = 0
            for _, same in groupby(keyed, key=lambda k: k[0]):
                same = list(same)
                for _, i, _ in same:
                    out[i] = full + (before < rest)
                before += sum(t for *_, t in same)

    down((), int(sum(r[-1] for r in rows) * share))
    return {i: n for i, n in out.items() if n}


WEIGHTS = {("a",): 5, ("b",): 2, ("a", "en"): 3, ("a", "de"): 0, ("b", "en", "s1"): 7}


@pytest.mark.parametrize("share, epochs", [(0.3, 2), (0.9, 1), (1.6, 3), (0.0, 1), (9.0, 2)])
def test_equals_fractions(spark, share, epochs, monkeypatch):
    monkeypatch.setattr("runledger.llm.mixing._MOST_AT_END", 3)
    rows = [(i, "abc"[i % 7 % 3], ["en", "de", "fr"][i % 5 % 3], f"s{i * i % 4}", 1 + i * 37 % 50) for i in range(240)]
    rows += [(1000 + i, "b", "en", "s1", 11) for i in range(160)]  # a hot leaf
    df = spark.createDataFrame(rows, "doc_id bigint, domain string, lang string, source string, t bigint")
    df = df.withColumn("key", F.lit("x")).withColumn("full", F.lit("y"))
    out = mix(df, [F.col(c) for c in TREE], WEIGHTS, share, epochs, seed=4, tokens=F.col("t"))
    assert out.columns == [*df.columns, "copies"]
    assert {r.doc_id: r.copies for r in out.collect()} == brute(rows, WEIGHTS, share, epochs, 4)


def test_edge_rows(spark, documents):
    df = documents((1, None), (2, ""), (None, "a b"), (3, "a b", None, None), (3, "a b", None, None), (4, "w " * 100_000))
    tree = [F.col("lang"), F.col("source")]
    assert sorted((repr(r.doc_id), r.copies) for r in mix(df, tree, {}, share=3.0, max_epochs=2).collect()) == [
        ("1", 2), ("2", 2), ("3", 2), ("3", 2), ("4", 2), ("None", 2)]
    some = mix(df, tree, {}, share=0.00003, max_epochs=1).collect()  # 3 of 100 006 tokens, 2 for the null node
    assert [r.doc_id for r in some].count(3) == 2
    assert mix(df.limit(0), tree, {}).count() == 0


def test_clashing_name(documents):
    docs = documents((1, "a b"), copies="x")
    with pytest.raises(ValueError):
        mix(docs, [F.col("lang")], {})
    got = mix(docs, [F.col("lang")], {}, share=1.0, copies="times")
    assert [(r.copies, r.times) for r in got.collect()] == [("x", 1)]
