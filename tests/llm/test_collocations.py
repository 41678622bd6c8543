import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from runledger.llm import collocations, entry
from runledger.llm.collocations import Grams, Transducer


def made(phrases):
    words = sorted({w for p in phrases for w in p})
    number = {w: i for i, w in enumerate(words)}
    depth = max(map(len, phrases))
    rows = sorted([number[w] for w in p] + [-1] * (depth - len(p)) for p in phrases)
    weights = [phrases[tuple(words[i] for i in r if i >= 0)] for r in rows]
    return Transducer.build(words, Grams(np.array(rows), np.array(weights)))


def accepted(t, grams=None):
    labels, weights = grams or t.paths()
    return {tuple(t.words[i] for i in row if i >= 0): int(w) for row, w in zip(labels, weights)}


def random_phrases(rng):
    return {tuple(rng.choices([b"a", b"b", b"c", b"d", b"e"], k=rng.randrange(1, 5))): rng.choice([1, 1, 2, 30]) for _ in range(rng.randrange(1, 80))}


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_transducers(monkeypatch, chunk):
    monkeypatch.setattr(collocations, "_CHUNK", chunk)
    rng = random.Random(3)
    for _ in range(100):
        one, two, three = (random_phrases(rng) for _ in range(3))
        assert accepted(made(one)) == one
        assert accepted(Transducer.load(made(one).dump())) == one
        both, sums, words = Transducer.union([made(one), made(two), made(three)], least=2)
        want = Counter(one) + Counter(two) + Counter(three)
        assert accepted(both) == {p: n for p, n in want.items() if n >= 2}
        assert {tuple(words[i] for i in r if i >= 0): n for r, n in zip(sums.labels, sums.weights)} == want
        assert accepted(*made(one).compose(made(two))) == {p: two[p] for p in one if p in two}


def test_equal_states_are_stored_once():
    phrases = {p: 1 for p in product([b"a", b"b", b"c", b"d", b"e", b"f"], repeat=4)}
    t = made(phrases)
    assert len(t.first) - 1 == 5 and len(t.label) == 24


def brute(rows):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split(r"[ \t]", piece) if w]
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    key = (lang, tuple(words[i:i + size]))
                    f[key] = f.get(key, 0) + 1
    best = {}
    for (lang, phrase), a in f.items():
        if len(phrase) < 2 or a < 10:
            continue
        cuts = []
        for k in range(1, len(phrase)):
            left, right = f[lang, phrase[:k]], f[lang, phrase[k:]]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        if len(phrase) == 2 and any(
                len(p) == 3 and g == lang and b >= 10 and 100 * b >= 50 * a and phrase in (p[:2], p[1:])
                for (g, p), b in f.items()):
            continue
        score, _, left, right = min(cuts)
        best.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in best.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(found)[:2000], 1))


@pytest.mark.parametrize("shard, range_bytes", [(2_000_000, 8 << 20), (50, 200)])
def test_query_equals_brute_force(spark, documents, tmp_path, monkeypatch, shard, range_bytes):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "RANGE_BYTES", range_bytes)
    rng = random.Random(5)
    words = ["the", "The", "of", "é", "Éa", "x|y", "zz", " ", "\U0001f600", "new", "york"]

    def text():
        parts = rng.choices(words, k=rng.randrange(0, 40)) + ["new york city"] * rng.randrange(3)
        return "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for p in parts)

    rows = [(i, text(), rng.choice(["en", "en", "de", None, "und"])) for i in range(120)]
    rows += [(1, None, "en"), (None, "a b " * 20, "fr"), (2, "", None), (3, " .,;", "xx"), *rows[:9]]
    documents(*rows, f="f", words="w", rank="k", range="r").write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.QUERIES["op11_phrase_collocations"](spark, str(tmp_path))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 20


def test_empty_table_and_counts_beyond_64_bits(spark, documents):
    assert collocations.collocations(documents().limit(0)).count() == 0
    big = spark.sql("SELECT 4000000000000L AS a, 5000000000000L AS l, 6000000000000L AS r").selectExpr(
        "CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) * a div (CAST(l AS DECIMAL(19,0)) * r) AS s")
    assert big.first().s == 1000000 * 4 * 4 // (5 * 6)


def test_longer_phrases(documents):
    text = "a b c d e. " * 12
    found = {r.phrase: r.a for r in collocations.collocations(documents((1, text)), longest=5).collect()}
    assert found == {"a b c d e": 12}
