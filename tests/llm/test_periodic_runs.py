import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from runledger.llm import entry, periodic_runs


def brute_runs(words, least=24):
    """Every lag, word by word."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 3 * q):
                part = words[i:i + length]
                if not any(all(part[k] == part[k + s] for k in range(length - s)) for s in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    words = []
    while len(words) < rng.randrange(10, 200):
        kind = rng.random()
        if kind < 0.4:
            words += [f"u{rng.random()}" for _ in range(rng.randrange(1, 30))]
        elif kind < 0.6:
            words += rng.choices("abc", k=rng.randrange(1, 60))
        else:
            block = rng.choices("abcdefgh", k=rng.randrange(1, 14))
            words += (block * 12)[:rng.randrange(5, 90)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(4)
    several = 0
    for _ in range(300):
        words = random_words(rng)
        runs = periodic_runs.find_runs(words)
        assert runs == brute_runs(words)
        several += len(runs) > 1
    assert several > 30


def test_nested_and_overlapping_runs():
    inner = ["a"] * 30 + ["b"]
    words = inner * 4 + ["x"]
    assert periodic_runs.find_runs(words) == brute_runs(words)
    assert len(periodic_runs.find_runs(words)) == 5
    assert periodic_runs.collapse(list("abcabcabcx"), [(0, 9, 3)]) == list("abcx")


def test_segments_are_stable_and_hold_all_runs():
    rng = random.Random(9)
    for _ in range(100):
        words = random_words(rng)
        ids = np.array([hash(w) % 10**9 for w in words])
        kept = periodic_runs.segments(ids)
        for lo, hi in kept:
            assert hi - lo >= 24
            assert all((ids[lo:hi] == i).sum() >= 3 for i in ids[lo:hi])
        for start, length, _ in brute_runs(words):
            assert any(lo <= start and start + length <= hi for lo, hi in kept)


def test_long_texts_take_little_time():
    started = time.time()
    chain = [w for i in range(60_000) for w in (i, i + 1, i + 2)]  # loses a few words at a time
    assert periodic_runs.segments(np.array(chain)) == []
    few = random.Random(1).choices("abcdefghij", k=300_000)
    assert periodic_runs.find_runs(few) == []
    same = ["a"] * 300_000
    assert periodic_runs.find_runs(same) == [(0, 300_000, 1)]
    long = ["b%d" % i for i in range(50_000)] * 4
    assert periodic_runs.find_runs(long) == [(0, 200_000, 50_000)]
    assert time.time() - started < 30


def brute_row(doc_id, text):
    words = [w for w in (text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        original = list(words)
        for i in range(a, n):
            words[i] = original[a + (i - a) % p]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


@pytest.fixture
def table(spark, documents, tmp_path):
    def write(df):
        df.write.parquet(str(tmp_path / "documents.parquet"))
        return entry.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    return write


def test_query_equals_brute_force(documents, table):
    rng = random.Random(2)
    rows = [(i, " \n\t".join(random_words(rng))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t "), (None, "a " * 40), (5, rows[5][1]), (5, "x " * 30), (203, "ä ö " * 20)]
    got = table(documents(*rows, words="w", runs="r", start="s"))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    result = sorted((tuple(r) for r in got.collect()), key=repr)
    assert result == sorted((brute_row(*r) for r in rows), key=repr)
    assert sum(r[1] for r in result) > 50


def test_empty_table(documents, table):
    assert table(documents().limit(0)).count() == 0
