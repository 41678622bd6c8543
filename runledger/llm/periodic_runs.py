"""Periodic runs of words: stretches in which a block of words comes three times or more.

A run is a stretch of consecutive words whose smallest period is q (words q apart are
identical), at least max(``least_words``, ``least_periods`` * q) long, that no neighbouring
word extends.  Each text is searched in two steps:

1. Recursive frequency splitting.  A word of a run comes in it at least ``least_periods``
   times, so a word that comes less often inside the current segment is in no run of the
   segment, and splits it.  The pieces are split again by their own counts until nothing
   changes.  A segment is read from both ends at once, so that a split costs its smaller piece.
2. Lag scan of the segments that survive.  The lag of a place is the distance to where its
   next 1, 2, 4, ... words come again.  Inside a run of period q every block of q to 2q - 1
   words comes again after q words exactly, so the places of one run have one lag at the level
   of q, and each maximal stretch of equal lags is a maximal run.  A level keeps only the
   places whose block is repeated, so ordinary text ends after few levels.

A text is one row and is searched in one task; the work is n log n in its number of words.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.batches import map_rows

# What a word is and what makes a run.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST_WORDS, LEAST_PERIODS = 24, 3

_STEP = 64

Run = tuple[int, int, int]  # start, length, period


def segments(ids: np.ndarray, least_words: int = LEAST_WORDS, often: int = LEAST_PERIODS) -> list[tuple[int, int]]:
    """(start, stop) of the longest segments in which every word comes ``often`` times or more."""
    n = len(ids)
    if n < least_words:
        return []
    order = np.argsort(ids, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    same = ids[order]

    def nth(step: int, none: int) -> np.ndarray:
        """For each word the place of its step-th next occurrence, or ``none``."""
        at = place + step
        inside = (at >= 0) & (at < n)
        at = np.where(inside, at, 0)
        return np.where(inside & (same[at] == ids), order[at], none)

    # a word comes often enough in [lo, hi) if for some j its j-th last and its
    # (often - 1 - j)-th next occurrence both lie inside
    before = [np.arange(n), *(nth(-j, -1) for j in range(1, often))]
    after = [np.arange(n), *(nth(j, n) for j in range(1, often))]

    def rare(lo: int, hi: int, first: int, last: int) -> np.ndarray:
        part = slice(first, last)
        enough = np.zeros(last - first, bool)
        for j in range(often):
            enough |= (before[j][part] >= lo) & (after[often - 1 - j][part] < hi)
        return first + np.flatnonzero(~enough)

    found, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least_words:
            continue
        left, right, step = lo, hi, _STEP
        cuts = np.empty(0, np.int64)
        while left < right and not len(cuts):
            low, high = min(left + step, right), max(right - step, min(left + step, right))
            cuts = np.concatenate([rare(lo, hi, left, low), rare(lo, hi, high, right)])
            left, right, step = low, high, step * 2
        if not len(cuts):
            found.append((lo, hi))
            continue
        edges = np.concatenate([[lo - 1], cuts, [hi]])
        long = np.flatnonzero(np.diff(edges) > least_words)
        todo += [(int(edges[i]) + 1, int(edges[i + 1])) for i in long]
    return sorted(found)


def runs_by_lag(ids: np.ndarray, least_words: int = LEAST_WORDS, often: int = LEAST_PERIODS) -> list[Run]:
    """All runs of ``ids``, by the distance to where blocks of 1, 2, 4, ... words come again."""
    n, size = len(ids), 1
    rank = pd.factorize(ids)[0].astype(np.int64)
    at = np.arange(n)  # places whose block of ``size`` words is looked at
    found = []
    while len(at) and (size // 2 + 1) * often <= n:
        order = np.argsort(rank[at], kind="stable")
        places = at[order]
        kinds = rank[places]
        again = kinds[:-1] == kinds[1:]
        lag = np.zeros(n + 1, np.int64)
        lag[places[:-1]] = np.where(again, places[1:] - places[:-1], 0)
        lag[(lag <= size // 2) | (lag > size)] = 0
        edges = np.flatnonzero(np.diff(lag, prepend=0))  # the last lag is 0, so stretches end
        for first, stop in zip(edges[:-1], edges[1:]):
            q = int(lag[first])
            length = int(stop - first) - 1 + q + size
            if q and length >= max(least_words, often * q):
                found.append((int(first), length, q))
        repeated = np.zeros(n + 1, bool)
        repeated[places[:-1][again]] = repeated[places[1:][again]] = True
        at = np.flatnonzero(repeated[:n])
        at = at[at + size < n]
        at = at[repeated[at + size]]
        pairs = rank[at] * (n + 1) + rank[at + size]
        rank = np.full(n, -1, np.int64)
        rank[at] = pd.factorize(pairs)[0]
        size *= 2
    return sorted(found, key=lambda run: (run[0], run[2]))


def find_runs(words: list[str], least_words: int = LEAST_WORDS, often: int = LEAST_PERIODS) -> list[Run]:
    """(start, length, period) of all runs, by start and period."""
    if len(words) < least_words:
        return []
    ids = pd.factorize(np.array(words, dtype=object))[0]
    return [(lo + start, length, q) for lo, hi in segments(ids, least_words, often)
            for start, length, q in runs_by_lag(ids[lo:hi], least_words, often)]


def collapse(words: list[str], runs: Iterable[Run]) -> list[str]:
    """The words that stand in no run after that run's first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [word for word, depth in zip(words, np.cumsum(change[:-1])) if not depth]


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_MEASURES = ("n_runs long, start long, length long, period long, exponent_milli long, "
             "runs_sha256 string, collapsed_sha256 string, collapsed string, runs array<struct<start:long,length:long,period:long>>")


def measure(words: list[str]) -> tuple:
    """The values of _MEASURES for one text's words."""
    runs = find_runs(words)
    best: tuple = (None,) * 4
    if runs:
        # exact fractions: length / period as a whole number of billionths could tie wrongly
        start, length, q = runs[0]
        for s, n, p in runs[1:]:
            if n * q > length * p:
                start, length, q = s, n, p
        best = (start, length, q, 1000 * length // q)
    kept = " ".join(collapse(words, runs)) if runs else " ".join(words)
    return (len(runs), *best, _sha256("".join("%d,%d,%d\n" % run for run in runs)), _sha256(kept), kept,
            [dict(zip(("start", "length", "period"), run)) for run in runs])


def periodic_runs(
    docs: DataFrame, columns: Iterable[str], change: Callable[[list[str], int | None], list[str]] | None = None,
) -> DataFrame:
    """doc_id and ``columns`` of _MEASURES for every row of ``docs`` (doc_id, text).

    n_runs counts the runs; start, length, period and exponent_milli belong to the one with the
    greatest length / period (ties: smallest start, then period) and are null without runs;
    ``runs`` lists all of them and ``collapsed`` is the text's words without repeated periods.
    ``change`` may replace a text's words by others, given them and the doc_id.  A null or empty
    text has no words; repeated rows and null ids are rows like any other; other columns are
    not read; an empty table gives an empty one.
    """
    columns = list(columns)
    schema = {field.split()[0]: field for field in _MEASURES.split(", ")}
    at = [list(schema).index(c) for c in columns]

    def make(ids: list, texts: list) -> list[list]:
        out = []
        for doc_id, text in zip(ids, texts):
            words = WORD.findall(text or "")
            measured = measure(change(words, doc_id) if change else words)
            out.append([measured[i] for i in at])
        return [ids, *(list(column) for column in zip(*out))]

    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_rows(named, make, "doc_id long, " + ", ".join(schema[c] for c in columns), rows=64)


def plant_period(words: list[str], doc_id: int | None) -> list[str]:
    """The words of a tenth of the documents, chosen by doc_id, made periodic from some word on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(b"%d" % doc_id)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]
