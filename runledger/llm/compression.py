"""Quality rules by zstandard ratio: too repetitive or too random text is rejected.

The ratio is bytes of UTF-8 over compressed bytes.  Short texts compress badly, so the
limits depend on length.  The whole document is measured, and each chunk of fixed size,
so that a long document with one repetitive part is judged by that part's share.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Band(NamedTuple):
    """Ratio limits of texts with fewer than ``below`` bytes."""
    below: float
    least: float
    most: float


BANDS = (
    Band(256, 0.3, 5.0), Band(1024, 0.9, 5.0), Band(8192, 1.35, 5.0), Band(float("inf"), 1.4, 6.0),
)
CHUNK = 4096
CHUNK_BAND = Band(float("inf"), 1.35, 5.0)
#: Share of a text's bytes that may lie in chunks outside the chunk limits, in percent.
BAD_CHUNKS = 25

_SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"


def repeat_words(words: Sequence[bytes], window: int = 5) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code = ids
    for size in range(1, window):  # equal numbers for equal runs, one word longer each time
        code = np.unique(code[:-1] * len(number) + ids[size:], return_inverse=True)[1]
    again = np.flatnonzero(np.bincount(code)[code] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode().split()  # bytes split at \x20 \x09-\x0D alone
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    return (
        len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)), repeat_words(words),
    )


class Ratios:
    """The verdict of the compression bands on one text."""

    def __init__(self, bands: Sequence[Band] = BANDS, chunk: int = CHUNK, chunk_band: Band = CHUNK_BAND,
                 bad_chunks: float = BAD_CHUNKS, level: int = 3):
        self.bands, self.chunk, self.chunk_band, self.bad_chunks = bands, chunk, chunk_band, bad_chunks
        self.compress = zstandard.ZstdCompressor(level=level).compress

    def ratio(self, raw: bytes) -> float:
        return len(raw) / len(self.compress(raw)) if raw else 0.0

    def judge(self, text: str | None) -> tuple[float, float, bool]:
        """(ratio of the whole, percent of bytes in bad chunks, kept).  An empty text has
        ratio 0 and is not kept."""
        raw = (text or "").encode()
        whole = self.ratio(raw)
        band = next(b for b in self.bands if len(raw) < b.below)
        bad = measured = 0
        starts = list(range(0, len(raw), self.chunk))
        if (len(raw) - (starts[-1] if starts else 0)) * 4 < self.chunk:
            starts.pop() if starts else None  # a short rest is measured with the chunk before it
        for at, stop in zip(starts, [*starts[1:], len(raw)]):
            part = raw[at:stop]
            measured += len(part)
            if not self.chunk_band.least <= self.ratio(part) <= self.chunk_band.most:
                bad += len(part)
        share = 100 * bad / measured if measured else 0.0
        return whole, share, band.least <= whole <= band.most and share <= self.bad_chunks


def quality(docs: DataFrame, **limits) -> DataFrame:
    """Measures and verdict for every row of ``docs`` (doc_id, text).

    base_failed: fewer than 10 words, or over 20 % of the words in repeated windows.
    kept: false where base_failed, else whether the ratios lie in their bands (``limits``
    go to ``Ratios``).  Null texts count as empty and fail.  Repeated rows and null
    doc_ids keep their rows; an empty table gives none; other columns are not read.
    """
    out = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
           "n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, bad_chunk_percent double")
    names = [c.split()[0] for c in out.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratios = Ratios(**limits)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found = measures(text)
                failed = found[0] < 10 or 100 * found[4] > 20 * found[0]
                whole, share, kept = ratios.judge(text)
                rows.append((doc_id, *found, failed, kept and not failed, whole, share))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(scan, out)
