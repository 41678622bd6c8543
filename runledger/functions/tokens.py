"""Tokenizers: functions from a text column and a number of tokens to array<int>.

A tokenizer may return more tokens than asked for; the rest is cut off.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column, int], Column]

_SPACE = " \\t\\n\\r\\f"


def words(text: Column, limit: int | None = None) -> Column:
    """Words of a text, split at runs of blanks, tabs and line ends; the first
    ``limit`` ones if given."""
    if limit is None:
        return F.filter(F.split(text, f"[{_SPACE}]+"), lambda word: word != "")
    # One more piece for a leading separator and one for the unsplit rest.
    pieces = F.split(text, f"[{_SPACE}]+", limit + 2)
    return F.slice(F.filter(pieces, lambda word: word != ""), 1, limit)


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{_SPACE}]+"))


def hashed_words(vocabulary: int = 32_000) -> Tokenizer:
    """Whitespace words, each numbered by its md5; runs without Python workers."""

    def number(word: Column) -> Column:
        return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % vocabulary).cast("int")

    return lambda text, limit: F.transform(words(text, limit), number)


def from_encoder(encode: Callable[[str], Sequence[int]]) -> Tokenizer:
    """Wrap any text -> ids function as an Arrow-batched tokenizer."""

    @F.pandas_udf("array<int>")
    def tokenize(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: [int(i) for i in encode(text or "")])

    return lambda text, limit: tokenize(text)
