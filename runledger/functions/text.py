"""Text helpers for model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character that counts as white space when outputs are trimmed.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_prompt(decoded: Column, prompt: Column) -> Column:
    """The part of a decoded text that follows the prompt, trimmed.

    A decoded text no longer than its prompt is kept whole.
    """
    tail = F.substring(decoded, F.char_length(prompt) + 1, F.char_length(decoded))
    kept = F.when(F.char_length(decoded) > F.char_length(prompt), tail).otherwise(decoded)
    return F.btrim(kept, F.lit(WHITE_SPACE))
