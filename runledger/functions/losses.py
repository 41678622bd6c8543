"""Loss values and progress rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE_DECIMALS = 12

# What counts as a number in a loss field; Java alone would also take '1.0f' or '0x1p3'.
_NUMBER = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"


def parse_loss(raw: Column) -> Column:
    """Loss text as a double; null where it is not a number."""
    return F.when(raw.rlike(_NUMBER), F.trim(raw)).try_cast("double")


def mean_decrease(losses: Column) -> Column:
    """Mean drop from one loss to the next over an array in event order.

    Null with fewer than two losses.  Rounded, so that a flat history gives 0.
    """
    n = F.size(losses)
    drops = F.zip_with(F.slice(losses, 1, n - 1), F.slice(losses, 2, n - 1), lambda a, b: a - b)
    total = F.aggregate(drops, F.lit(0.0), lambda acc, drop: acc + drop)
    return mean_of_drops(total, n)


def mean_of_drops(total: Column, n: Column) -> Column:
    """mean_decrease from the sum of the drops between ``n`` losses."""
    return F.when(n >= 2, F.round(total / (n - 1), RATE_DECIMALS))


def forward_class(rate: Column, threshold: float) -> Column:
    known = F.coalesce(rate, F.lit(0.0))
    progressing = ~F.isnan(known) & (known >= threshold)
    return F.when(progressing, F.lit("progressing")).otherwise(F.lit("stagnated"))


def reverse_class(rate: Column, threshold: float) -> Column:
    struggling = rate.isNotNull() & ~F.isnan(rate) & (rate < threshold)
    return F.when(struggling, F.lit("struggling")).otherwise(F.lit("other"))
