"""Row numbers, running sums and look-back windows inside ordered groups.

A group may hold a third of all rows, and all its rows may have nearly the same order
value, so no window ever covers a whole group or a fixed width of values.  The rows are
dealt out by ranges of (group, order), whose bounds Spark samples from the data, sorted and
written once with a running number; each range is a chunk.  A chunk of a group gets what the
group's earlier chunks add up to, from a table of one row for each group and chunk.  Chunks
are of even size whatever the values are, and stay the same when a task runs again, since they
are read from what was written.

Null keys are a group like any other.  ``order`` should be unique inside a group; rows
that tie get their places in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from runledger.session import write_scratch

#: Rows of a block in look-back windows.
BLOCK_ROWS = 100_000

_AT, _CHUNK, _ROW, _BLOCK, _HOME, _CONTEXT = "__at", "__chunk", "__row", "__block", "__home", "__context"


def _ordering(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def cut_by_range(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], path: str | None = None,
) -> DataFrame:
    """``df`` sorted by (keys, order) in chunks of even size, written once (to ``path``, else
    to the scratch folder).

    Adds the chunk's number and a number that rises with the order by one from row to row
    inside a chunk.
    """
    ordering = [*_ordering(keys), *_ordering(order)]
    ranged = df.repartitionByRange(*ordering).sortWithinPartitions(*ordering)
    cut = write_scratch(ranged.withColumn(_AT, F.monotonically_increasing_id()), path)
    # the upper bits are the number of the task that wrote the row
    return cut.withColumn(_CHUNK, F.shiftright(_AT, 33))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` in which nulls match; keeps the left side's keys.

    A very frequent key on the left is split at run time by Spark's adaptive skew join;
    a small right side is broadcast, which needs no shuffle at all.
    """
    extra = [c for c in right.columns if c not in keys]
    left, right = left.alias("__left"), right.alias("__right")
    same = [F.col(f"__left.{k}").eqNullSafe(F.col(f"__right.{k}")) for k in keys]
    return left.join(right, same, how).select("__left.*", *[F.col(f"__right.{c}") for c in extra])


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: Mapping[str, Column],
    totals: Mapping[str, str] | None = None,
    path: str | None = None,
) -> DataFrame:
    """Add a running sum per group for each of ``sums`` (name -> whole-number expression).

    ``totals`` names columns for the group's whole sum: {sum name: total name}.  ``path``: where
    to write the sorted rows, instead of a scratch folder.
    """
    totals = totals or {}
    chunked = cut_by_range(df, keys, order, path)
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = chunked.groupBy(*keys, _CHUNK).agg(
        *[F.sum(expr).alias(name) for name, expr in sums.items()]
    ).select(
        *keys, _CHUNK,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__before_{n}") for n in sums],
        *[F.sum(n).over(group).alias(f"__total_{n}") for n in sums if n in totals],
        F.count(F.lit(1)).over(group).alias("__chunks"),
    )
    if not totals:  # a group of one chunk carries nothing
        carry = carry.filter("__chunks > 1")
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumns({name: F.sum(expr).over(inside) for name, expr in sums.items()})
    joined = null_safe_join(local, carry.drop("__chunks"), [*keys, _CHUNK])
    return joined.withColumns({
        **{n: F.col(n) + F.coalesce(F.col(f"__before_{n}"), F.lit(0)) for n in sums},
        **{t: F.col(f"__total_{n}") for n, t in totals.items()},
    }).drop(_AT, _CHUNK, *[f"__before_{n}" for n in sums], *[f"__total_{n}" for n in totals])


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str, path: str | None = None,
) -> DataFrame:
    """Add the row's position (bigint, from 1) in its group.

    Inside a chunk the position follows from the written numbers, so that the rows need no
    window; they meet one row for each group and chunk.
    """
    chunked = cut_by_range(df, keys, order, path)
    earlier = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = chunked.groupBy(*keys, _CHUNK).agg(F.min(_AT).alias("__first"), F.count(F.lit(1)).alias("__n")).select(
        *keys, _CHUNK, (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) + 1 - F.col("__first")).alias("__shift"))
    placed = null_safe_join(chunked, starts, [*keys, _CHUNK])
    return placed.withColumn(name, F.col(_AT) + F.col("__shift")).drop(_AT, _CHUNK, "__shift")


def with_lookback(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    lookback: int,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    block_rows: int | None = None,
    path: str | None = None,
) -> DataFrame:
    """Add window columns that look at most ``lookback`` rows back; see look_back."""
    return look_back(number_rows(df, keys, order, _ROW, path), keys, _ROW, lookback, columns, block_rows).drop(_ROW)


def look_back(
    numbered: DataFrame,
    keys: Sequence[str],
    row: str,
    lookback: int,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    block_rows: int | None = None,
) -> DataFrame:
    """Add window columns to rows that are numbered from 1 by ``row``.

    ``columns`` builds them from an ordered window; later ones may use earlier ones.  Groups are
    cut into blocks of equal row count; the last ``lookback`` rows of a block are also given to
    the next one as context and dropped again afterwards.  ``keys`` may cut the numbered
    groups further.
    """
    rows = max(block_rows or BLOCK_ROWS, lookback)
    position = F.col(row) - 1
    home, after = F.col(_HOME), F.col(_HOME) + 1
    is_tail = position % rows >= rows - lookback
    blocks = (
        numbered.withColumn(_HOME, F.floor(position / rows))
        .withColumn(_BLOCK, F.explode(F.when(is_tail, F.array(home, after)).otherwise(F.array(home))))
        .withColumn(_CONTEXT, F.col(_BLOCK) != home)
    )
    window = Window.partitionBy(*keys, _BLOCK).orderBy(row)
    for name, column in columns(window).items():
        blocks = blocks.withColumn(name, column)
    return blocks.filter(~F.col(_CONTEXT)).drop(_HOME, _BLOCK, _CONTEXT)
