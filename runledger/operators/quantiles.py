"""Percentiles with linear interpolation, per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.operators.ordered import null_safe_join

#: Relative rank error of the sketches is 1 / ACCURACY; brackets reach SLACK times as far.
ACCURACY, SLACK = 10_000, 3


def _bracketed(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, Mapping[str, float]], extra: Sequence[Column],
    accuracy: int,
) -> tuple[DataFrame, list[tuple[str, str, float]], list[str]]:
    """Per group ``extra``, the count of each column's values, and between which values every
    wanted percentile lies; the (column, name, fraction) of the brackets; the names of extra."""
    wanted = [(c, name, float(p)) for c, named in columns.items() for name, p in named.items()]
    reach = SLACK / accuracy
    aggs: list[Column] = []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        fractions = [f for column, _, p in wanted if column == c for f in (max(0.0, p - reach), min(1.0, p + reach))]
        # sketches don't order NaN: a group with one takes all its values
        aggs += [
            F.count(value).alias(f"__n{i}"), F.count_if(F.isnan(value)).alias(f"__nan{i}"),
            F.percentile_approx(F.when(~F.isnan(value), value), F.array(*[F.lit(f) for f in fractions]), accuracy).alias(f"__at{i}"),
        ]
    grouped = df.groupBy(*keys).agg(*extra, *aggs)
    kept = [c for c in grouped.columns if c not in keys and not c.startswith(("__n", "__at"))]
    brackets = []
    place = dict.fromkeys(columns, 0)
    for c, _, _ in wanted:
        i, j = list(columns).index(c), place[c]
        place[c] += 2
        # nor do they leave room for the neighbours of a percentile among few values
        whole = (F.col(f"__nan{i}") > 0) | (F.col(f"__n{i}") <= accuracy)
        brackets.append(F.struct(
            F.when(~whole, F.get(f"__at{i}", F.lit(j))).alias("low"), F.when(~whole, F.get(f"__at{i}", F.lit(j + 1))).alias("high"),
            F.col(f"__n{i}").alias("n")))
    return grouped.select(*keys, *kept, F.array(*brackets).alias("__brackets")), wanted, kept


def sketch_quantiles(sketch: str, wanted: Mapping[str, float]) -> list[Column]:
    """Columns {name: fraction} estimated from a KLL sketch of doubles; null where it is null."""
    return [F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))).alias(name) for name, p in wanted.items()]


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, Mapping[str, float]],
    extra: Sequence[Column] = (),
    approx: bool = False,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Percentiles per group: ``columns`` maps a value column to {output name: fraction}.

    Exact unless ``approx``, by selection: sketches give two values that a percentile lies
    between, then values below are counted and only those between are shuffled and ranked, a
    few ten-thousandths of all for each percentile.  A sketch that missed its percentile fails
    the query.  ``extra`` aggregates ride along.
    """
    if approx:
        aggs, picks = [], []
        for i, (value, named) in enumerate(columns.items()):
            fractions = F.array(*[F.lit(float(p)) for p in named.values()])
            aggs.append(F.percentile_approx(value, fractions, accuracy).alias(f"__p{i}"))
            picks += [F.col(f"__p{i}")[j].cast("double").alias(n) for j, n in enumerate(named)]
        grouped = df.groupBy(*keys).agg(*extra, *aggs)
        kept = [c for c in grouped.columns if not c.startswith("__p")]
        return grouped.select(*kept, *picks)

    groups, wanted, kept = _bracketed(df, keys, columns, extra, accuracy)
    brackets = groups.select(*keys, "__brackets")
    values = null_safe_join(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]), brackets, keys, "inner")

    def entry(i: int, c: str) -> Column:
        at = F.get("__brackets", F.lit(i))
        below = F.coalesce(F.col(c) < at["low"], F.lit(False))
        # null: below the bracket or above it
        inside = F.when(~below & F.coalesce(F.col(c) <= at["high"], F.lit(True)), F.col(c))
        return F.struct(F.lit(i).alias("which"), inside.alias("value"), below.alias("below"))

    entries = F.filter(F.array(*[entry(i, c) for i, (c, _, _) in enumerate(wanted)]),
                       lambda e: e["below"] | e["value"].isNotNull())
    counts = values.select(*keys, F.explode(entries).alias("e")).groupBy(*keys, "e.which", "e.value").agg(
        F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*keys, "which").orderBy(F.col("value").asc_nulls_first())
    placed = null_safe_join(
        counts.withColumn("__upto", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0))), brackets, keys, "inner")

    all_values = F.get("__brackets", F.col("which"))["n"]
    fraction = F.element_at(F.array(*[F.lit(p) for _, _, p in wanted]), F.col("which") + 1)
    position = fraction * (all_values - 1)

    def at(where: Column) -> Column:
        covers = (where >= F.col("__upto") - F.col("__n")) & (where < F.col("__upto")) & F.col("value").isNotNull()
        return F.max(F.when(covers, F.col("value")))

    found = placed.groupBy(*keys, "which").agg(
        at(F.floor(position)).alias("low"), at(F.ceil(position)).alias("high"), F.first(position).alias("place"))
    low, high, place = F.col("low"), F.col("high"), F.col("place")
    between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
    missed = low.isNull() | high.isNull()
    result = F.when(missed, F.raise_error(F.lit("a sketch missed its percentile")).cast("double")).when(
        low == high, low).otherwise(between)
    wide = found.select(*keys, "which", result.alias("value")).groupBy(*keys).agg(*[
        F.max(F.when(F.col("which") == i, F.col("value"))).alias(name) for i, (_, name, _) in enumerate(wanted)])
    return null_safe_join(groups.select(*keys, *kept), wide, keys)
