"""Mixing sources to target weights in a tree of domain, language and source.

A node's token budget is shared among its children in proportion to their weights.  A
child can't take more than its documents hold, read ``max_epochs`` times; what it leaves
goes to its siblings by weight, and only what all siblings leave goes up to the next
node's siblings.  As a node's capacity is the sum of its leaves', this is one pass from
the root down.

A leaf reads its documents in an order seeded by epoch.  Whole epochs take every
document; of the last, partial epoch it takes the prefix whose tokens reach the budget.
The prefix ends at a threshold of the order key, found digit by digit from sums for each
leaf and digit, so that no leaf is ever sorted or put on one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.session import write_scratch

WORD = r"[^\x20\x09-\x0D]+"
_WHOLE = "decimal(38,0)"
_DIGITS = 2
#: Leaves up to which their table is broadcast, at some hundred bytes each.
_FEW_LEAVES = 50_000
_MOST_AT_END = 1000


def word_tokens(text: str = "text") -> Column:
    """The number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _node(column: Column) -> Column:
    # never null, and different for different values
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def _shares(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Add ``given`` to children (weight, capacity, budget of the parent, name): the
    budget shared by weight, bounded by capacity, whole tokens, nothing left over while
    a child has room."""
    order = Window.partitionBy(*parent).orderBy("fill", name)
    group = Window.partitionBy(*parent)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(_WHOLE))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    # in the order in which children fill up: is this one full when its share is given?
    full = F.col("capacity") * rest <= F.col("weight") * (F.col("budget") - before)
    filled = children.withColumn("fill", F.when(F.col("capacity") == 0, 0.0).otherwise(
        F.col("capacity").cast("double") / F.col("weight").cast("double"))).withColumn("full", full)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(group)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0).cast(_WHOLE))
    product = F.col("weight") * F.col("left")
    part = F.when(~F.col("full"), ((product - product % F.col("open_weight")) / F.col("open_weight")).cast(_WHOLE))
    over = F.row_number().over(Window.partitionBy(*parent, "full").orderBy(name))
    return (
        filled.withColumn("open_weight", open_weight.cast(_WHOLE)).withColumn("left", left.cast(_WHOLE))
        .withColumn("part", part)
        .withColumn("odd", F.col("left") - F.sum("part").over(group))
        .withColumn("given", F.when(F.col("full"), F.col("capacity"))
                    .otherwise(F.col("part") + F.when(over <= F.col("odd"), 1).otherwise(0)).cast(_WHOLE))
        .drop("fill", "full", "open_weight", "left", "part", "odd")
    )


def leaf_budgets(
    leaves: DataFrame, weights: Mapping[tuple, int], budget: int, max_epochs: int, levels: int,
) -> DataFrame:
    """(p0.., tokens, n, given): each leaf's tokens to take.

    ``leaves`` has p0.. (node names), tokens and n.  ``weights`` maps a path from the
    root, as a tuple of values, to a whole weight; others weigh 1.  A weight of 0
    shuts a node out.
    """
    spark = leaves.sparkSession
    paths = [f"p{i}" for i in range(levels)]
    whole = leaves
    for i in range(levels):
        mine = [(*["" if v is None else f"={v}" for v in path], int(w)) for path, w in weights.items() if len(path) == i + 1]
        kind = pa.schema([*[(p, pa.string()) for p in paths[:i + 1]], (f"w{i}", pa.int64())])
        # as an Arrow table, which the JVM reads; rows would go through Python workers of their own
        given = spark.createDataFrame(pa.Table.from_pylist([dict(zip(kind.names, row)) for row in mine], kind))
        whole = whole.join(given, paths[:i + 1], "left").fillna(1, [f"w{i}"])
    out = F.greatest(F.lit(0), F.least(*[f"w{i}" for i in range(levels)], F.lit(1))) if levels > 1 else F.least("w0", F.lit(1))
    whole = write_scratch(whole.withColumn("capacity", (F.col("tokens").cast(_WHOLE) * max_epochs * out).cast(_WHOLE)))
    budgets = None
    for i in range(levels):
        nodes = whole.groupBy(*paths[:i + 1]).agg(
            F.max(f"w{i}").cast(_WHOLE).alias("weight"), F.sum("capacity").cast(_WHOLE).alias("capacity"),
            F.sum("tokens").alias("tokens"), F.sum("n").alias("n"))
        if budgets is None:
            nodes = nodes.withColumn("root", F.lit(0)).withColumn("budget", F.lit(int(budget)).cast(_WHOLE))
            budgets = _shares(nodes, ["root"], paths[0])
        else:
            above = budgets.select(*paths[:i], F.col("given").alias("budget"))
            budgets = _shares(nodes.join(above, paths[:i]), paths[:i], paths[i])
    return budgets.select(*paths, "tokens", "n", "given")


def mix(
    docs: DataFrame,
    tree: Sequence[Column],
    weights: Mapping[tuple, int],
    share: float = 0.5,
    max_epochs: int = 2,
    seed: int = 0,
    tokens: Column | None = None,
    copies: str = "copies",
) -> DataFrame:
    """The documents that are taken, with a column ``copies`` (bigint): the number of epochs.

    A column of that name in ``docs`` is an error; give another name then.

    ``tree`` are the columns of the levels, root first.  The budget is ``share`` of all
    tokens (words unless ``tokens`` says otherwise).  A leaf with a budget takes at
    least one document and exceeds it by less than its last one.  Null values of a
    level are a node of their own.  Rows with the same doc_id stand at the same place
    and are taken together; null doc_ids count as one id.  Documents without tokens are
    taken only along with others.  All columns are kept; an empty table gives an empty one.
    """
    if copies.lower() in map(str.lower, docs.columns):
        raise ValueError(f"docs has a column {copies}")
    levels = len(tree)
    paths = [f"p{i}" for i in range(levels)]
    tokens = word_tokens() if tokens is None else tokens
    place = [_node(c).alias(p) for c, p in zip(tree, paths)]
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    narrow = write_scratch(docs.select(*place, ident.alias("id"), tokens.cast("bigint").alias("tokens")))
    leaves = narrow.groupBy(*paths).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    total, count, most = leaves.agg(F.sum("tokens"), F.count(F.lit(1)), F.max("n")).first()
    given = leaf_budgets(leaves, weights, int((total or 0) * share), max_epochs, levels)
    full = F.when(F.col("tokens") > 0, (F.col("given") - F.col("given") % F.col("tokens")) / F.col("tokens"))
    state = given.withColumn("full", F.coalesce(full, F.lit(0)).cast("bigint")).select(
        *paths, "full", (F.col("given") - F.col("full") * F.col("tokens")).cast("bigint").alias("rest"),
        F.lit("").alias("prefix"), F.lit(0).cast("bigint").alias("before"))

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if count <= _FEW_LEAVES else table

    def key(of: str | Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), of))

    state = write_scratch(state)
    keyed = write_scratch(narrow.join(small(state), paths).filter("rest > 0").select(*paths, key("id").alias("key"), "tokens"))

    def ends(rows: DataFrame, by: str) -> DataFrame:
        """For each leaf the first ``by`` at which the running tokens reach the rest."""
        running = Window.partitionBy(*paths).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        sums = rows.groupBy(*paths, by, "rest", "before").agg(F.sum("tokens").alias("tokens"))
        upto = sums.withColumn("upto", F.col("before") + F.sum("tokens").over(running))
        return upto.filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("tokens") < F.col("rest")))

    spot, left = state.filter("rest > 0").select(*paths, "rest", "prefix", "before"), most or 0
    while left > _MOST_AT_END:
        size = F.length("prefix") + _DIGITS
        rows = keyed.join(small(spot), paths).filter(F.col("key").startswith(F.col("prefix")))
        found = ends(rows.withColumn("digits", F.substring(F.col("key"), F.lit(1), size)), "digits")
        spot = write_scratch(found.select(
            *paths, "rest", F.col("digits").alias("prefix"), (F.col("upto") - F.col("tokens")).alias("before")))
        left //= 16 ** _DIGITS
    rows = keyed.join(small(spot), paths).filter(F.col("key").startswith(F.col("prefix")))
    last = ends(rows, "key").groupBy(*paths).agg(F.min("key").alias("last"))
    bounds = write_scratch(state.select(*paths, "full").join(last, paths, "left"))

    packed = docs.select(F.struct(*docs.columns).alias("row"), *place, ident.alias("id"))
    taken = F.col("full") + F.when(key("id") <= F.col("last"), 1).otherwise(0)
    return (
        packed.join(small(bounds), paths).withColumn("taken", taken.cast("bigint")).filter("taken > 0")
        .select("row.*", F.col("taken").alias(copies))
    )
