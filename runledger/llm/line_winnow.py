"""Line dedup by winnowing: later copies of runs of lines go.

A run is ``run_lines`` or more lines in sequence, at least one of them with a word, or one
line of ``long_words`` words or more, that stands earlier in the corpus as well, in the order of
(doc_id, null last; a hash of the text; line number).  With ``short_runs`` the shortest run
from each line that holds ``long_words`` words counts as well, whatever its number of lines.

1. Winnowing: of the line hashes in every window of ``run_lines`` lines the smallest (the
   rightmost of equals) is selected.  Two equal windows select the same place, so that a
   repeated run always shares a selected line; most lines are never moved.
2. Each selected place is one row.  Places are counted by hash; only those whose line was
   selected elsewhere stay.
3. Each is extended both ways to the windows that selected it.  A window whose
   content stands earlier is a copy; overlapping copies form the run, however long.
4. The lines of copies are cut from the text.

All of it is Spark SQL.  Counting and the search for the earliest place aggregate before
they shuffle, so a line that a third of all documents share costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.batches import join_counted
from runledger.session import write_scratch

_BLANK = r"[\x20\x09-\x0D]*"
WORD = r"[^\x20\x09-\x0D]+"


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n")


def _key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def copied_windows(
    docs: DataFrame, run_lines: int = 3, long_words: int = 50, short_runs: bool = False,
) -> DataFrame:
    """(doc_id, text_hash, start, size): windows of lines that stand earlier, from line 0."""
    w = run_lines
    most = max(1, w - 1) if short_runs else 1  # lines of a run that counts for its words
    line_hash = F.transform(_lines(), lambda x: F.when(x.rlike(f"^{_BLANK}$"), F.lit(0).cast("bigint"))
                            .otherwise(F.xxhash64(x)))
    # long runs are marked, so that no text is needed later; a line of n words has 2n - 1 characters or more
    measured = docs.select(*_key(docs), line_hash.alias("h"), F.transform(_lines(), lambda x: (
        F.regexp_count(x, F.lit(WORD)) if most > 1
        else F.when(F.length(x) >= 2 * long_words - 1, F.regexp_count(x, F.lit(WORD))).otherwise(0))).alias("words"))

    def shortest(i: Column) -> Column:  # lines of the shortest long run from line i, if there is one
        size, words = F.lit(None).cast("int"), F.lit(0)
        for k in range(1, most + 1):
            words = words + F.get("words", i + (k - 1))  # null after the last line
            size = F.coalesce(size, F.when(words >= long_words, F.lit(k)))
        return size

    at = F.transform(F.sequence(F.lit(0), F.size("h") - 1), shortest)
    spots = write_scratch(measured.select("doc_id", "text_hash", "h", at.alias("long")))

    window_at = F.when(F.size("h") >= w, F.sequence(F.lit(0), F.size("h") - w)).otherwise(F.array().cast("array<int>"))

    # the place that each window selects: the smallest hash, of equals the last
    runs = F.transform(window_at, lambda i: _selected(i, F.lit(w)))
    longs = F.filter(F.transform("long", lambda size, i: F.when(size.isNotNull(), _selected(i, size))), lambda r: r.isNotNull())
    places = write_scratch(spots.select("doc_id", "text_hash", F.explode(F.array_distinct(F.concat(runs, longs))).alias("r")).select(
        "doc_id", "text_hash", "r.line", "r.selected"))
    again = places.groupBy("selected").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = join_counted(places, write_scratch(again), ["selected"], places.count())
    lines = kept.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("kept"))

    # extended both ways: the windows that selected a place which is left
    def window(i: Column, size: Column) -> Column:
        return F.struct(i.alias("start"), size.alias("size"), F.slice("h", i + 1, size).alias("content"))

    last = F.size("h") - w
    starts = F.array_distinct(F.flatten(F.transform("kept", lambda x: F.when(
        F.greatest(x - (w - 1), F.lit(0)) <= F.least(x, last), F.sequence(F.greatest(x - (w - 1), F.lit(0)), F.least(x, last))
    ).otherwise(F.array().cast("array<int>")))))
    found = F.filter(F.transform(starts, lambda i: window(i, F.lit(w))), lambda r: F.exists(r["content"], lambda x: x != 0))
    long_starts = F.array_distinct(F.flatten(F.transform("kept", lambda x: F.filter(
        F.array(*[x - d for d in range(most)]), lambda i: i + F.get("long", i) > x))))
    found_long = F.transform(long_starts, lambda i: window(i, F.get("long", i)))
    near = spots.alias("s").join(lines.alias("l"), F.col("s.doc_id").eqNullSafe(F.col("l.doc_id"))
                                 & (F.col("s.text_hash") == F.col("l.text_hash"))).select("s.*", "kept")
    likely = write_scratch(near.select("doc_id", "text_hash", F.explode(F.concat(found, found_long)).alias("r")).select(
        "doc_id", "text_hash", "r.start", "r.size",
        F.xxhash64("r.content").alias("one"), F.xxhash64(F.lit(1), "r.content").alias("two")).distinct())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "start")
    key = ["one", "two", "size"]
    first = likely.groupBy(*key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return join_counted(likely, write_scratch(first), key, likely.count()).filter(order != F.col("first")).select(
        "doc_id", "text_hash", "start", "size")


def _selected(i: Column, size: Column) -> Column:
    """The line that the window of ``size`` lines from line ``i`` selects, and its hash."""
    part = F.slice("h", i + 1, size)
    least = F.array_min(part)
    back = F.array_position(F.reverse(part), least)
    return F.struct((i + size - back).cast("int").alias("line"), least.alias("selected"))


def drop_copied_lines(
    docs: DataFrame, run_lines: int = 3, long_words: int = 50, short_runs: bool = False,
    n_lines: str = "n_lines", n_deleted: str = "n_deleted",
) -> DataFrame:
    """``docs`` with the lines of copied runs cut from ``text``, and n_lines, n_deleted (bigint).

    Columns of those two names in ``docs`` are an error; give other names then.

    Every document stays, if need be with an empty text; the other columns stay as they
    are.  Null texts stay null and have no lines; an empty text has one.  Rows with the
    same doc_id and text are one place in the order and lose the same lines.  Within a
    text an earlier run counts as well.  An empty table gives an empty one.
    """
    if {n_lines.lower(), n_deleted.lower()} & set(map(str.lower, docs.columns)):
        raise ValueError(f"docs has a column {n_lines} or {n_deleted}")
    windows = write_scratch(copied_windows(docs, run_lines, long_words, short_runs))
    doc = [F.col("doc_id"), F.col("text_hash")]
    order = Window.partitionBy(*doc).orderBy("start")
    reached = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        windows.withColumn("new", (F.col("start") > F.coalesce(reached, F.lit(-1))).cast("int"))
        .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*doc, "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("stop"))
        .groupBy(*doc).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    )
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("row"), *_key(docs))
    joined = packed.alias("d").join(runs.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id"))
                                    & (F.col("d.text_hash") == F.col("r.text_hash")), "left").select("row", "runs", F.split("row.text", "\n").alias("lines"))
    lines, n = F.col("lines"), F.size("runs")
    # what stands between the runs
    kept = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(
        lines,
        F.when(i == 0, 0).otherwise(F.get("runs", i - 1)["stop"]) + 1,
        F.when(i == n, F.size(lines)).otherwise(F.get("runs", i)["start"])
        - F.when(i == 0, 0).otherwise(F.get("runs", i - 1)["stop"]))))
    cut = F.aggregate("runs", F.lit(0).cast("bigint"), lambda s, r: s + r["stop"] - r["start"])
    text = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(f"row.{c}") for c in names],
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias(n_lines),
        F.coalesce(cut, F.lit(0).cast("bigint")).alias(n_deleted))
