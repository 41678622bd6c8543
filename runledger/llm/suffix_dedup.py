"""Bytes of repeated passages go: every byte that a string of ``least_bytes`` bytes covers
which also starts anywhere else, in the same document or another one.

Distributed prefix doubling: Spark ranks places of the texts by what follows them, pairs each
rank with what stands at a growing offset, and ranks the pairs again, until a place is unique or
its prefix is past the threshold.  Ranks are fingerprints, equal for equal strings; those of
longer strings are made of the pair of ranks of both halves (``doubled_ranks``).

Ranking every byte would shuffle dozens of times the input, so that Spark ranks a sample that
the texts themselves choose.  Among the grams that start in a string of ``least_bytes`` bytes the one
with the smallest rank (the last of equals) is its anchor.  Equal strings have equal anchors at
the same offset, so each start is looked at with its anchor alone, and one anchor serves the
consecutive starts that it is chosen by, some 80 on average.

1. Rank of the gram at each anchor.  Unique anchors drop out, with all their starts.
2. Pair of that rank and the rank of all that the anchor's starts cover.  Places that share it
   are past the threshold: all their starts are repeated.
3. What is left shares an anchor and differs within its reach: about the ends of passages.  One
   place for each pair is sorted next to those with the same gram, and the starts
   themselves are ranked there, by doubling up to ``least_bytes``.  Anchors with very many places
   rank their starts by an aggregation over all tasks instead.
4. The repeated starts of a text, joined to it, give the bytes to remove.

An anchor with the same surroundings that comes again inside one text is sent once, so that
a text of one repeated character costs no more than others; equal ones of several texts are
counted before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.session import write_scratch

LEAST_BYTES = 200
#: Grams among which an anchor is chosen; an anchor's gram has least_bytes - WINDOW + 1 bytes.
WINDOW = 160
#: Places of an anchor that are sorted in one task, and places ranked together there.
CLASS_PLACES, BLOCK_PLACES = 4096, 16384

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def doubled_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the strings of ``length`` bytes at every place, from pairs of ranks at offsets
    of 1, 2, 4, ... bytes."""
    rank, size = _BYTE[data], 1
    out: np.ndarray | None = None
    done = 0
    while True:
        if length & size:
            if out is None:
                out = rank
            else:
                n = max(0, min(len(out), len(rank) - done))
                out = _mix(out[:n] * _ODD + rank[done:done + n])
            done += size
        if done == length:
            return out[:max(0, len(data) - length + 1)]
        n = max(0, len(rank) - size)
        rank = _mix(rank[:n] * _ODD + rank[size:size + n])
        size *= 2


def anchors(data: np.ndarray, least_bytes: int, window: int) -> tuple[np.ndarray, ...]:
    """(place, rank, first start, last start) of each anchor; starts of all anchors
    are all starts of strings of ``least_bytes`` bytes, each once."""
    starts = len(data) - least_bytes + 1
    if starts <= 0:
        return (np.empty(0, np.int64),) * 4
    rank = doubled_ranks(data, least_bytes - window + 1)
    # of equal ranks the last place is smallest
    key = (rank & ~_LOW) | (_LOW - np.arange(len(rank), dtype=np.uint64))
    size = 1
    while 2 * size <= window:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    rest = window - size
    if rest:
        key = np.minimum(key[:-rest], key[rest:])
    owner = (_LOW - (key & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    last = np.append(first[1:], starts) - 1
    place = owner[first]
    return place, rank[place], first, last


def merge(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Sorted spans; those that overlap or touch become one."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


_ANCHORS = "g long, x long, doc_id long, text_hash int, first long, last long, place long, n int, more array<long>"


def _anchor_rows(texts: DataFrame, least_bytes: int, window: int) -> DataFrame:
    """Anchors of all texts with the rank g of their gram and x of all that their starts cover.

    Of those that are equal in a text only the first is sent, with n = 2 and what all of them
    cover in ``more`` (start, stop, start, ...).
    """
    schema = pa.schema([("g", pa.int64()), ("x", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int32()), ("first", pa.int64()),
                        ("last", pa.int64()), ("place", pa.int64()), ("n", pa.int32()), ("more", pa.list_(pa.int64()))])

    def rows_of(raw: bytes) -> tuple[list, ...]:
        place, rank, first, last = anchors(np.frombuffer(raw, np.uint8), least_bytes, window)
        digest = xxhash.xxh3_64_intdigest
        view = memoryview(raw)
        reach = [digest(view[a:b + least_bytes], (p - a) << 16 | (p - b)) for p, a, b in zip(place.tolist(), first.tolist(), last.tolist())]
        x = np.array(reach, np.uint64).view(np.int64)
        g = rank.view(np.int64)
        order = np.lexsort((place, x, g))
        same = (np.diff(g[order]) == 0) & (np.diff(x[order]) == 0)
        heads = np.concatenate([[True], ~same])
        number = np.ones(len(g), np.int32)
        more: list = [None] * len(g)
        if same.any():
            edges = np.append(np.flatnonzero(heads), len(order))
            for i in np.flatnonzero(np.diff(edges) > 1):
                group = order[edges[i]:edges[i + 1]]
                spans = merge(zip(first[group].tolist(), (last[group] + least_bytes).tolist()))
                number[group[0]], more[group[0]] = 2, [v for span in spans for v in span]
        kept = np.sort(order[heads])
        return g[kept], x[kept], first[kept], last[kept], place[kept], number[kept], [more[i] for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                columns: list[list] = [[] for _ in schema]
                for doc_id, text_hash, text in zip(*[part.column(i).to_pylist() for i in range(3)]):
                    raw = (text or "").encode()
                    if len(raw) < least_bytes:
                        continue
                    g, x, first, last, place, n, more = rows_of(raw)
                    for column, values in zip(columns, (g, x, [doc_id] * len(g), [text_hash] * len(g), first, last, place, n, more)):
                        column.extend(values)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return texts.mapInArrow(run, _ANCHORS)


_PLACES = "g long, doc_id long, text_hash int, start long, offset long, n int, many boolean, bytes binary"


def _cut_places(joined: DataFrame, least_bytes: int) -> DataFrame:
    """The bytes that the starts of each place cover, from (doc_id, text_hash, text, places)."""
    schema = pa.schema([("g", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int32()), ("start", pa.int64()),
                        ("offset", pa.int64()), ("n", pa.int32()), ("many", pa.bool_()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for doc_id, text_hash, text, places in zip(*[part.column(i).to_pylist() for i in range(4)]):
                    raw = (text or "").encode()
                    for p in places:
                        rows.append((p["g"], doc_id, text_hash, p["first"], p["place"] - p["first"], p["n"], p["many"],
                                     raw[p["first"]:p["last"] + least_bytes]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return joined.mapInArrow(run, _PLACES)


def _starts(batch: pa.RecordBatch, least_bytes: int) -> tuple[np.ndarray, ...]:
    """For every start of the places in ``batch``: its place, its number there and its rank."""
    values = batch.column("bytes").to_pylist()
    sizes = np.array([len(v) for v in values], np.int64)
    ranks = doubled_ranks(np.frombuffer(b"".join(values), np.uint8), least_bytes)
    count = sizes - least_bytes + 1
    owner = np.repeat(np.arange(len(values)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return owner, number, ranks[(np.cumsum(sizes) - sizes)[owner] + number]


def _repeated_starts(places: DataFrame, least_bytes: int, block: int) -> DataFrame:
    """Spans (doc_id, text_hash, start, stop) of repeated starts of places that are alone with what
    they cover (n = 1); all places with the same g come together, in any task."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, number, rank = _starts(batch, least_bytes)
        g, n, first, offset = (batch.column(c).to_numpy() for c in ("g", "n", "start", "offset"))
        same = np.cumsum(np.diff(g, prepend=g[0]) != 0)[owner]  # places come by g
        shift = offset[owner] - number
        order = np.lexsort((rank, shift, same))
        heads = np.ones(len(order), bool)
        heads[1:] = (np.diff(rank[order]) != 0) | (np.diff(shift[order]) != 0) | (np.diff(same[order]) != 0)
        group = np.cumsum(heads) - 1
        times = np.empty(len(order), np.int64)
        times[order] = np.add.reduceat(n[owner][order], np.flatnonzero(heads))[group]
        hit = np.flatnonzero((times > 1) & (n[owner] == 1))
        if not len(hit):
            return pa.RecordBatch.from_pylist([], schema=schema)
        # neighbouring starts of one place give one span
        breaks = np.flatnonzero((np.diff(owner[hit]) != 0) | (np.diff(number[hit]) != 1))
        head, tail = hit[np.concatenate([[0], breaks + 1])], hit[np.append(breaks, len(hit) - 1)]
        who = pa.array(owner[head])
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id").take(who), batch.column("text_hash").take(who),
            pa.array(first[owner[head]] + number[head]), pa.array(first[owner[head]] + number[tail] + least_bytes)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows < block:
                continue
            whole = pa.Table.from_batches(kept).combine_chunks()
            g = whole.column("g").to_numpy()
            done = int(np.searchsorted(g, g[-1]))  # the last anchor may go on
            for part in whole.slice(0, done).combine_chunks().to_batches():
                yield solve(part)
            kept = whole.slice(done).combine_chunks().to_batches()
            rows = whole.num_rows - done
        for part in pa.Table.from_batches(kept).combine_chunks().to_batches() if kept else []:
            yield solve(part)

    return places.repartition("g").sortWithinPartitions("g").mapInArrow(run, "doc_id long, text_hash int, start long, stop long")


def _counted_starts(places: DataFrame, least_bytes: int) -> DataFrame:
    """As _repeated_starts, by counting every start's rank over all tasks."""
    schema = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int32()), ("start", pa.int64()),
                        ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                owner, number, rank = _starts(batch, least_bytes)
                g, first, offset = (batch.column(c).to_numpy() for c in ("g", "start", "offset"))
                who = pa.array(owner)
                key = _mix(g.view(np.uint64)[owner] * _ODD + (offset[owner] - number).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(rank.view(np.int64)), batch.column("doc_id").take(who),
                    batch.column("text_hash").take(who), pa.array(first[owner] + number), batch.column("n").take(who)], schema=schema)

    ranked = places.mapInArrow(run, "one long, two long, doc_id long, text_hash int, start long, n int")
    again = ranked.groupBy("one", "two").agg(F.sum("n").alias("times")).filter("times > 1").drop("times")
    return ranked.filter("n = 1").join(again, ["one", "two"]).select(
        "doc_id", "text_hash", "start", (F.col("start") + least_bytes).alias("stop"))


_OUT = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(),
        "removed": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))}
_OUT_SQL = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "binary",
            "removed": "array<struct<start:long,stop:long>>"}


def _remove(joined: DataFrame, columns: Sequence[str]) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), *((c, _OUT[c]) for c in columns)])

    def one(text: str | None, spans: list | None) -> dict:
        raw = (text or "").encode()
        removed = merge((s["start"], s["stop"]) for s in spans or ())
        kept, at = [], 0
        for start, stop in removed:
            kept.append(raw[at:start])
            at = stop
        rest = b"".join([*kept, raw[at:]])
        return {"n_bytes": len(raw), "n_removed": len(raw) - len(rest), "n_spans": len(removed), "kept": rest,
                "kept_sha256": hashlib.sha256(rest).hexdigest(), "removed": [{"start": a, "stop": b} for a, b in removed]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [one(text, spans) for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([m[c] for m in made], _OUT[c]) for c in columns)], schema=schema)

    return joined.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {_OUT_SQL[c]}" for c in columns))


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.text_hash") == F.col(f"{right}.text_hash"))


def remove_repeats(
    docs: DataFrame, columns: Sequence[str] = ("n_bytes", "n_removed", "n_spans", "kept_sha256"),
    least_bytes: int = LEAST_BYTES, window: int = WINDOW, class_places: int = CLASS_PLACES, block_places: int = BLOCK_PLACES,
) -> DataFrame:
    """doc_id and ``columns`` for every row of ``docs`` (doc_id, text).

    Columns: n_bytes of the text in UTF-8, n_removed of these, n_spans removed runs as long as
    possible, kept_sha256 and ``kept`` (binary) of the rest, ``removed`` (start, stop).  Strings
    are judged on the input, and none reaches from one document into another.

    A null or empty text has no bytes; texts below ``least_bytes`` lose none.  Repeated rows are
    documents like any other, so that each loses all if it is long enough; null ids are ids like
    any other.  Other columns are not read; an empty table gives an empty one.
    """
    if not 0 < window <= least_bytes:
        raise ValueError("window must be positive and at most least_bytes")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.hash(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    found = _anchor_rows(texts.select("doc_id", "text_hash", "text"), least_bytes, window)
    ranked = found.groupBy("g").agg(F.sum("n").alias("places"), F.min("x").alias("low"), F.max("x").alias("high"))
    kept = write_scratch(found.join(ranked.filter("places > 1"), "g"))

    # past the threshold: all that an anchor's starts cover comes again
    alike = kept.filter("low = high").select("doc_id", "text_hash", "first", "last", "more")
    order = Window.partitionBy("g", "x").orderBy("doc_id", "text_hash", "place")
    mixed = kept.filter("low <> high").withColumns({
        "no": F.row_number().over(order), "next": F.lead("place").over(order)}).withColumn(
            "again", (F.col("n") > 1) | (F.col("no") > 1) | F.col("next").isNotNull())
    sure = alike.unionByName(mixed.filter("again").select("doc_id", "text_hash", "first", "last", "more"))
    own = F.array(F.col("first"), F.col("last") + least_bytes)
    flat = sure.select("doc_id", "text_hash", F.coalesce("more", own).alias("v"))
    spans = flat.select("doc_id", "text_hash", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("v") - 2, F.lit(2)), lambda i: F.struct(F.get("v", i).alias("start"), F.get("v", i + 1).alias("stop")))
    ).alias("s")).select("doc_id", "text_hash", "s.*")

    # one place for each that differs; its starts are ranked by themselves
    places = mixed.filter("no = 1").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(
        "g", "first", "last", "place", F.when(F.col("again"), 2).otherwise(1).alias("n"),
        (F.col("places") > class_places).alias("many"))).alias("places"))
    cut = _cut_places(texts.alias("t").join(places.alias("p"), _same("t", "p")).select("t.doc_id", "t.text_hash", "text", "places"), least_bytes)
    spans = spans.unionByName(_repeated_starts(cut.filter("NOT many"), least_bytes, block_places)).unionByName(
        _counted_starts(cut.filter("many"), least_bytes))

    gathered = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return _remove(texts.alias("t").join(gathered.alias("s"), _same("t", "s"), "left").select("t.doc_id", "text", "spans"), columns)
