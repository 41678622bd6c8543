"""Phrases whose words come together more often than their parts would suggest.

Counts of n-grams live in weighted acyclic automata: transducers from phrases to counts.

1. Each task adds its texts to a shard, counts the shard's n-grams, sorts them and builds a
   count transducer from them: prefixes that are passed close their states, and a register
   of closed states stores equal ones once.
2. A shard is written as one transducer for each range of prefixes.  Prefixes (the first two
   words) are ordered by their hash, so that ranges hold equal shares whatever words are
   frequent; an n-gram of three words lies with its first two.
3. The transducers of one range are united, and the weights of equal paths added up.
4. Phrases that are frequent enough become candidates.  The parts of all candidates are built
   into acceptors by range, and composed with the range's transducer: what both accept gets
   its count.  Parts of a frequent phrase are as frequent, so that rare paths can go before.

Every shard sends a phrase once, however often it holds it, so that a frequent one costs no
more than others, and no task ever holds more than a shard or the transducers of one range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zlib
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.session import write_scratch

# Where texts and pieces are split, and the language of rows without one.
PIECE_ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
UNKNOWN = "und"

#: Words of a shard, and bytes of text for each range of prefixes.
SHARD_WORDS, RANGE_BYTES = 2_000_000, 8 << 20

_END = b"\xff"  # in no text: UTF-8 has no such byte
_READ = bytes.maketrans(PIECE_ENDS, _END * len(PIECE_ENDS))
_CHUNK = 200_000  # sorted n-grams whose states are closed together


class Grams(NamedTuple):
    """Sorted paths as rows of label numbers (-1 after the last), and their weights."""
    labels: np.ndarray
    weights: np.ndarray


def packed(labels: np.ndarray, ahead: np.ndarray | None = None) -> list[np.ndarray]:
    """The columns of ``labels``, after those of ``ahead``, in as few whole numbers as hold them,
    with the same order."""
    keys: list[np.ndarray] = []
    room = 0
    for raw in ([] if ahead is None else [ahead]) + list(labels.T):
        column = raw.astype(np.int64)
        base = int(column.max(initial=0)) + 2
        if keys and room * base < 1 << 62:
            keys[-1] = keys[-1] * base + (column + 1)
            room *= base
        else:
            keys.append(column + 1)
            room = base
    return keys


def sum_equal(grams: Grams) -> Grams:
    """``grams`` sorted, with the weights of equal paths added up."""
    labels, weights = grams
    if not len(labels):
        return grams
    keys = packed(labels)
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for key in keys:
        new[1:] |= np.diff(key[order]) != 0
    heads = np.flatnonzero(new)
    return Grams(labels[order[heads]], np.add.reduceat(weights[order], heads))


def _as_arrow(words: pa.Array | Sequence[bytes]) -> pa.Array:
    return words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary())


class Transducer:
    """A minimal acyclic automaton with a weight on every arc, 0 where no phrase ends.

    Arcs of state s are those from first[s] to first[s + 1], by label; labels number the
    sorted ``words`` (``spoken`` in Arrow's form); state 0 has no arcs, the last state is the root.
    """

    def __init__(self, spoken: pa.Array, first: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray):
        self.spoken, self.first, self.label, self.weight, self.target = spoken, first, label, weight, target

    @property
    def words(self) -> np.ndarray:
        return self.spoken.to_numpy(zero_copy_only=False)

    @classmethod
    def build(cls, words: pa.Array | Sequence[bytes], grams: Grams) -> Transducer:
        """From sorted, different paths over ``words``."""
        labels, weights = grams
        flat = labels.ravel()
        by = np.argsort(flat)
        new = np.diff(flat[by], prepend=-1) != 0
        used = flat[by[new]]
        number = np.empty(len(flat), np.int64)
        number[by] = np.cumsum(new) - 1
        labels = number.reshape(labels.shape)
        made = _Register(labels.shape[1] if len(labels) else 1)
        at = 0
        while at < len(labels):
            stop = min(at + _CHUNK, len(labels))
            while stop < len(labels) and (labels[stop, :2] == labels[stop - 1, :2]).all():
                stop += 1  # a chunk ends where the second label changes
            made.add(labels[at:stop], weights[at:stop])
            at = stop
        return cls(_as_arrow(words).take(pa.array(used, pa.int64())), *made.finish())

    def paths(self) -> Grams:
        """All phrases with their weights."""
        states, prefix = np.array([len(self.first) - 2]), np.empty((1, 0), np.int32)
        rows, weights = [], []
        while len(states):
            count = self.first[states + 1] - self.first[states]
            arcs = np.repeat(self.first[states] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            prefix = np.column_stack([np.repeat(prefix, count, axis=0), self.label[arcs].astype(np.int32)])
            ends = self.weight[arcs] > 0
            rows.append(prefix[ends])
            weights.append(self.weight[arcs][ends])
            states = self.target[arcs]
            prefix, states = prefix[states > 0], states[states > 0]
        depth = max((r.shape[1] for r in rows), default=1)
        wide = [np.pad(r, ((0, 0), (0, depth - r.shape[1])), constant_values=-1) for r in rows]
        return Grams(np.concatenate(wide), np.concatenate(weights)) if rows else Grams(np.empty((0, 1), np.int64), np.empty(0, np.int64))

    def compose(self, other: Transducer) -> tuple[Transducer, Grams]:
        """``other``, and the paths that both accept with other's weights (labels of ``other``)."""
        mine = pc.index_in(self.spoken, other.spoken).fill_null(-1).to_numpy().astype(np.int64)
        pairs = np.array([[len(self.first) - 2, len(other.first) - 2]])
        prefix = np.empty((1, 0), np.int64)
        rows, weights = [], []
        arc_keys = np.repeat(np.arange(len(other.first) - 1), np.diff(other.first)) * (len(other.spoken) + 1) + other.label
        while len(pairs):
            count = self.first[pairs[:, 0] + 1] - self.first[pairs[:, 0]]
            arcs = np.repeat(self.first[pairs[:, 0]] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            label = mine[self.label[arcs]]
            wanted = np.repeat(pairs[:, 1], count) * (len(other.spoken) + 1) + label
            place = np.searchsorted(arc_keys, wanted)
            found = (label >= 0) & (place < len(arc_keys))
            found[found] = arc_keys[place[found]] == wanted[found]
            prefix = np.column_stack([np.repeat(prefix, count, axis=0), label])[found]
            arcs, place = arcs[found], place[found]
            ends = (self.weight[arcs] > 0) & (other.weight[place] > 0)
            rows.append(prefix[ends])
            weights.append(other.weight[place][ends])
            pairs = np.column_stack([self.target[arcs], other.target[place]])
            on = (pairs > 0).all(axis=1)
            pairs, prefix = pairs[on], prefix[on]
        depth = max((r.shape[1] for r in rows), default=1)
        wide = [np.pad(r, ((0, 0), (0, depth - r.shape[1])), constant_values=-1) for r in rows]
        return other, Grams(np.concatenate(wide), np.concatenate(weights))

    @classmethod
    def union(cls, parts: Sequence[Transducer], least: int = 1) -> tuple[Transducer, Grams, np.ndarray]:
        """One transducer of all paths with the sums of their weights, without those below
        ``least``; and all sums before that, over the returned words."""
        spoken = pa.concat_arrays([p.spoken for p in parts]).dictionary_encode()
        order = pc.sort_indices(spoken.dictionary)  # by bytes
        words = spoken.dictionary.take(order)
        rank = np.empty(len(words) + 1, np.int32)
        rank[order.to_numpy()] = np.arange(len(words))
        rank[-1] = -1
        codes, at = spoken.indices.to_numpy(), 0
        moved, weights = [], []
        for p in parts:
            of = rank[np.append(codes[at:at + len(p.spoken)], -1)]
            at += len(p.spoken)
            labels, counts = p.paths()
            moved.append(of[labels])
            weights.append(counts)
        depth = max(m.shape[1] for m in moved)
        moved = [np.pad(m, ((0, 0), (0, depth - m.shape[1])), constant_values=-1) if m.shape[1] < depth else m for m in moved]
        grams = sum_equal(Grams(np.concatenate(moved), np.concatenate(weights)))
        del moved, weights, spoken, codes
        often = grams.weights >= least
        return cls.build(words, Grams(grams.labels[often], grams.weights[often])), grams, words.to_numpy(zero_copy_only=False)

    def dump(self) -> bytes:
        sizes = pc.binary_length(self.spoken).to_numpy().astype("<i4")
        stops = np.frombuffer(self.spoken.buffers()[1], "<i8")[self.spoken.offset:][:len(sizes) + 1]
        spoken = self.spoken.buffers()[2][int(stops[0]):int(stops[-1])] if len(sizes) else b""
        arrays = [sizes, np.diff(self.first).astype("<i4"), self.label.astype("<i4"), self.weight.astype("<i8"), self.target.astype("<i4")]
        head = np.array([len(sizes), len(arrays[1]), len(arrays[2])], "<i8").tobytes()
        return zstandard.compress(b"".join([head, *(a.tobytes() for a in arrays), spoken]), 1)

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        raw = zstandard.decompress(data)
        words, states, arcs = np.frombuffer(raw, "<i8", 3).tolist()
        at, arrays = 24, []
        for count, kind in ((words, "<i4"), (states, "<i4"), (arcs, "<i4"), (arcs, "<i8"), (arcs, "<i4")):
            arrays.append(np.frombuffer(raw, kind, count, at).astype(np.int64))
            at += arrays[-1].size * int(kind[2])
        stops = np.concatenate([[0], np.cumsum(arrays[0])])
        spoken = pa.Array.from_buffers(pa.large_binary(), words, [None, pa.py_buffer(stops), pa.py_buffer(raw[at:])])
        return cls(spoken, np.concatenate([[0], np.cumsum(arrays[1])]), *arrays[2:])


class _Numbers(dict):
    """Numbers new keys as they come."""

    def __init__(self, start: int):
        super().__init__()
        self.next = start

    def __missing__(self, key: bytes) -> int:
        number = self[key] = self.next
        self.next += 1
        return number


class _Register:
    """States that are closed: equal ones (the same arcs) are stored once."""

    def __init__(self, depth: int):
        self.depth = depth
        self.next = 1
        self.known = _Numbers(1)  # of states by the bytes of their arcs
        # states with one arc, by its label, target and weight in one number
        self.keys, self.numbers = np.empty(0, np.int64), np.empty(0, np.int64)
        self.arcs: list[np.ndarray] = []  # of each new state in turn: label, weight, target
        self.counts: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.top: list[np.ndarray] = []  # arcs of states that may still grow: two labels and a weight, target

    def _close_single(self, arcs: np.ndarray) -> np.ndarray:
        """State numbers of states with one arc each, whose values fit in one number."""
        keys = arcs[:, 0] << 40 | arcs[:, 2] << 17 | arcs[:, 1]
        by = np.argsort(keys)
        heads = np.diff(keys[by], prepend=-1) != 0
        different = keys[by][heads]
        place = np.searchsorted(self.keys, different)
        fresh = np.ones(len(different), bool)
        inside = place < len(self.keys)
        fresh[inside] = self.keys[place[inside]] != different[inside]
        n = int(fresh.sum())
        new = np.arange(self.next, self.next + n)
        self.next += n
        self.arcs.append(arcs[by[heads]][fresh])
        self.counts.append(np.ones(n, np.int64))
        of = np.empty(len(different), np.int64)
        of[fresh] = new
        of[~fresh] = self.numbers[place[~fresh]]
        self.numbers = np.insert(self.numbers, place[fresh], new)
        self.keys = np.insert(self.keys, place[fresh], different[fresh])
        number = np.empty(len(keys), np.int64)
        number[by] = of[np.cumsum(heads) - 1]
        return number

    def close(self, owner: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        """State numbers of the arcs' owners (0, 1, 2, ... in order)."""
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        count = np.diff(np.append(first, len(owner)))
        number = np.empty(len(first), np.int64)
        fits = (count == 1) & (arcs[first] < (1 << 23, 1 << 17, 1 << 23)).all(axis=1)
        number[fits] = self._close_single(arcs[first[fits]])
        # the others by the bytes of their arcs
        looked = np.flatnonzero(~fits)
        raw, width = np.ascontiguousarray(arcs).tobytes(), arcs.shape[1] * 8
        keys_of = [raw[a:b] for a, b in zip((first[looked] * width).tolist(), ((first + count)[looked] * width).tolist())]
        before = self.known.next = self.next
        found = np.fromiter(map(self.known.__getitem__, keys_of), np.int64, len(looked))
        self.next = self.known.next
        highest = np.maximum.accumulate(found)
        new = looked[found > np.concatenate([[before - 1], np.maximum(highest[:-1], before - 1)])[:len(found)]]
        number[looked] = found
        if len(new):
            begins = np.cumsum(count[new]) - count[new]
            self.arcs.append(arcs[np.repeat(first[new] - begins, count[new]) + np.arange(count[new].sum())])
            self.counts.append(count[new])
        return number

    def add(self, labels: np.ndarray, weights: np.ndarray) -> None:
        length = (labels >= 0).sum(axis=1)
        changed = np.ones(labels.shape, bool)
        changed[1:] = labels[1:] != labels[:-1]
        new = np.logical_or.accumulate(changed, axis=1)  # does the row begin a new prefix of d + 1 labels?
        targets = None
        for d in range(self.depth - 1, -1, -1):
            rows = np.flatnonzero(new[:, d] & (length > d))  # one row for each prefix of d + 1 labels
            prefix = np.cumsum(new[:, d] & (length > d)) - 1
            weight = np.where(length[rows] == d + 1, weights[rows], 0)
            target = np.zeros(len(rows), np.int64)
            if targets is not None:
                owners, states = targets
                target[prefix[owners]] = states
            arcs = np.column_stack([labels[rows, d], weight, target])
            if d == 0:
                self.top.append(arcs)
                return
            if d == 1:  # the first label may go on in the next chunk
                self.top.append(np.column_stack([labels[rows, 0], arcs]))
                single = np.flatnonzero(length == 1)
                if len(single):
                    self.top.append(np.column_stack([labels[single, 0], np.full(len(single), -1), weights[single], np.zeros(len(single), np.int64)]))
                return
            above = np.cumsum(new[:, d - 1] & (length > d - 1)) - 1
            owner = above[rows]
            if not len(rows):
                continue
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            compact = np.cumsum(np.diff(owner, prepend=-1) > 0) - 1
            targets = (rows[begins], self.close(compact, arcs))

    def finish(self) -> tuple[np.ndarray, ...]:
        top = np.concatenate(self.top) if self.top else np.empty((0, 3), np.int64)
        if self.top and top.shape[1] == 4:
            ends = top[top[:, 1] < 0]
            inner = top[top[:, 1] >= 0]
            inner = inner[np.lexsort((inner[:, 1], inner[:, 0]))]
            heads = np.unique(top[:, 0])
            root = np.column_stack([heads, np.zeros((len(heads), 2), np.int64)])
            root[np.searchsorted(heads, ends[:, 0]), 1] = ends[:, 2]
            if len(inner):
                owner = np.cumsum(np.diff(inner[:, 0], prepend=-1) > 0) - 1
                root[np.searchsorted(heads, np.unique(inner[:, 0])), 2] = self.close(owner, inner[:, 1:])
            top = root
        self.arcs.append(top)
        self.counts.append(np.array([len(top)]))
        arcs = np.concatenate(self.arcs)
        first = np.concatenate([[0], np.cumsum(np.concatenate(self.counts))])
        return first, arcs[:, 0], arcs[:, 1], arcs[:, 2]


# Prefix ranges

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.array([*map(zlib.crc32, words), 0], np.uint64)


def prefix_ranges(words: Sequence[bytes], labels: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each path (a language and words): by the language and its first two words."""
    known = _hashes(words) + np.uint64(1)
    known[-1] = 0
    h = np.zeros(len(labels), np.uint64)
    for d in range(min(3, labels.shape[1])):
        h = _mix(h ^ (known[labels[:, d]] * np.uint64(0xBF58476D1CE4E5B9)))
    return ((_mix(h) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


class _Shard:
    """Word numbers of texts by language, with a -1 after each piece."""

    def __init__(self) -> None:
        self.number = _Numbers(0)
        self.number[_END] = -1
        self.runs: dict[bytes, list[np.ndarray]] = {}
        self.words = 0

    def add(self, lang: str, text: str) -> None:
        # bytes.lower() and split() know ASCII alone; what split() takes for a space beyond
        # blanks and tabs ends a piece and is no longer there
        read = text.encode().lower().translate(_READ).replace(_END, b" \xff ").split()
        read.append(_END)
        self.runs.setdefault(lang.encode(), []).append(np.fromiter(map(self.number.__getitem__, read), np.int32, len(read)))
        self.words += len(read)

    def transducers(self, longest: int, ranges: int) -> Iterator[tuple[int, bytes]]:
        langs = sorted(self.runs)
        del self.number[_END]
        spoken = sorted(self.number)
        order = np.empty(len(spoken) + 1, np.int32)
        order[np.fromiter(map(self.number.__getitem__, spoken), np.int64, len(spoken))] = np.arange(len(spoken))
        order[-1] = -1
        # languages come first among the labels, so that words keep their order
        words = langs + spoken
        parts = []
        for i, lang in enumerate(langs):
            ids = order[np.concatenate(self.runs.pop(lang))]
            whole, code = ids >= 0, ids.astype(np.int64)
            for size in range(1, longest + 1):
                if size > 1:
                    whole = whole[:-1] & (ids[size - 1:] >= 0)
                    code = code[:len(whole)] * len(spoken) + ids[size - 1:]
                starts = np.flatnonzero(whole)
                if not len(starts):
                    break
                # a code is small: the number of the shorter phrase, then a word
                codes = code[starts]
                by = np.argsort(codes)
                heads = np.flatnonzero(np.diff(codes[by], prepend=-1))
                one = starts[by[heads]]
                grams = np.full((len(heads), longest + 1), -1, np.int32)
                grams[:, 0] = i
                for d in range(size):
                    grams[:, d + 1] = ids[one + d] + len(langs)
                count = np.diff(np.append(heads, len(codes)))
                parts.append(Grams(grams, count))
                if size < longest:
                    code = np.full(len(whole), -1, np.int64)
                    code[starts[by]] = np.repeat(np.arange(len(heads)), count)
        if not parts:
            return
        labels, weights = np.concatenate([p.labels for p in parts]), np.concatenate([p.weights for p in parts])
        parts.clear()
        where = prefix_ranges(words, labels, ranges)
        spoken = _as_arrow(words)
        keys = packed(labels, where)
        by = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
        labels, weights, where = labels[by], weights[by], where[by]
        del keys, by
        edges = np.append(np.flatnonzero(np.diff(where, prepend=-1)), len(where))
        for a, b in zip(edges[:-1], edges[1:]):
            yield int(where[a]), Transducer.build(spoken, Grams(labels[a:b], weights[a:b])).dump()


def shard_transducers(docs: DataFrame, longest: int, ranges: int, shard_words: int) -> DataFrame:
    """(range, counts): the count transducers of shards of ``docs`` (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()

        def flush() -> Iterator[pa.RecordBatch]:
            for where, data in shard.transducers(longest, ranges):
                yield pa.RecordBatch.from_pydict({"range": pa.array([where], pa.int64()), "counts": pa.array([data], pa.binary())})

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    shard.add(lang, text)
                if shard.words >= shard_words:
                    yield from flush()
                    shard = _Shard()
        yield from flush()

    return docs.mapInArrow(run, "range long, counts binary")


def _spoken(t: Transducer, labels: np.ndarray) -> list[list[str]]:
    words = [w.decode() for w in t.words]
    return [[words[i] for i in row if i >= 0] for row in labels.tolist()]


def _frame(spoken: list[list[str]], weights: Sequence[int]) -> pd.DataFrame:
    return pd.DataFrame({
        "lang": pd.Series([s[0] for s in spoken], dtype=object),
        "words": pd.Series([s[1:] for s in spoken], dtype=object), "f": np.asarray(weights, np.int64)})


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10) -> tuple[DataFrame, int]:
    """(range, counts, totals) by prefix range, and the number of ranges.

    ``counts`` is a transducer of the phrases that come ``least`` times or more, ``totals``
    lists the words of each language whose first word lies in the range.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, math.ceil(size / RANGE_BYTES))

    def unite(frame: pd.DataFrame) -> pd.DataFrame:
        united, grams, words = Transducer.union([Transducer.load(x) for x in frame["counts"]], least)
        single = (grams.labels >= 0).sum(axis=1) == 2
        langs, back = np.unique(grams.labels[single, 0], return_inverse=True)
        sums = np.zeros(len(langs), np.int64)
        np.add.at(sums, back, grams.weights[single])
        totals = [{"lang": words[i].decode(), "n": int(n)} for i, n in zip(langs, sums)]
        made = pd.DataFrame({"range": [frame["range"].iloc[0]], "counts": [united.dump()], "totals": [totals]})
        pa.default_memory_pool().release_unused()  # the next range is no smaller
        return made

    shards = shard_transducers(docs, longest, ranges, SHARD_WORDS)
    schema = "range long, counts binary, totals array<struct<lang:string,n:long>>"
    return shards.repartition(ranges, "range").groupBy("range").applyInPandas(unite, schema), ranges


def _phrases(counted: DataFrame) -> DataFrame:
    """(lang, phrase, words, f) of the phrases of two words or more."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["counts"]:
                t = Transducer.load(data)
                grams = t.paths()
                long = (grams.labels >= 0).sum(axis=1) > 2
                spoken = _spoken(t, grams.labels[long])
                frame = _frame(spoken, grams.weights[long])
                yield frame.assign(phrase=frame["words"].map(" ".join).astype(object))

    return counted.select("counts").mapInPandas(run, "lang string, words array<string>, f long, phrase string")


def part_counts(counted: DataFrame, ranges: int, parts: DataFrame) -> DataFrame:
    """``parts`` (lang, words) with their counts f, by composition with the transducers."""
    @F.pandas_udf("long")
    def where(lang: pd.Series, words: pd.Series) -> pd.Series:
        paths = [[x.encode() for x in (a, *w)] for a, w in zip(lang, words)]
        known = sorted({x for p in paths for x in p})
        number = {w: i for i, w in enumerate(known)}
        depth = max(map(len, paths), default=1)
        labels = np.array([[number[x] for x in p] + [-1] * (depth - len(p)) for p in paths], np.int64).reshape(len(paths), depth)
        return pd.Series(prefix_ranges(known, labels, ranges))

    def look(asked: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(counted):
            return _frame([], [])
        paths = [[x.encode() for x in (a, *w)] for a, w in zip(asked["lang"], asked["words"])]
        langs = sorted({p[0] for p in paths})
        known = langs + sorted({x for p in paths for x in p[1:]})
        lang_no = {w: i for i, w in enumerate(langs)}
        number = {w: i + len(langs) for i, w in enumerate(known[len(langs):])}
        depth = max(map(len, paths))
        labels = np.array([[lang_no[p[0]], *(number[x] for x in p[1:])] + [-1] * (depth - len(p)) for p in paths], np.int64)
        acceptor = Transducer.build(known, sum_equal(Grams(labels, np.ones(len(labels), np.int64))))
        t, grams = acceptor.compose(Transducer.load(counted["counts"].iloc[0]))
        return _frame(_spoken(t, grams.labels), grams.weights)

    asked = parts.distinct().withColumn("range", where("lang", "words")).groupBy("range")
    return asked.cogroup(counted.select("range", "counts").groupBy("range")).applyInPandas(
        look, "lang string, words array<string>, f long")


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, covered_percent: int = 50, per_lang: int = 2000,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best ``per_lang`` phrases.

    Phrases have 2 to ``longest`` words of one piece and come ``least`` times or more (a).  Of
    the cuts in two parts the one counts whose score floor(1000000 a a / (l r)) is smallest,
    the first of equals; l and r are the parts' counts, n the language's words.  A phrase inside a
    longer one that comes at least ``covered_percent`` of a times goes.  Ties rank by a, then by
    the phrase's bytes.

    A null language is ``und``, as is that name itself; null and empty texts have no words;
    repeated rows and rows without an id count like any other; other columns are not read; an
    empty table gives no rows.
    """
    named = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    counted, ranges = phrase_counts(named, longest, least)
    counted = write_scratch(counted)
    found = write_scratch(_phrases(counted))
    cuts = found.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(
        F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).withColumns({
            "head": F.slice(F.col("words"), F.lit(1), F.col("k")),
            "tail": F.slice(F.col("words"), F.col("k") + 1, F.size("words"))})
    parts = cuts.select("lang", F.explode(F.array("head", "tail")).alias("words"))
    sizes = write_scratch(part_counts(counted, ranges, parts))

    def count_of(part: str, name: str) -> tuple[DataFrame, list[str]]:
        return sizes.select("lang", F.col("words").alias(part), F.col("f").alias(name)), ["lang", part]

    sized = cuts.join(*count_of("head", "l")).join(*count_of("tail", "r"))
    score = F.expr("CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) * a div (CAST(l AS DECIMAL(19,0)) * r)")
    lowest = sized.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first(F.size("words")).alias("size"))

    def inner(size: int) -> Column:
        """Phrases of ``size`` words inside a longer one."""
        return F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.array_join(F.slice("words", i, size), " "))

    covers = None
    for size in range(2, longest):
        inside = found.filter(F.size("words") > size).select("lang", F.explode(F.array_distinct(inner(size))).alias("phrase"), "f")
        covers = inside if covers is None else covers.unionByName(inside)
    kept = lowest
    if covers is not None:
        most = covers.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        covered = F.coalesce(100 * F.col("longer") >= covered_percent * F.col("a"), F.lit(False))
        kept = lowest.join(most, ["lang", "phrase"], "left").filter(~covered)
    totals = counted.select(F.explode("totals").alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= per_lang)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
