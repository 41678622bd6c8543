"""SimHash near-duplicates, found with vantage-point trees over Hamming distance.

``fingerprints`` gives every text a 64-bit SimHash.  ``similar_links`` cuts the distinct
fingerprints into shards by rounds of a tree with several vantage points to a node:
each round picks, in every shard that is still too large, ``levels`` of its own
fingerprints as vantage points and a radius for each.  A
fingerprint beyond a radius goes outside, and also inside if it lies within the
linking distance of the radius; by the triangle inequality two linked fingerprints meet
in a shard.  Inside a shard a smaller tree of the same kind prunes what is compared.

A shard gives a spanning forest of its links, not the links themselves: within a group
of n near copies that is n - 1 rows.  Components over the forests are those of all links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.batches import join_counted, map_rows
from runledger.llm.components import connected_components
from runledger.session import write_scratch

_SEED = 42
_PIECE = 100_000


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) words of ``text``, as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # bytes split at \x20 \x09-\x0D alone
    if not words:
        return 0
    total, ones = max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    for at in range(0, total, _PIECE):
        part = words[at:at + _PIECE + shingle - 1]
        runs = [b" ".join(part)] if len(words) < shingle else map(b" ".join, zip(*[part[i:] for i in range(shingle)]))
        hashes = np.fromiter((xxhash.xxh64_intdigest(r, _SEED) for r in runs), np.dtype("<u8"))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def _digest() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, digest, fp bigint) for every row of ``docs``, the digest that of the text; null
    texts count as empty."""
    def scan(ids: list, digests: list, texts: list) -> list:
        return [ids, digests, [text_fingerprint(t, shingle) for t in texts]]

    named = docs.select(F.col("doc_id").cast("bigint"), _digest().alias("digest"), "text")
    return map_rows(named, scan, "doc_id bigint, digest string, fp bigint")


def _distance(words: list[str], point: str) -> Column:
    return sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{point}_{w}"))) for w in words), F.lit(0))


def _radii(placed: DataFrame, near: int, levels: int) -> DataFrame:
    """(shard, r0, r1, ...): for each vantage point the radius that leaves least to compare.

    A cut at r gives an inside of d <= r + near and an outside of d > r; what is left to
    compare is the sum of their squares.  A cut that saves under a twentieth is not made
    (null): the shard is too dense there.
    """
    seen = placed.select("shard", F.posexplode(F.array(*[f"d{i}" for i in range(levels)])).alias("level", "d"))
    bins = seen.groupBy("shard", "level", "d").agg(F.count(F.lit(1)).alias("n"))  # a row for each distance
    upto = Window.partitionBy("shard", "level").orderBy("d")
    total = F.sum("n").over(Window.partitionBy("shard", "level"))
    inside = F.sum("n").over(upto.rangeBetween(Window.unboundedPreceding, near))
    left = (inside / total) ** 2 + (1 - F.sum("n").over(upto) / total) ** 2
    best = bins.select("shard", "level", "d", left.alias("left")).filter("left <= 0.95")
    cuts = best.groupBy("shard", "level").agg(F.min(F.struct("left", "d"))["d"].alias("r"))
    return cuts.groupBy("shard").agg(*[F.max(F.when(F.col("level") == i, F.col("r"))).alias(f"r{i}") for i in range(levels)])


def _shards(points: DataFrame, words: list[str], near: int, shard_rows: int, levels: int, rounds: int) -> DataFrame:
    """``points`` (shard, node, words) in smaller shards: every pair within ``near`` bits
    that shared a shard still does."""
    zero = F.lit(0).cast("bigint")
    own_columns = ["node", *words]
    rows = write_scratch(points.select("shard", F.lit(None).cast("bigint").alias("was"), *own_columns))
    done = []
    for turn in range(rounds):
        sizes = rows.groupBy("shard").agg(
            F.count(F.lit(1)).alias("n"), F.max("was").alias("was"),
            # vantage points: the fingerprints that come first in one order for each level
            *[F.min_by(w, F.xxhash64("node", F.lit(turn * 64 + i))).alias(f"v{i}_{w}") for i in range(levels) for w in words],
        )
        # a shard that the last round hardly made smaller is too dense for the tree
        shrinks = F.col("was").isNull() | (F.col("n") < 0.9 * F.col("was"))
        large = write_scratch(sizes.filter((F.col("n") > shard_rows) & shrinks).drop("was"))
        if large.isEmpty():
            break
        # At most rows / shard_rows shards are large; Spark broadcasts them only while they are small.
        done.append(rows.join(large.select("shard"), "shard", "left_anti").select("shard", *own_columns))
        placed = write_scratch(rows.join(large, "shard").select(
            "shard", "n", *own_columns, *[_distance(words, f"v{i}").alias(f"d{i}") for i in range(levels)]))
        # Bit i of a side: outside radius i.  A fingerprint goes to its own side and to all
        # that differ only in bits whose radius it lies just beyond.
        own, loose = zero, zero
        for i in range(levels):
            # no more levels than the size asks for; a level shrinks a shard to about two thirds
            beyond = (F.col("n") > shard_rows * 1.5 ** i) & (F.col(f"d{i}") > F.col(f"r{i}"))
            bit = F.lit(1 << i).cast("bigint")
            own += F.when(beyond, bit).otherwise(zero)
            loose += F.when(beyond & (F.col(f"d{i}") <= F.col(f"r{i}") + near), bit).otherwise(zero)
        every = F.sequence(zero, F.lit((1 << levels) - 1).cast("bigint"))
        sides = F.filter(every, lambda s: s.bitwiseXOR(F.col("own")).bitwiseOR(F.col("loose")) == F.col("loose"))
        # a new number for (shard, side); shards that meet under one number are compared
        # together, which costs time but loses nothing
        rows = write_scratch(
            placed.join(_radii(placed, near, levels), "shard", "left")
            .select("shard", "n", *own_columns, own.alias("own"), loose.alias("loose"))
            .select("shard", "n", *own_columns, F.explode(sides).alias("side"))
            .select(F.xxhash64("shard", "side", F.lit(turn)).alias("shard"), F.col("n").alias("was"), *own_columns))
    out = rows.select("shard", *own_columns)
    for part in done:
        out = out.unionByName(part)
    return out


def _forest(fps: np.ndarray, near: int, leaf: int = 2048, cells: int = 1 << 20) -> list[tuple[int, int]]:
    """Row numbers (a row of ``fps``, another of its component) that connect what all
    links among ``fps`` (n x words) connect: one fewer than a component has rows.

    A vantage-point tree in memory: a node is cut at the radius that leaves least to
    compare, with the same overlap as the shards.  A leaf is sorted by the distance to
    its vantage point, so that each is compared only with those whose distance lies
    within ``near`` of its own.  ``cells`` bounds the pairs that are compared at once.
    """
    bits = 64 * fps.shape[1]
    label = np.arange(len(fps))

    def compare(own: np.ndarray, d: np.ndarray) -> None:
        nonlocal label
        turn = np.argsort(d, kind="stable")
        own, d = own[turn], d[turn]
        mine = [np.ascontiguousarray(fps[own, w]) for w in range(fps.shape[1])]
        first = mine[:max(1, len(mine) * 3 // 4)]  # most of the words rule out nearly all pairs
        chunk = max(1, min(256, cells // len(own)))
        for at in range(0, len(own), chunk):
            end = min(at + chunk, len(own))
            stop = np.searchsorted(d, d[end - 1] + near, side="right")
            far = sum(np.bitwise_count(m[at:end, None] ^ m[None, at:stop]) for m in first)
            i, j = np.nonzero(far <= near)
            i, j = i + at, j + at
            if len(mine) > len(first):
                whole = sum(np.bitwise_count(m[i] ^ m[j]).astype(np.int64) for m in mine)
                i, j = i[whole <= near], j[whole <= near]
            i, j = own[i], own[j]
            while True:
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                if not len(i):
                    break
                low = np.minimum(label[i], label[j])
                np.minimum.at(label, label[i], low)
                np.minimum.at(label, label[j], low)
                while (label[label] != label).any():
                    label = label[label]

    todo = [np.arange(len(fps))]
    while todo:
        own = todo.pop()
        if len(own) < 2:
            continue
        d = np.bitwise_count(fps[own] ^ fps[own[len(own) // 2]]).astype(np.int64).sum(1)
        upto = np.cumsum(np.bincount(d, minlength=bits + 1 + near)) / len(own)
        left = upto[near:bits + 1 + near] ** 2 + (1 - upto[:bits + 1]) ** 2
        r = int(left.argmin())
        if len(own) <= leaf or left[r] > 0.95:
            compare(own, d)
        else:
            todo += [own[d <= r + near], own[d > r]]
    own = np.flatnonzero(label != np.arange(len(fps)))
    return list(zip(own.tolist(), label[own].tolist()))


def similar_links(
    points: DataFrame, words: list[str], near: int = 3, shard_rows: int = 50_000, levels: int = 6, rounds: int = 12,
    block_rows: int = 65_536,
) -> DataFrame:
    """(a, b): nodes whose links connect exactly what all pairs of ``points`` within
    ``near`` bits and in one shard connect.

    ``points`` has shard, node and the fingerprint's ``words`` (bigint), a row for each
    shard of a node.  A shard that the tree can't cut below ``block_rows`` (dense
    fingerprints) is compared by pairs of hashed blocks on several tasks.
    """
    shards = write_scratch(_shards(points, words, near, shard_rows, levels, rounds))
    sizes = shards.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    dense = write_scratch(sizes.filter("blocks > 1"))  # at most rows / block_rows
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    split = shards.join(dense, "shard").select("shard", "node", *words, own.alias("own"), other.alias("other")).select(
        "shard", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "node", *words)
    cells = shards.join(dense, "shard", "left_anti").select(
        "shard", F.lit(0).alias("one"), F.lit(0).alias("two"), "node", *words).unionByName(split)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        fps = group[words].to_numpy(np.int64).view(np.uint64)
        nodes = group["node"].to_numpy()
        links = np.array(_forest(fps, near), np.int64).reshape(-1, 2)
        return pd.DataFrame(nodes[links], columns=["a", "b"])

    # by all three: rows that a join left together by shard alone would stay in one task
    return cells.repartition("shard", "one", "two").groupBy("shard", "one", "two").applyInPandas(compare, "a bigint, b bigint")


def _grouped(points: DataFrame, near: int) -> DataFrame:
    """``points``, one row for each fingerprint ``fp``, with the number of their ``group``."""
    nodes = points.select(F.lit(0).cast("bigint").alias("shard"), F.col("fp").alias("node"), "fp")
    groups = connected_components(similar_links(nodes, ["fp"], near), "fp", "group")
    return points.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp"))


def simhash_components(docs: DataFrame, shingle: int = 3, near: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Fingerprints link at ``near`` or fewer differing bits; component_id is the smallest
    doc_id reachable.  Null and empty texts have fingerprint zero, linked like any other.
    Repeated rows keep a row each.  Null doc_ids never name a component, unless it has no
    other.  An empty table gives no rows; other columns are not read.
    """
    prints = write_scratch(fingerprints(docs, shingle).select("doc_id", "fp"))
    # copies meet here, before anything is compared
    points = write_scratch(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    named = _grouped(points, near)
    smallest = named.groupBy("group").agg(F.min("least").alias("component_id"))
    by_print = write_scratch(named.join(smallest, "group").select("fp", "component_id", "n"))
    return join_counted(prints, by_print, ["fp"], prints.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, near: int = 3) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near copies: the one with
    the smallest doc_id (null last, then the smallest digest of its text).

    Groups are those of simhash_components.  Of rows with that doc_id and text one stays.  All
    columns are kept, whatever their names.  Null and empty texts form one group.  An
    empty table gives an empty one.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "digest"))
    points = write_scratch(fingerprints(docs, shingle).groupBy("fp").agg(first.alias("first")))
    winners = _grouped(points, near).groupBy("group").agg(F.min("first").alias("first")).select("first.id", "first.digest")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("id"), _digest().alias("digest"))
    same = F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.digest") == F.col("w.digest"))
    kept = packed.alias("d").join(winners.alias("w"), same, "left_semi")
    return kept.dropDuplicates(["id", "digest"]).select("row.*")
