import random

import numpy as np
import pytest
import xxhash

from runledger.llm.components import connected_components
from runledger.llm.vp_simhash import (
    _forest, drop_near_duplicates, similar_links, simhash_components, text_fingerprint,
)

M = 2 ** 64 - 1


def components(points, near=3):
    label = {p: p for p in points}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for i, a in enumerate(points):
        for b in points[:i]:
            if bin((a ^ b) & M).count("1") <= near:
                label[root(a)] = root(b)
    groups = {}
    for p in points:
        groups.setdefault(root(p), set()).add(p)
    return {frozenset(g) for g in groups.values()}


def joined(points, links):
    nearest = {p: {p} for p in points}
    for a, b in links:
        if nearest[a] is not nearest[b]:
            nearest[a] |= nearest[b]
            for p in nearest[b]:
                nearest[p] = nearest[a]
    return {frozenset(g) for g in nearest.values()}


def signed(x):
    return x - 2 ** 64 if x >= 2 ** 63 else x


def some_points(n, seed=1):
    rng = random.Random(seed)
    points = {signed(rng.getrandbits(64)) for _ in range(n)}
    for p in list(points)[: n // 4]:  # chains of near ones
        for _ in range(4):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                p = signed((p ^ (1 << bit)) & M)
            points.add(p)
    centre = signed(rng.getrandbits(64))
    points |= {signed((centre ^ (1 << a) ^ (1 << b)) & M) for a in range(12) for b in range(12)}  # dense
    return sorted(points)


def test_fingerprint_is_defined_bit_by_bit():
    text = "One two  THREE four\tone two three É x"
    words = "one two three four one two three É x".split(" ")
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert text_fingerprint(text) & M == want
    assert text_fingerprint("a b") & M == xxhash.xxh64_intdigest(b"a b", 42)
    assert text_fingerprint(None) == text_fingerprint(" \n") == 0


def test_forest_connects_what_all_links_connect():
    points = some_points(300)
    links = _forest(np.array(points, np.int64).view(np.uint64)[:, None], 3, leaf=50, cells=4000)
    assert joined(points, [(points[a], points[b]) for a, b in links]) == components(points)
    assert len(links) == len(points) - len(components(points))


@pytest.mark.parametrize("blocks", [64, 16_384])
def test_shards_lose_no_link(spark, blocks):
    points = some_points(400)
    df = spark.createDataFrame([(0, p, p) for p in points], "shard bigint, node bigint, fp bigint")
    links = similar_links(df, ["fp"], shard_rows=40, levels=3, block_rows=blocks).collect()
    assert joined(points, [(x.a, x.b) for x in links]) == components(points)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(5, 5), (9, 1), (9, 1)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 60)}}
    assert connected_components(df.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark, documents):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(800)]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        rows.append((10 * i, " ".join(words)))
        for j in range(1, 1 + i % 4):  # copies, exact or with a word changed
            other = list(words)
            if j > 1:
                other[rng.randrange(len(words))] = "new"
            rows.append((10 * i + j, " ".join(other)))
    rng.shuffle(rows)
    prints = {i: text_fingerprint(t) & M for i, t in rows}
    least = {}
    for group in components(sorted(set(prints.values()))):
        least[min(i for i, f in prints.items() if f in group)] = group
    got = {r.doc_id for r in drop_near_duplicates(documents(*rows, fp="x", digest="y")).collect()}
    assert got == set(least) and len(rows) - len(got) > 60


def test_edge_rows(spark, documents):
    df = documents((5, "a b c d"), (3, "A b  C d"), (9, None), (4, ""), (8, " "), (None, "z"), (None, "a b c d"),
                   (5, "a b c d"), (6, "word " * 200_000), fp="x", group="y")
    got = sorted(((r.doc_id, r.component_id) for r in simhash_components(df).collect()), key=repr)
    assert got == sorted([(5, 3), (3, 3), (5, 3), (9, 4), (4, 4), (8, 4), (None, None), (None, 3), (6, 6)], key=repr)
    assert simhash_components(df.limit(0)).count() == 0
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((repr(r.doc_id) for r in kept.collect())) == ["3", "4", "6", "None"]
    assert drop_near_duplicates(df.limit(0)).count() == 0
