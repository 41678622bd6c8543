import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from runledger.llm import entry, suffix_dedup


def brute(rows, least):
    raws = [(text or "").encode() for _, text in rows]
    times = Counter(raw[i:i + least] for raw in raws for i in range(len(raw) - least + 1))
    out = []
    for (doc_id, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - least + 1):
            if times[raw[i:i + least]] > 1:
                gone[i:i + least] = b"\1" * least
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def random_texts(rng, n, unit):
    """Texts that share passages, with edits, and repeat themselves."""
    def fresh(size):
        return "".join(rng.choices("abcdefgh äß€\n", k=size))

    passages = [fresh(rng.randrange(unit // 2, unit * 3)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.random()
            if kind < 0.4:
                parts.append(fresh(rng.randrange(unit * 2)))
            elif kind < 0.8:
                p = rng.choice(passages)
                if rng.random() < 0.5:
                    at = rng.randrange(len(p))
                    p = p[:at] + rng.choice(["X", "", "é"]) + p[at + 1:]
                parts.append(p[rng.randrange(len(p)) // 3:])
            elif kind < 0.9:
                parts.append(rng.choice("a-é") * rng.randrange(unit * 2))
            else:
                parts.append(fresh(rng.randrange(1, 9)) * rng.randrange(unit // 3))
        texts.append("".join(parts))
    return texts


def test_ranks_and_anchors():
    rng = random.Random(1)
    for length in (1, 2, 5, 41, 200):
        data = np.frombuffer(bytes(rng.choices(b"ab", k=600)), np.uint8)
        ranks = suffix_dedup.doubled_ranks(data, length)
        strings = [data[i:i + length].tobytes() for i in range(600 - length + 1)]
        assert len(ranks) == len(strings) and len(set(ranks)) == len(set(strings)) == len(set(zip(ranks, strings)))
    data = np.frombuffer(bytes(rng.choices(b"abc", k=900)), np.uint8)
    place, rank, first, last = suffix_dedup.anchors(data, 30, 20)
    assert first[0] == 0 and last[-1] == 870 and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place < first + 20)).all() and (last >= first).all()
    assert all(len(a) == 0 for a in suffix_dedup.anchors(data[:29], 30, 20))


@pytest.mark.parametrize("class_places, block", [(4096, 16384), (3, 2), (0, 5)])
def test_operator_equals_brute_force(documents, class_places, block):
    rng = random.Random(class_places)
    rows = list(enumerate(random_texts(rng, 60, 30)))
    rows += [(100, None), (101, ""), (102, "a" * 19), (None, rows[3][1]), (7, rows[7][1]), (7, "other" + rows[8][1])]
    got = suffix_dedup.remove_repeats(documents(*rows, g="g", x="x", spans="s"), least_bytes=20, window=14,
                                      class_places=class_places, block_places=block)
    want = brute(rows, 20)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(r[2] > 0 for r in want) > 30 and any(r[3] > 1 for r in want)


def test_query_equals_brute_force(spark, documents, tmp_path):
    rng = random.Random(8)
    rows = list(enumerate(random_texts(rng, 40, 300)))
    rows += [(200, "z" * 199), (201, "z" * 200), (202, rows[1][1]), (203, "y" * 201)]
    documents(*rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.QUERIES["op13_suffix_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 200)


def test_kept_bytes_and_spans(documents):
    rows = [(1, "one passage" + "q" * 4), (2, "--one passage--")]
    got = suffix_dedup.remove_repeats(documents(*rows), ("kept", "removed"), least_bytes=8, window=5).collect()
    found = {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.removed]) for r in got}
    assert found == {1: (b"qqqq", [(0, 11)]), 2: (b"----", [(2, 13)])}


def test_empty_table(documents):
    assert suffix_dedup.remove_repeats(documents().limit(0)).count() == 0


def test_long_texts(documents):
    started = time.time()
    rows = [(1, "a" * 2_000_000), (2, "ab" * 500_000), (3, "".join(random.Random(1).choices("abc ", k=1_000_000)))]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(documents(*rows)).collect()}
    assert got == {1: (2_000_000, 1), 2: (1_000_000, 1), 3: (0, 0)}
    assert time.time() - started < 60
