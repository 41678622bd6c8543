import math
import re

from runledger.llm.license_texts import FULL_TEXTS
from runledger.llm.license_tfidf import STOP_WORDS, TEMPLATES, WORDS, scan_licenses


def words(text):
    return set(re.findall(WORDS, text.lower())) - set(STOP_WORDS)


def brute(rows, least=0.7):
    """{(path, text): (cosine, license)} of lines, blocks and whole texts, in plain Python."""
    templates = [(name, words(body)) for name, body in TEMPLATES]
    known = set().union(*(t for _, t in templates))
    df = {w: sum(w in words(text) for _, text in rows) for w in known}
    n = len(rows)
    idf = {w: math.log((n + 1) / (df[w] + 1)) + 1 for w in known}
    rare = math.log(n + 1) + 1

    def best(unit, others):
        square = sum(idf[w] ** 2 for w in unit) + others * rare ** 2
        scores = [(-round(sum(idf[w] ** 2 for w in unit & t) / math.sqrt(square * sum(idf[w] ** 2 for w in t)), 6), name)
                  for name, t in templates if unit & t]
        return min(scores, default=None)

    out = {}
    for path, text in rows:
        found, block = [], []
        for line in [*text.split("\n"), ""]:
            unit = words(line)
            if unit & known:
                found.append(best(unit & known, len(unit - known)))
                block.append(unit)
                continue
            if len(block) > 1:
                found.append(best(set().union(*block) & known, sum(len(u - known) for u in block)))
            block = []
        header = min((f for f in found if f and -f[0] >= least), default=None)
        whole = words(text)
        whole = best(whole & known, len(whole - known))
        whole = whole if whole and -whole[0] >= least else None
        out[path, text] = (header, whole)
    return out


APACHE = TEMPLATES[1][1]
MORE = " ".join(f"word{chr(97 + i)}" for i in range(20))


def test_cosines_origins_and_inheritance(spark):
    rows = [
        ("LICENSE", MORE + "\nReleased under the MIT License."), ("a.txt", "nothing here"), ("b/c/d.txt", "plain words"),
        ("b/LICENSE.md", APACHE), ("b/c/e.txt", MORE + "\nThis work is licensed under the GNU General Public License, version 3.\n" + MORE),
        ("b/x/notes.txt", "All rights reserved."), ("b/x/y/z.txt", "some file"),
        ("h/long.txt", "intro\n" + APACHE.replace("; ", ";\n").replace("You may", "\nYou may") + "\n\n" + MORE),
        ("q.txt", "the software is a file and a copy of a program"), ("lic/COPYING", "no notice"), ("lic/f", "word"),
    ]
    rows += [(f"b/many/{i}.txt", f"text number {i}") for i in range(40)]
    df = spark.createDataFrame([(*r, "k", "t") for r in rows], "path string, text string, terms string, folder string")
    got = {r.path: r for r in scan_licenses(df).collect()}
    assert len(got) == len(rows)
    for (path, _), (header, whole) in brute(rows).items():
        want = whole or header
        if want:
            assert (got[path].license, got[path].cosine) == (want[1], -want[0]), path
        else:
            assert got[path].origin in ("inherited", None), path
    where = {p: (r.license, r.origin, r.license_path) for p, r in got.items()}
    assert where["LICENSE"] == ("MIT", "file", "LICENSE") and where["a.txt"] == ("MIT", "inherited", "LICENSE")
    assert where["b/c/d.txt"] == ("Apache-2.0", "inherited", "b/LICENSE.md")
    assert where["b/c/e.txt"] == ("GPL-3.0", "header", "b/c/e.txt")
    assert where["b/x/notes.txt"][:2] == ("Proprietary", "file")
    assert where["b/x/y/z.txt"] == ("Proprietary", "inherited", "b/x/notes.txt")
    assert where["h/long.txt"] == ("Apache-2.0", "header", "h/long.txt")
    assert where["lic/f"] == ("MIT", "inherited", "LICENSE") and where["b/many/7.txt"][0] == "Apache-2.0"


def test_edge_rows(spark):
    df = spark.createDataFrame(
        [(None, None), (None, "Released under the MIT License."), ("", ""), ("a", None), ("d/b", "All rights reserved."),
         ("d/b", "All rights reserved."), ("d/c", "word " * 200_000)], "path string, text string")
    got = sorted(((r.path, r.license, r.origin, r.license_path) for r in scan_licenses(df).collect()), key=repr)
    assert got == sorted([
        (None, None, None, None), (None, "MIT", "file", None), ("", None, None, None), ("a", None, None, None),
        ("d/b", "Proprietary", "file", "d/b"), ("d/b", "Proprietary", "file", "d/b"), ("d/c", "Proprietary", "inherited", "d/b")], key=repr)
    assert scan_licenses(df.limit(0)).count() == 0


def full_cosine(text, body, rows):
    """The cosine of a text with a full license text, over the words of all of those; ``rows``: the words of each text."""
    known = set().union(*(words(b) for _, b in FULL_TEXTS))
    idf = {w: math.log((len(rows) + 1) / (sum(w in r for r in rows) + 1)) + 1 for w in known}
    unit, others = words(text) & known, len(words(text) - known)
    square = sum(idf[w] ** 2 for w in unit) + others * (math.log(len(rows) + 1) + 1) ** 2
    return round(sum(idf[w] ** 2 for w in unit & words(body)) / math.sqrt(square * sum(idf[w] ** 2 for w in words(body))), 6)


def test_full_texts_cover_their_directory(spark):
    rows = {}
    for name, body in FULL_TEXTS:
        rows[f"{name}/terms.txt"] = f"Copyright (c) 2021 Ada Example\n\n{body}"
        rows[f"{name}/src/deep/code.c"] = "plain words of a program"
    rows["mixed/code.c"] = FULL_TEXTS[0][1] + "\n" + " ".join(f"name{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(12))
    rows["mixed/other.c"] = "plain words"
    rows |= {f"MIT/many/{i}.c": "plain words" for i in range(3000)}
    df = spark.createDataFrame(list(rows.items()), "path string, text string")
    got = {r.path: r for r in scan_licenses(df).collect()}
    assert got.keys() == rows.keys()
    known = [words(text) for text in rows.values()]
    for name, _ in FULL_TEXTS:
        at = f"{name}/terms.txt"
        assert (got[at].license, got[at].origin, got[at].license_path) == (name, "file", at)
        assert got[at].cosine == max(full_cosine(rows[at], body, known) for _, body in FULL_TEXTS)
        below = got[f"{name}/src/deep/code.c"]
        assert (below.license, below.origin, below.license_path) == (name, "inherited", at)
    # a program with the text on top has the license, but no directory
    assert (got["mixed/code.c"].license, got["mixed/code.c"].origin, got["mixed/other.c"].license) == ("MIT", "header", None)
    assert all(got[f"MIT/many/{i}.c"].license_path == "MIT/terms.txt" for i in range(3000))
    assert scan_licenses(df.limit(0)).count() == 0
