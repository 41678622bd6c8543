import random
import re

import pytest

from runledger.llm.line_winnow import drop_copied_lines

LONG = 50


def brute(rows, run=3, long_words=LONG):
    """Texts after dedup, by the definition; rows are (doc_id, text) with distinct ids."""
    word = r"[^\x20\x09-\x0D]+"
    seen, out = {}, {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        cut = set()
        for s in range(len(lines)):
            sizes = [run] if s + run <= len(lines) and any(re.search(word, x) for x in lines[s:s + run]) else []
            if len(re.findall(word, lines[s])) >= long_words:
                sizes.append(1)
            for size in sizes:
                content = tuple(x if re.search(word, x) else "" for x in lines[s:s + size])
                if (size, content) in seen:
                    cut |= set(range(s, s + size))
                seen.setdefault((size, content), (i, s))
        out[i] = ("\n".join(x for j, x in enumerate(lines) if j not in cut), len(lines), len(cut))
    return out


def found(df):
    return {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_its_definition(spark, documents, seed):
    rng = random.Random(seed)
    passages = [[f"p{k} {j}" for j in range(rng.randint(1, 7))] for k in range(4)] + [["", " ", ""], ["w " * 55 + str(seed)]]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            lines += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(["a", "b", "", f"own {i} {rng.random()}"])]
        rows.append((i, "\n".join(lines)))
    assert found(drop_copied_lines(documents(*rows, h="x", start="y", runs="z", row="r"))) == brute(rows)


def test_only_later_copies_of_whole_runs_go(spark, documents):
    df = documents((1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb\nx"), (4, "q\nq\nq\nq\nq"))
    assert found(drop_copied_lines(df)) == {
        1: ("a\nb\nc\nd", 4, 0), 2: ("x\ny", 5, 3), 3: ("a\nb\nx", 3, 0), 4: ("q", 5, 4)}


def test_edge_rows(spark, documents):
    df = documents((1, None), (2, ""), (None, "a\nb\nc\n"), (5, "a\nb\nc\n"), (5, "a\nb\nc\n"), (6, "word " * 200_000),
                   (7, "line\n" * 20_000))
    out = drop_copied_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_deleted"]
    got = sorted(((r.doc_id, (r.text or "x")[:20], r.n_lines, r.n_deleted) for r in out.collect()), key=repr)
    assert got == sorted([(1, "x", 0, 0), (2, "x", 1, 0), (None, "x", 4, 4), (5, "a\nb\nc\n", 4, 0), (5, "a\nb\nc\n", 4, 0),
                          (6, ("word " * 4), 1, 0), (7, "line\n", 20_001, 19_999)], key=repr)
    assert drop_copied_lines(df.limit(0)).count() == 0


def test_short_runs_of_many_words(spark, documents):
    one, two = " ".join(f"a{i}" for i in range(44)), " ".join(f"b{i}" for i in range(42))
    few = "only a few words"
    rows = [(1, f"{one}\n{two}"), (2, f"x\n{one}\n{two}\ny"), (3, f"{one}\ny\n{two}"), (4, f"{few}\n{two}\n{few}"),
            (5, f"{few}\n{two}"), (6, f"{one}\n{two}"), (7, f"{one} {two}\n{few}\nq"), (8, f"{one} {two}\n{few}\nr")]
    kept = {r.doc_id: (r.text, r.n_deleted) for r in drop_copied_lines(documents(*rows), short_runs=True).collect()}
    assert kept == {1: (rows[0][1], 0), 2: ("x\ny", 2), 3: (rows[2][1], 0), 4: (rows[3][1], 0), 5: (rows[4][1], 0), 6: ("", 2),
                    7: (rows[6][1], 0), 8: (f"{few}\nr", 1)}


@pytest.mark.parametrize("seed", range(2))
def test_short_runs_equal_their_definition(spark, documents, seed):
    def cut(rows, run, enough):
        seen, out = set(), {}
        for i, text in sorted(rows):
            lines = text.split("\n")
            gone = set()
            for s in range(len(lines)):
                short = next((k for k in range(1, run) if s + k <= len(lines) and len(" ".join(lines[s:s + k]).split()) >= enough), None)
                for size in [short, run if s + run <= len(lines) and "".join(lines[s:s + run]).strip() else None]:
                    if size:
                        content = (size, *(x.strip() and x for x in lines[s:s + size]))
                        gone |= set(range(s, s + size)) if content in seen else set()
                        seen.add(content)
            out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        return out

    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcdef", k=rng.randint(0, 6))) for _ in range(14)] + ["", " "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 7)))) for i in range(80)]
    got = {r.doc_id: r.text for r in drop_copied_lines(documents(*rows), 4, 9, short_runs=True).collect()}
    assert got == cut(rows, 4, 9)


def test_clashing_names(documents):
    with pytest.raises(ValueError):
        drop_copied_lines(documents((1, "a"), n_lines="x"))
    got = drop_copied_lines(documents((1, "a"), N_Lines="x"), n_lines="lines", n_deleted="cut")
    assert got.columns[-2:] == ["lines", "cut"]
