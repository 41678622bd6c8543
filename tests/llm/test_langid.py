import random

import numpy as np

from runledger.llm import langid

LETTERS = {"aa": "abcdefg ", "bb": "efghijkl ", "cc": "xyzéü "}


def texts(n, seed):
    rng = random.Random(seed)
    return [(lang, "".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(30, 120)))) for lang in LETTERS for _ in range(n)]


def test_held_out_accuracy_and_edge_rows(spark, documents):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts(60, 1))]
    rows += [(900, None, "aa"), (901, "12 !", "aa"), (902, "", None), (None, "xyz xyz xyz", "cc"), (903, "xyzé " * 200_000, None),
             (0, rows[0][1], "aa")]
    df = documents(*rows, hash="h", label="l", grams="g")
    got = langid.predict_languages(df, per_label=40, landmarks_per_label=8).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i in (900, 901, 902):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[903].lang_pred == "cc" and by_id[None].lang_pred == "cc" and by_id[None].held_out is False
    known = [(by_id[i], lang) for i, _, lang in rows[:180]]
    assert sum(r.held_out for r, _ in known) > 20
    assert all(r.lang_pred == lang and 0 <= r.score <= 1 for r, lang in known)
    assert langid.predict_languages(df.limit(0)).count() == 0
    unlabelled = documents((4, "some text", None), (1, "other", None))
    assert {r.lang_pred for r in langid.predict_languages(unlabelled).collect()} == {"und"}


def test_folded_product_equals_the_kernel(spark, documents):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts(20, 2))]
    df = documents(*rows)
    model = langid.train(df, per_label=1000, landmarks_per_label=5, ridge=0.1)
    grams = langid.Grams()
    sets = [set(grams(t).tolist()) for _, t, _ in rows]

    def k(a, b):
        return len(a & b) / (len(a) * len(b)) ** 0.5

    hashed = {r.hash: r.doc_id for r in df.selectExpr("doc_id", "xxhash64(text) AS hash").collect()}
    marks = [sets[hashed[h]] for lang in sorted(LETTERS)
             for h in sorted(h for h, i in hashed.items() if rows[i][2] == lang)[:5]]
    big = np.array([[k(s, m) for m in marks] for s in sets])
    among = np.array([[k(s, m) for m in marks] for s in marks])
    y = np.array([[1.0 if lang == x else -1.0 for x in sorted(LETTERS)] for _, _, lang in rows])
    beta = np.linalg.solve(big.T @ big + 0.1 * among + 1e-6 * len(marks) * np.eye(len(marks)), big.T @ y)
    want = big @ beta
    assert np.allclose(model.outputs([grams(t) for _, t, _ in rows]), want, atol=1e-3)


def test_long_texts_are_read_whole_in_pieces():
    grams = langid.Grams()
    text = "".join(random.Random(1).choice("abcdefghij klm") for _ in range(5000)) + " zq"
    assert grams(text, piece=64).tolist() == grams(text).tolist()
