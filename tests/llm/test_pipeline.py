import random

import public_tokenizers
from pyspark import SparkContext
from tokenizers import Tokenizer

import corpus_pipeline

WORDS = {
    "en": "the of and to in is that for was on are with this from they have which their said each".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
}


def prose(rng, lang, n):
    return " ".join("".join(rng.sample("etaoinshrdlu", 4)) if rng.random() < 0.4 else rng.choice(WORDS[lang]) for _ in range(n))


def test_stages_over_planted_documents(spark, documents, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(80):
        lang = ["en", "de"][i % 3 == 0]
        rows.append((i, "\n".join(prose(rng, lang, rng.randint(8, 20)) for _ in range(rng.randint(1, 4))), lang, f"src{i % 4}"))
    passage = "\n".join(prose(rng, "en", 20) for _ in range(3))
    rows += [(100, passage + "\n" + prose(rng, "en", 30), "en", "src1"), (101, prose(rng, "en", 30) + "\n" + passage, "en", "src1")]
    rows += [(200, rows[5][1], *rows[5][2:]), (201, "12 34 !!", "en", "src0"), (202, None, "en", "src0"), (203, "", None, None),
             (None, prose(rng, "de", 40), None, "src2")]
    long_one = " ".join(prose(rng, "en", 200) for _ in range(40))
    rows += [(300, long_one, "en", "src3"), (301, long_one + " the end", "en", "src3")]  # near copies on one line
    documents(*rows, n="x", key="y", copies="c", n_deleted="d", n_lines="l").write.parquet(f"{tmp_path}/documents.parquet")

    given = {r[0]: r for r in rows}
    docs, columns, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), None, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = {name: {r.doc_id for r in rows_} for name, rows_ in seen.items()}
    assert set(given) - ids["language_id"] == {201, 202, 203}
    assert next(r for r in seen["language_id"] if r.doc_id is None).lang == "de"
    text = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert passage in text[100] and passage not in text[101] and text[101] == given[101][1].split("\n")[0]
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    # document 5 has copies of its lines in 200: if they were a run, 200 is gone already
    assert 200 not in ids["near_duplicates"] and 301 not in ids["near_duplicates"] and 300 in ids["near_duplicates"]
    assert ids["line_dedup"] - ids["near_duplicates"] <= {200, 301}
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(map(repr, (r.doc_id for r in seen["mixing"]))) == sorted(map(repr, (r.doc_id for r in seen["bpe_encoding"])))
    for r in seen["bpe_encoding"]:
        assert r.ids == reference.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_empty_documents(spark, documents, tmp_path):
    documents().write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_id_rejects_what_no_label_teaches(spark, documents, tmp_path):
    rng = random.Random(8)
    rows = [(i, prose(rng, lang, rng.randint(30, 60)), lang) for i in range(160) for lang in [["en", "de"][i % 2]]]
    rows += [(200, prose(rng, "en", 40), None), (201, prose(rng, "de", 40), None)]
    unlearned = {
        "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
        "zh": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
        "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "junk": " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randint(3, 9))) for _ in range(60)),
    }
    rows += [(300 + i, text, None) for i, text in enumerate(unlearned.values())]
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, documents(*rows), str(tmp_path)).collect()}
    assert {200: "en", 201: "de"}.items() <= kept.items()
    assert not [name for i, name in enumerate(unlearned) if 300 + i in kept]
    assert len(kept) >= 160  # of 162


def test_a_task_keeps_one_python_worker(spark, documents, tmp_path, monkeypatch):
    """Idle workers keep their memory, an executor's as well."""
    rng = random.Random(5)
    df = documents(*[(i, prose(rng, ["en", "de"][i % 2], 20), ["en", "de", None][i % 3]) for i in range(60)])
    df.write.parquet(path := f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(path)

    def refuse(*args):
        raise AssertionError("rows that go through Python workers of another kind")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    found = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert found.filter("lang = 'de'").count() > 0
    assert corpus_pipeline.mixing(spark, docs, str(tmp_path)).count() > 0
