import hashlib
import os
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Reference

from runledger.llm.bpe import Part, Tokenizer, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as file:
        return Tokenizer(file.read())


@pytest.fixture(scope="module")
def reference():
    return Reference.from_file(PATH)


ALPHABETS = ["ab", "a", "the and of ", "aé漢 \n", " \t\n ", "'s're'll x", "0123 .,!", "abcdefghijklmnopqrstuvwxyz",
             "🙂é😀", "   a", "''r e"]


def texts(n, seed=5):
    rng = random.Random(seed)
    for i in range(n):
        alphabet = rng.choice(ALPHABETS)
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400)))
        yield "".join(rng.choice(ALPHABETS)[:rng.randint(1, 9)] for _ in range(rng.randint(0, 60)))


def test_parts_joined_anywhere_equal_the_library(own, reference):
    rng = random.Random(1)
    for text in texts(150):
        want = reference.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        for _ in range(3):
            size = rng.randint(1, 60)
            parts = [own.part(text[i:i + size]) for i in range(0, len(text), size)] or [own.part("")]
            joined = own.join_all(parts)
            assert joined.ids.tolist() == want, (text, size)
            whole = own.part(text)
            assert joined.text == text and joined.starts.tolist() == whole.starts.tolist()
            assert joined.first.tolist() == whole.first.tolist()


def test_long_words_joined_by_growing_windows(own):
    rng = random.Random(2)
    for alphabet in ("a", "ab", "abcdefghijklmnop", "漢é", "!?", "=-"):
        for n in (600, 3000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            for cut in (1, n // 3, n // 2, n - 1):
                left, right = own.part(text[:cut]), own.part(text[cut:])
                assert own.join(left, right).ids.tolist() == own.encode(text)
    halves = [own.word("ab" * 700), own.word("c" * 901)]
    assert own.join_word(*halves) == own.word("ab" * 700 + "c" * 901)


def test_documents(spark, documents, reference):
    end = "<|endoftext|>"
    rows = [(1, "Hello world's  end\n"), (2, None), (3, ""), (3, ""), (4, f"a{end}b {end}{end} <|endof"), (None, "x"),
            (5, "word " * 300 + "x" * 900), (6, "word " * 300 + "x" * 900), (7, ("é🙂 " + end) * 200), (8, "a" * 999 + end)]
    df = documents(*rows, key="k", ids="i", segment="s")
    wanted = ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")
    got = [tuple(r) for r in encode_documents(df, PATH, wanted, split_chars=200).collect()]
    want = []
    for i, text in rows:
        ids = reference.encode(text or "", add_special_tokens=False).ids
        back = reference.decode(ids, skip_special_tokens=False)
        assert back == (text or "")
        want.append((i, len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), back,
                     hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert encode_documents(df.limit(0), PATH).count() == 0
