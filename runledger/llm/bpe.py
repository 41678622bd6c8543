"""Byte-level BPE over whole texts; long unsplit texts are encoded in parts.

A text of more than ``split_chars`` characters is cut into parts that any task may
encode.  The parts are then joined two and two, as a tree:

* the split into words is scanned again from the last sure word start of the left part
  until it agrees with a word start of the right part;
* a word that crosses the join is not encoded anew: a window of tokens around the join
  is, and grows until both ends agree exactly.  An encoding is right if each pair of
  neighbours is the encoding of its own text, so that agreement of the two pairs at the
  window's ends proves the whole.

Ids equal those of the tokenizers library for the same file; the merges themselves run
in tiktoken, which is given the file's vocabulary as ranks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.batches import map_rows, once

# The byte-level word pattern and the printable stand-ins of bytes.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: Characters that the pattern may look at beyond a word's end.
_MARGIN = 3
#: Words of fewer characters are encoded afresh at a join.
_LONG_WORD = 512
_PARTS = "key string, segment int, part int, special int, text string"
_CODED = "key string, segment int, part int, special int, text string, starts binary, first binary, ids binary"


class Part(NamedTuple):
    """An encoded text: word starts in characters, each word's first token, token ids."""
    text: str
    starts: np.ndarray
    first: np.ndarray
    ids: np.ndarray


class Tokenizer:
    """A byte-level BPE tokenizer read from a tokenizers JSON file.

    Refuses files whose ids are not in merge order, that normalise, or that split words
    in another way.
    """

    def __init__(self, spec: str):
        read = json.loads(spec)
        kind, before = read["model"], read["pre_tokenizer"]
        plain = (
            kind["type"] == "BPE" and not read.get("normalizer") and not read.get("post_processor")
            and before["type"] == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
            and not any(kind.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                              "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in read["added_tokens"])
        )
        if not plain:
            raise ValueError("not a plain byte-level BPE file")
        others = [b for b in range(256) if b not in set(_PRINTABLE)]
        byte_of = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in kind["vocab"].items() if token not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in kind["merges"]]
        order = [kind["vocab"][a + b] for a, b in pairs]
        if order != sorted(set(order)):
            raise ValueError("token ids are not in merge order")
        self.coder = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=self.special)
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.names = [str(i) for i in range(max([*ranks.values(), *self.special.values()]) + 1)]

    def encode(self, text: str) -> list[int]:
        return self.coder.encode(text, allowed_special="all", disallowed_special=())

    def decode(self, ids: Sequence[int]) -> str:
        return self.coder.decode_bytes(ids).decode("utf-8", "replace")

    def ids_text(self, ids: Sequence[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(itemgetter(*ids)(self.names)) if len(ids) > 1 else "".join(map(str, ids))

    def word(self, text: str) -> list[int]:
        return self._piece(text.encode())

    def _piece(self, raw: bytes) -> list[int]:
        return self.coder._core_bpe.encode_single_piece(raw)

    def bytes_of(self, ids: Sequence[int]) -> bytes:
        return self.coder.decode_bytes(ids)

    # parts of a long text ----------------------------------------------------------------

    def part(self, text: str) -> Part:
        """Encode a text without special tokens."""
        starts = np.array([m.start() for m in self.words.finditer(text)], np.int64)
        ids = np.array(self.coder.encode_ordinary(text), np.int32)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at_byte = np.concatenate([[0], np.cumsum(width)])[starts]
        ends = np.cumsum([len(t) for t in self.coder.decode_tokens_bytes(ids.tolist())], dtype=np.int64)
        return Part(text, starts, np.searchsorted(ends, at_byte, side="right"), ids)

    def _agrees(self, pair: Sequence[int]) -> bool:
        return self._piece(self.bytes_of(pair)) == list(pair)

    def join_word(self, left: Sequence[int], right: Sequence[int], window: int = 8) -> list[int]:
        """The ids of a word from those of its two halves."""
        while True:
            head, tail = left[max(0, len(left) - window):], right[:window]
            middle = self._piece(self.bytes_of([*head, *tail]))
            whole_left, whole_right = window >= len(left), window >= len(right)
            if (whole_left or self._agrees([left[-window - 1], middle[0]])) and (
                    whole_right or self._agrees([middle[-1], right[window]])):
                return [*left[:len(left) - len(head)], *middle, *right[len(tail):]]
            window *= 2

    def join(self, a: Part, b: Part) -> Part:
        """The encoding of ``a.text + b.text``."""
        if not a.text or not b.text:
            return a if a.text else b
        size = len(a.text)
        sure = max(0, int(np.searchsorted(a.starts, size - _MARGIN, side="right")) - 1)
        begin, known, reach = int(a.starts[sure]), set(b.starts.tolist()), 64
        while True:
            whole = reach >= len(b.text)
            window = a.text[begin:] + b.text[:reach]
            spans = [(m.start() + begin, m.end() + begin) for m in self.words.finditer(window)]
            last = begin + len(window) - (0 if whole else _MARGIN)
            stop = next((s for s, _ in spans if size <= s <= last and s - size in known), None)
            if stop is None and whole:
                stop = size + len(b.text)
            if stop is not None:
                break
            reach *= 2
        middle = [(s, e) for s, e in spans if s < stop]
        rest = int(np.searchsorted(b.starts, stop - size))
        first, ids = [], []
        for s, e in middle:
            first.append(len(ids))
            ids += self._across(a, b, s, e, size)
        kept = int(a.first[sure])
        from_b = int(b.first[rest]) if rest < len(b.first) else len(b.ids)
        shift = kept + len(ids)
        return Part(
            a.text + b.text,
            np.concatenate([a.starts[:sure], np.array([s for s, _ in middle], np.int64), b.starts[rest:] + size]),
            np.concatenate([a.first[:sure], np.array(first, np.int64) + kept, b.first[rest:] - from_b + shift]),
            np.concatenate([a.ids[:kept], np.array(ids, np.int32), b.ids[from_b:]]),
        )

    def _across(self, a: Part, b: Part, s: int, e: int, size: int) -> list[int]:
        text = a.text[s:e] + b.text[max(0, s - size):max(0, e - size)]
        i, j = int(np.searchsorted(a.starts, s)), int(np.searchsorted(b.starts, e - size))
        halves = (  # the word is the left part's last one and the right part's first one
            s < size < e and i == len(a.starts) - 1 and a.starts[i] == s
            and j == 1 and (len(b.starts) == 1 and e - size == len(b.text) or len(b.starts) > 1 and b.starts[1] == e - size)
        )
        if e - s <= _LONG_WORD or not halves:
            return self.word(text)
        stop = int(b.first[1]) if len(b.first) > 1 else len(b.ids)
        return self.join_word(a.ids[int(a.first[i]):].tolist(), b.ids[:stop].tolist())

    def join_all(self, parts: Sequence[Part]) -> Part:
        """Join neighbours two and two until one part is left."""
        parts = list(parts)
        while len(parts) > 1:
            parts = [self.join(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def cuts(self, text: str, chars: int) -> Iterator[tuple[int, int, int, str]]:
        """(segment, part, special id or -1, text): special tokens end a segment."""
        segment = at = 0
        for found in [*self.cut.finditer(text), None]:
            end = found.start() if found else len(text)
            for part, begin in enumerate(range(at, end, chars)):
                yield segment, part, -1, text[begin:min(begin + chars, end)]
            if found:
                yield segment + 1, 0, self.special[found.group()], ""
                segment, at = segment + 2, found.end()


def _worker(spec: str):
    """A tokenizer made once in a Python worker for each file."""
    key = "bpe " + hashlib.sha256(spec.encode()).hexdigest()
    return lambda: once(key, lambda: Tokenizer(spec))


_WANTED = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded": "string",
           "decoded_sha256": "string"}


def encode_documents(
    docs: DataFrame,
    tokenizer_path: str,
    output: Sequence[str] = ("n_tokens", "ids"),
    split_chars: int = 65_536,
) -> DataFrame:
    """(doc_id, *output) for every row of ``docs``; texts are whole, null counts as empty.

    ``output`` names any of n_tokens, ids, ids_sha256 (of the decimal ids joined by
    commas), decoded and decoded_sha256 (of the decoded text in UTF-8).  Texts above
    ``split_chars`` characters, each distinct one once, are encoded in parts of half that
    size on any task; the join needs one text and its ids in memory.  Repeated rows and
    null doc_ids keep their rows.  An empty table gives no rows; other columns are not read.
    ``tokenizer_path`` is read on the driver, so that executors need no such file.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        get = _worker(file.read())
    wanted = list(output)

    def row(ids: Sequence[int]) -> list:
        t, out = get(), []
        text = t.decode(ids) if any(w.startswith("decoded") for w in wanted) else ""
        for w in wanted:
            out.append({
                "n_tokens": lambda: len(ids), "ids": lambda: np.asarray(ids, np.int32), "decoded": lambda: text,
                "ids_sha256": lambda: hashlib.sha256(t.ids_text(ids).encode()).hexdigest(),
                "decoded_sha256": lambda: hashlib.sha256(text.encode()).hexdigest(),
            }[w]())
        return out

    def short(ids: list, texts: list) -> list:
        return [ids, *zip(*[row(get().encode(text or "")) for text in texts])]

    def cut(keys: list, texts: list) -> list:
        return list(zip(*[(key, *c) for key, text in zip(keys, texts) for c in get().cuts(text, max(1, split_chars // 2))]))

    def code(keys: list, segments: list, places: list, specials: list, texts: list) -> list:
        parts = [get().part(t) for t in texts]
        return [keys, segments, places, specials, texts, [p.starts.tobytes() for p in parts],
                [p.first.tobytes() for p in parts], [p.ids.tobytes() for p in parts]]

    def join(group: pd.DataFrame) -> pd.DataFrame:
        ids: list[int] = []
        for _, segment in group.sort_values(["segment", "part"]).groupby("segment"):
            if segment["special"].iloc[0] >= 0:
                ids.append(int(segment["special"].iloc[0]))
                continue
            ids += get().join_all([
                Part(r.text, np.frombuffer(r.starts, np.int64), np.frombuffer(r.first, np.int64),
                     np.frombuffer(r.ids, np.int32)) for r in segment.itertuples()]).ids.tolist()
        return pd.DataFrame([[group["key"].iloc[0], *row(ids)]], columns=["key", *wanted])

    plain = docs.select(F.col("doc_id").cast("bigint"), "text")
    columns = ", ".join(f"{w} {_WANTED[w]}" for w in wanted)
    is_long = F.coalesce(F.length("text"), F.lit(0)) > split_chars
    few = map_rows(plain.filter(~is_long), short, f"doc_id bigint, {columns}", 128)
    keyed = plain.filter(is_long).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    parts = map_rows(keyed.select("key", "text").dropDuplicates(["key"]), cut, _PARTS, 1)
    coded = map_rows(parts.repartition("key", "segment", "part"), code, _CODED, 8)
    joined = coded.groupBy("key").applyInPandas(join, f"key string, {columns}")
    return few.unionByName(keyed.select("doc_id", "key").join(joined, "key").drop("key"))
