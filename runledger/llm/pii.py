"""Personal data, also where it is disguised, with spans in the source text.

A chain of transducers rewrites the text: look-alike letters and digits, spelled digits,
and disguised @ and dot.  Each keeps, for every character it writes, the source
characters it stands for.  Identifiers are detected in the source (the base rules) and
again in the rewritten text; what is found there only thanks to a rewrite is mapped back
to source characters and added.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND = "array<struct<kind:string,start:bigint,end:bigint>>"
KINDS = ("email", "ip", "card", "phone")

# The base rules.  All patterns take time in proportion to the text: a run is
# tried from its first character only, since what follows it is the same from every other.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _is_ip(match: str) -> bool:
    parts = [p.lstrip("0") for p in match.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(match: str) -> bool:
    digits = _NO_DIGIT.sub("", match)
    return 16 <= len(digits) <= 19 and _luhn(digits)


def _is_phone(match: str) -> bool:
    return 8 <= len(_NO_DIGIT.sub("", match)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, read outwards from each @."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        name = len(before) - len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if name else None
        if domain:
            yield at - name, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def _spans(pattern: re.Pattern, holds: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text) if holds(m[0]))


_RULES = (  # kind, a character without which nothing matches, the spans in a text
    ("email", "@", _emails), ("ip", ".", _spans(_IP, _is_ip)),
    ("card", "", _spans(_CARD, _is_card)), ("phone", "+", _spans(_PHONE, _is_phone)),
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by kind, then start."""
    return [(kind, *span) for kind, needs, spans in _RULES if needs in text for span in spans(text)]


class Rewritten(NamedTuple):
    """A rewritten text; character i stands for source[begin[i]:end[i]]; changed[i] tells
    whether a rewrite made it."""
    text: str
    begin: list[int]
    end: list[int]
    changed: list[bool]


def _source(text: str) -> Rewritten:
    places = range(len(text))
    return Rewritten(text, list(places), [i + 1 for i in places], [False] * len(text))


def _replace(now: Rewritten, edits: Iterable[tuple[int, int, str]]) -> Rewritten:
    """Apply edits (start, end, new text), which are in order and don't overlap."""
    out, begin, end, changed, at = [], [], [], [], 0
    for s, e, new in edits:
        for target, of in zip((begin, end, changed), now[1:]):
            target += of[at:s]
        out += [now.text[at:s], new]
        begin += [now.begin[s]] * len(new)
        end += [now.end[e - 1]] * len(new)
        changed += [True] * len(new)
        at = e
    for target, of in zip((begin, end, changed), now[1:]):
        target += of[at:]
    return Rewritten("".join([*out, now.text[at:]]), begin, end, changed)


def _rewrite(now: Rewritten, pattern: re.Pattern, to: Callable[[re.Match], str]) -> Rewritten:
    made = ((m.start(), m.end(), to(m), m[0]) for m in pattern.finditer(now.text))
    return _replace(now, ((s, e, new) for s, e, new, old in made if new != old))


# Letters that look like a Latin one, by script, in the order of the Latin letters.
_LIKE = dict(zip(
    "авсԁеһіјӏкмопԛгѕтѵԝхуАВСЕНІЈКМОРԚЅТѴԜХУ" "αβεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ıɑɡ",
    "abcdehijlkmonqrstvwxyABCEHIJKMOPQSTVWXY" "abeiknoptuxABEZHIKMNOPTYX" "iag", strict=True))
_LIKE |= {"р": "p", "ь": "b", "Ь": "b"}
_HIDDEN = "­​‌‍⁠﻿"
_FORMS = "！-～⁰-ₜ①-⓪\U0001d400-\U0001d7ff٠-٩۰-۹०-९"
_GLYPH = re.compile(f"[{''.join(_LIKE)}{_FORMS}{_HIDDEN}]")

_DIGIT_OF = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_WORD = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_ITEM = re.compile(rf"(?<!\w)(?:(plus)|({_WORD})|[0-9]+)(?!\w)", re.I)
_GAP = re.compile(r"[\s,-]{0,3}")
_SPLIT = str.maketrans(dict.fromkeys("-,.()[]{}<>", " "))

_DOTS = ("dot", "punkt", "point", "punto")
_AT_WORDS = ("at", "arroba")
_DOT_WORD, _AT_WORD = f"(?:{'|'.join(_DOTS)})", f"(?:{'|'.join(_AT_WORDS)})"
_OPEN, _CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
# What may stand between spelled digits as well: a dot, or round brackets.
_GAP_DOT = re.compile(rf"\s+{_DOT_WORD}\s+|\s*{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}\s*|\.", re.I)
_GAP_BRACKET = re.compile(r"[\s,-]{0,3}[()]{1,2}[\s,-]{0,3}")
_NO_BRACKET = re.compile(r"[^()]")
_AT = re.compile(rf"[\[({{<]\s*+(?:{_AT_WORD}|@)\s*+[\])}}>]", re.I)
_DOT = re.compile(rf"[\[({{<]\s*+(?:{_DOT_WORD}|\.)\s*+[\])}}>]|(?<=[0-9])\s++{_DOT_WORD}\s++(?=[0-9])", re.I)
# Without brackets the words are taken for signs only in a whole address with a usual end, its
# parts no longer than addresses allow: 64 characters before the sign, 63 in a label.
_ENDS = "com|org|net|edu|gov|info|biz|io|dev|ai|co|uk|de|fr|es|it|eu|ch|at|nl|us"
_NAME_PART, _MOST_NAME, _MOST_PARTS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-", 64, 10
_LABEL = r"[A-Za-z0-9-]{1,63}+"
_SAID_AT = re.compile(rf"(?<=\s){_AT_WORD}(?=\s)", re.I)
_SAID_DOT = re.compile(rf"\s++{_DOT_WORD}\s++", re.I)
_DOT_BEFORE = re.compile(rf"\s{{1,8}}{_DOT_WORD}\s{{1,8}}$", re.I)
_HOST = re.compile(
    rf"{_LABEL}(?:(?:\.|\s++{_DOT_WORD}\s++){_LABEL}){{0,{_MOST_PARTS}}}?\s++{_DOT_WORD}\s++(?:{_ENDS})(?!\w)", re.I)

# "name at example.com": an end like It starts a sentence; a whole address unless the word before is one that leads to a place.
_PLAIN_HOST = re.compile(
    rf"{_LABEL}(?:(?:\.|\s++{_DOT_WORD}\s++){_LABEL}){{0,{_MOST_PARTS}}}?\.(?-i:{_ENDS}|{_ENDS.upper()})(?![\w/:@-]|\.\w)", re.I)
_IN_NAME = re.compile(r"[\w.%+@-]")
_LEADS = frozenset(
    "a about all and are article available be blog book books buy call check code contact data details docs "
    "documentation download email file files find follow found free go he help here him his home hosted i in info "
    "information is it join listed live located look mail me more news now on online open or order out page people "
    "post posted published read register released see she shop sign site sold source store story team text that "
    "the them there these they this today up us version video visit was we web website were work working works you".split())


def _name_before(text: str, end: int, floor: int) -> int | None:
    """Where a name that ends at ``end`` begins: parts between dots or dot words."""
    start = None
    for _ in range(_MOST_PARTS):
        low = max(floor, end - _MOST_NAME - 1)
        part = text[low:end]
        size = len(part) - len(part.rstrip(_NAME_PART))
        if not 0 < size <= _MOST_NAME:
            break
        start = end - size
        word = _DOT_BEFORE.search(text, max(floor, start - 24), start)
        if start > floor and text[start - 1] == ".":
            end = start - 1
        elif word:
            end = word.start()
        else:
            break
    return start


def _addresses(text: str, host: re.Pattern) -> Iterator[tuple[int, int, int, int]]:
    """(start of the name, its end, start of the host, its end) of "name at host"."""
    floor = 0
    for at in _SAID_AT.finditer(text):
        if at.start() < floor:
            continue
        stop = at.start()
        while stop > floor and text[stop - 1].isspace():
            stop -= 1
        first = at.end()
        while first < len(text) and text[first].isspace():
            first += 1
        found = host.match(text, first)
        start = _name_before(text, stop, floor) if found else None
        if start is not None:
            yield start, stop, first, found.end()
            floor = found.end()


def _signs(text: str, found: Iterable[tuple[int, int, int, int]]) -> list[tuple[int, int, str]]:
    edits = []
    for start, stop, first, end in found:
        edits += [(*d.span(), ".") for d in _SAID_DOT.finditer(text, start, stop)]
        edits.append((stop, first, "@"))
        edits += [(*d.span(), ".") for d in _SAID_DOT.finditer(text, first, end)]
    return edits


def _said(now: Rewritten) -> Rewritten:
    """Write "name at host dot com" with signs."""
    edits = _signs(now.text, _addresses(now.text, _HOST))
    return _replace(now, edits) if edits else now


def _said_plain(now: Rewritten) -> Rewritten:
    """Write "name at example.com" with signs."""
    text = now.text
    edits = _signs(text, (
        a for a in _addresses(text, _PLAIN_HOST)
        if text[a[0]:a[1]].lower() not in _LEADS and not (a[0] and _IN_NAME.match(text[a[0] - 1]))))
    return _replace(now, edits) if edits else now


def _bracketed(now: Rewritten, pattern: re.Pattern, sign: str) -> Rewritten:
    """Write a sign for what ``pattern`` finds, and the blanks on both sides."""
    text, floor, edits = now.text, 0, []
    for m in pattern.finditer(text):
        start, end = m.span()
        while start > floor and text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        edits.append((start, end, sign))
        floor = end
    return _replace(now, edits) if edits else now


def _glyph(m: re.Match) -> str:
    char = m[0]
    if char in _HIDDEN:
        return ""
    plain = _LIKE.get(char) or unicodedata.normalize("NFKC", char)
    if plain.isdecimal() and not plain.isascii():
        plain = str(unicodedata.decimal(plain))
    return plain if plain.isascii() else char


def _between(text: str, start: int, end: int) -> str | None:
    """What to write between two items of a run, or None if the run ends there."""
    if _GAP.fullmatch(text, start, end):
        return ""
    if _GAP_DOT.fullmatch(text, start, end):
        return "."
    return _NO_BRACKET.sub("", text[start:end]) if _GAP_BRACKET.fullmatch(text, start, end) else None


def _spell(now: Rewritten) -> Rewritten:
    """Write runs of spelled digits, single figures among them, as numbers; dots and
    round brackets between them stay."""
    runs: list[list[re.Match]] = [[]]
    gaps: list[list[str]] = [[]]
    for m in _ITEM.finditer(now.text):
        if runs[-1]:
            gap = None if m[1] else _between(now.text, runs[-1][-1].end(), m.start())
            if gap is None:
                runs.append([])
                gaps.append([])
            else:
                gaps[-1].append(gap)
        runs[-1].append(m)
    new: dict[tuple[int, int], str] = {}
    for run, between in zip(runs, gaps):
        # one spelled digit is enough in a run that may be an address
        if sum(bool(m[2]) for m in run) < (1 if between.count(".") >= 3 else 2):
            continue
        for m, after, gap in zip(run, [*run[1:], None], [*between, ""]):
            if m[1] or m[2]:
                new[m.span()] = "+" if m[1] else str(_DIGIT_OF[m[2].lower()])
            if after and now.text[m.end():after.start()] != gap:
                new[m.end(), after.start()] = gap
    if not new:
        return now
    return _replace(now, ((s, e, new[s, e]) for s, e in sorted(new)))


def rewrite(text: str) -> Rewritten | None:
    """The text without disguises, or None if there are none."""
    glyph = not text.isascii() and _GLYPH.search(text)
    now = _rewrite(_source(text), _GLYPH, _glyph) if glyph else None
    low = (now.text if now else text).lower()  # may differ in length; only asked what it holds
    # a run holds a spelled digit between spaces, commas, hyphens, dots or brackets
    spelled = not _DIGIT_OF.keys().isdisjoint(low.translate(_SPLIT).split())
    bracket = any(c in low for c in "[({<")
    dotted = any(word in low for word in _DOTS)
    plain = "." in low and any(True for _ in _addresses(now.text if now else text, _PLAIN_HOST))
    if not (glyph or spelled or bracket or dotted or plain):
        return None
    now = now or _source(text)
    if spelled:
        now = _spell(now)
    if bracket or dotted:
        now = _bracketed(_bracketed(now, _AT, "@"), _DOT, ".")
    now = _said(now) if dotted else now
    return _said_plain(now) if plain else now


def find_pii(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind, then start."""
    base = base_spans(text)
    now = rewrite(text)
    if now is None:
        return base, base
    more = set()
    for kind, s, e in base_spans(now.text):
        begin, end = now.begin[s], now.end[e - 1]
        if any(now.changed[s:e]) or end - begin != e - s:
            if not any(k == kind and b < end and begin < f for k, b, f in base):
                more.add((kind, begin, end))
    return base, sorted({*base, *more}, key=lambda f: (KINDS.index(f[0]), f[1], f[2]))


def scan_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found) for every row of ``docs`` (doc_id, text): arrays of spans in
    code points, end exclusive, by kind, then start.

    ``base`` holds what the plain rules find, ``found`` that and what is disguised.  Null
    texts count as empty.  Repeated rows and null doc_ids keep their rows; an empty table
    gives none; other columns are not read.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                both = find_pii(text or "")
                rows.append((doc_id, *[[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in both]))
            yield pd.DataFrame(rows, columns=["doc_id", "base", "found"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(
        scan, f"doc_id bigint, base {FOUND}, found {FOUND}")
