"""Base rules against versions without patterns, long texts, and how many disguises are found."""

import random
import time

import pytest

from runledger.llm import pii, secret_ledger

DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
WORD = DIGITS + LETTERS + LETTERS.upper()


def run_of(text, i, chars):
    while i < len(text) and text[i] in chars:
        i += 1
    return i


def email_at(text, i):
    j = run_of(text, i, WORD + "._%+-")
    if j == i or text[j:j + 1] != "@":
        return None
    k = run_of(text, j + 1, WORD + "-")
    parts, end = 0, k
    while k > j + 1 and text[end:end + 1] == ".":
        more = run_of(text, end + 1, WORD + "-")
        if more == end + 1:
            break
        parts, end = parts + 1, more
    return end if parts else None


def ip_at(text, i):
    j = run_of(text, i, DIGITS)
    if j == i:
        return None
    for _ in range(3):
        if text[j:j + 1] != ".":
            return None
        k = run_of(text, j + 1, DIGITS)
        if k == j + 1:
            return None
        j = k
    return j


def card_at(text, i):
    if text[i] not in DIGITS:
        return None
    end = j = i + 1
    while j < len(text):
        if text[j] in DIGITS:
            end = j = j + 1
        elif text[j] in " -" and j + 1 < len(text) and text[j + 1] in DIGITS:
            end = j = j + 2
        else:
            break
    return end if end > i + 1 else None


def phone_at(text, i):
    if text[i] != "+" or text[i + 1:i + 2] == "" or text[i + 1] not in DIGITS:
        return None
    j = run_of(text, i + 2, " ().-" + DIGITS)
    while j > i + 3 and text[j - 1] not in DIGITS:
        j -= 1
    return j if j > i + 3 and text[j - 1] in DIGITS else None


def luhn(digits):
    total = 0
    for i, d in enumerate(digits[::-1]):
        d = int(d) * (2 if i % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def digits_of(text):
    return "".join(c for c in text if c in DIGITS)


HOLDS = {
    "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
    "card": lambda m: 16 <= len(digits_of(m)) <= 19 and luhn(digits_of(m)), "phone": lambda m: 8 <= len(digits_of(m)) <= 15,
}


def assign_at(text, i):
    low = text.lower()
    for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
        if not low.startswith(word, i):
            continue
        j = i + len(word)
        j += text[j:j + 1] in ("'", '"')
        j = run_of(text, j, " ")
        if text[j:j + 1] not in (":", "="):
            continue
        j = run_of(text, j + 1, " ")
        j += text[j:j + 1] in ("'", '"')
        k = run_of(text, j, WORD + "+/_.=-")
        if k > j:
            return k
    return None


def value_of(match):
    at = min(i for i, c in enumerate(match) if c in ":=")
    return match[at + 1:].lstrip(" ")[match[at + 1:].lstrip(" ")[:1] in ("'", '"'):]


def access_at(text, i):
    j = run_of(text, i + 4, DIGITS + LETTERS.upper())
    return j if text.startswith("AKIA", i) and j > i + 4 else None


def hex_at(text, i):
    j = run_of(text, i, DIGITS + "abcdef")
    return j if j > i else None


def leftmost(text, match, holds):
    i = 0
    while i < len(text):
        end = match(text, i)
        if end is None:
            i += 1
        else:
            if holds(text[i:end]):
                yield i, end
            i = end


def random_text(rng, pieces):
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(60)))


def test_personal_data_without_patterns():
    rng = random.Random(6)
    pieces = ["a", "B9", "@", "@", ".", ".", "-", "+", "+4", "1", "25", "256", "10.0.0", "é", " ", "(", ")", "%", "4111 1111", "1111", "1111-",
              "x@y.z", "\n", "$"]
    found = 0
    for _ in range(3000):
        text = random_text(rng, pieces)
        want = [(kind, *span) for kind, match in (("email", email_at), ("ip", ip_at), ("card", card_at), ("phone", phone_at))
                for span in leftmost(text, match, HOLDS[kind])]
        assert pii.base_spans(text) == want, text
        found += len(want)
    assert found > 1000


def test_secrets_without_patterns():
    rng = random.Random(7)
    pieces = ["password", "PassWd", "secret", "token", "api_key", "apikey", "API", "_key", "'", '"', " ", ":", "=", "abc", "12345678", "AKIA",
              "ABCDEFGH", "Z9", "deadbeef" * 3, "0f", "/", "-", ".", "é", "ſecret"]
    found = 0
    for _ in range(3000):
        text = random_text(rng, pieces)
        want = [("assign", *s) for s in leftmost(text, assign_at, lambda m: len(value_of(m)) >= 8)]
        want += [("access", *s) for s in leftmost(text, access_at, lambda m: len(m) >= 16)]
        want += [("hex", *s) for s in leftmost(text, hex_at, lambda m: len(m) >= 32)]
        got = [f for f in secret_ledger.find_secrets(text) if f[0] in secret_ledger.BASE]
        assert got == sorted(want, key=lambda f: (f[1], secret_ledger.BASE.index(f[0]))), text
        found += len(want)
    assert found > 1000


UNITS = ["a", "1", "a.", "1.", "eyJ", "eyJeyJab.", " ", "\n", "(", "[at", "+1", "1 ", "at ", "dot ", "a dot ", "a at ", "one ", "-----BEGIN ",
         "-----BEGIN PRIVATE KEY-----", "-----END ", "AKIA", "token ", "x@", "a@b", "@", "A"]


@pytest.mark.parametrize("unit", UNITS)
def test_a_megabyte_takes_little_time(unit):
    for more in ("", "@", " dot ", " at ", " (", "@ dot (at) at .com"):
        text = unit * (1_000_000 // len(unit)) + more
        started = time.time()
        pii.find_pii(text)
        one = time.time()
        secret_ledger.find_secrets(text)
        # well above what such a text takes, far below what a square of its length would
        assert one - started < 8 and time.time() - one < 2, more


def disguises(rng):
    """(kind, disguised text) of made-up identifiers."""
    name = "".join(rng.choices(LETTERS, k=rng.randrange(3, 9)))
    host = "".join(rng.choices(LETTERS, k=rng.randrange(3, 9)))
    end = rng.choice(["com", "org", "de", "net"])
    spoken = dict(zip(DIGITS, "zero one two three four five six seven eight nine".split()))
    number = "".join(rng.choices(DIGITS[1:], k=10))
    card = "4" + "".join(rng.choices(DIGITS, k=14))
    card += next(d for d in DIGITS if luhn(card + d))
    ip = [str(rng.randrange(1, 256)) for _ in range(4)]
    wide = {ord(d): chr(0xFF10 + int(d)) for d in DIGITS}
    return [
        ("email", f"{name} at {host} dot {end}"), ("email", f"{name} [at] {host} [dot] {end}"), ("email", f"{name}(at){host}.{end}"),
        ("email", f"{name} @ {host} dot {end}".replace(" @ ", " {at} ")), ("email", f"{name}.{name} at {host} dot {host} dot {end}"),
        ("email", f"{name}@{host}.{end}".replace("o", "о").replace("e", "е").replace("a", "а") + ""),
        ("ip", " dot ".join(ip)), ("ip", "[.]".join(ip)), ("ip", ".".join(ip).translate(wide)),
        ("ip", " dot ".join(" ".join(spoken[d] for d in part) for part in ip)),
        ("phone", "plus " + " ".join(spoken[d] for d in "49" + number)), ("phone", "+49 " + number.translate(wide)),
        ("card", card.translate(wide)), ("card", " ".join(spoken[d] for d in card)), ("card", "​".join(card)),
    ]


def test_recall_of_planted_disguises():
    rng = random.Random(12)
    right = total = 0
    for _ in range(200):
        for kind, said in disguises(rng):
            before = "Please ask: "
            text = f"{before}{said} - and thank you."
            spans = pii.find_pii(text)[1]
            right += (kind, len(before), len(before) + len(said)) in spans
            total += 1
    print(f"recall {right / total:.3f} of {total}")
    assert right / total >= 0.9
