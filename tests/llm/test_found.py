"""Identifiers that no rule knows, found by their contexts in a table where they are planted."""

import random
import time

import pytest

from copyloom.llm import pii

LEAD = {"email": ("mail to", "write to", "contact address"), "ip": ("from host", "client ip", "logged in from"), "card": ("card number", "paid with"), "phone": ("call me at", "mobile")}
#: Words that numbers and names follow which are nobody's.
OTHER = ("order", "page", "in the year", "model", "version", "room")


def luhn(digits):
    total = sum(x if k % 2 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(digits))))
    return digits + str(-total % 10)


def known(rng, kind):
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    return {"email": f"u{n(6)}@mail{n(2)}.example.com", "ip": ".".join(str(rng.randrange(256)) for _ in range(4)), "card": luhn("4" + n(14)), "phone": f"+1 ({n(3)}) 555-{n(4)}"}[kind]


def unknown(rng, kind):
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    return rng.choice({
        "email": [f"u{n(6)}@intranet", f"u{n(5)}#corp.example", f"u{n(6)} at mail{n(2)} dot org", f"u{n(6)}(at)mail{n(2)}.org"], "ip": [f"srv-{n(5)}.lan", "fe80:0:0:0:" + ":".join(f"{rng.randrange(65536):x}" for _ in range(4)), f"0x{n(8)}"],
        "card": [f"4{n(3)}/{n(4)}/{n(4)}/{n(4)}", f"xxxx-xxxx-{n(4)}-{n(4)}"], "phone": [f"555-{n(3)}-{n(4)}", f"0{n(9)}", f"ext{n(5)}"],
    }[kind])


@pytest.fixture(scope="module")
def planted(spark):
    rng, rows = random.Random(7), []
    word = lambda: "".join(rng.choices("bcdfgmnprstvaeiou", k=rng.randrange(3, 9)))
    for k in range(4000):
        r = rng.random()
        kind = rng.choice(pii.KINDS)
        lead, what, truth = (rng.choice(LEAD[kind]), known(rng, kind), None) if r < 0.5 else (rng.choice(LEAD[kind]), None, kind) if r < 0.58 else (rng.choice(OTHER), f"{word()}{rng.randrange(10**5, 10**7)}", "")
        what = what or unknown(rng, kind)
        text = f"{' '.join(word() for _ in range(8))} {lead} {what} {' '.join(word() for _ in range(6))}"
        at = text.index(f"{lead} {what} ") + len(lead) + 1
        rows.append((k, text, truth, at, at + len(what)))
    found = pii.find_pii(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    return rows, {r.doc_id: r for r in found}


def test_unseen_forms_are_found(planted):
    rows, found = planted
    hidden = [r for r in rows if r[2]]
    hits = sum(any(pii.KINDS[s.kind] == kind and s.start < end and start < s.end for s in found[k].added) for k, _, kind, start, end in hidden)
    added = sum(len(r.added) for r in found.values())
    right = sum(any(pii.KINDS[s.kind] == kind and start <= s.start and s.end <= end for kind, start, end in [rows[k][2:]] if kind) for k, r in found.items() for s in r.added)
    assert len(hidden) > 250 and hits / len(hidden) >= 0.9, hits / len(hidden)
    assert right / added >= 0.95, right / added


def test_others_are_left_alone_and_base_spans_stay(planted):
    rows, found = planted
    assert not any(found[k].added for k, _, truth, _, _ in rows if truth == "")
    assert all([tuple(s) for s in found[k].base] == pii.base_spans(text) for k, text, *_ in rows)


@pytest.mark.parametrize("word", ["a", "中", "1", "@", "a@", "a1.", "1-", "+1 ", "at ", "(at)", "1.", "dot "])
def test_long_words_take_time_in_proportion(word):
    def took(n):
        text = word * (n // len(word)) + " 1"
        at = time.process_time()
        pii._candidates(text, pii.base_spans(text))
        return time.process_time() - at

    few = min(took(250_000) for _ in range(2))
    assert few < 1 and took(1_000_000) < 6 * max(few, 0.1)


def test_repeated_rows_and_long_words_have_their_spans(spark):
    text = "x" * 300_000 + "7" + " mail a@b.org " + "y" * 300_000
    rows = pii.find_pii(spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")).collect()
    assert [[tuple(s) for s in r.base] for r in rows] == [[(0, 300_007, 300_014)]] * 3
