"""Dates and telephone numbers in more forms: found, inverted, and kept in their form; look-alikes stay."""

from __future__ import annotations

import random
import re

import pytest

from caseflow.llm import pii

FOUND = [
    ("3. Oktober 2021", "worddate"), ("12. April 1999", "worddate"), ("Oct 3, 2021", "worddate"), ("Sep. 30, 2004", "worddate"), ("7 Dec 1988", "worddate"), ("May 3, 2021", "worddate"), ("3 mai 2021", "worddate"),
    ("2021/10/03", "date"), ("2021.10.03", "date"), ("3.10.2021", "date"), ("12/1/1999", "date"), ("3/25/2021", "date"), ("03.10.2021", "date"), ("12/31/1999", "date"), ("2021-10-03", "date"),
    ("030 1234567", "phone"), ("0171/1234567", "phone"), ("089-123456", "phone"), ("06 12 34 56 78", "phone"), ("01.23.45.67.89", "phone"), ("912 345 678", "phone"), ("612 345 678", "phone"), ("212-555-0123", "phone"), ("+49 30 1234567", "phone"),
]
LEFT = ["31. Februar 2021", "Feb 30, 2021", "2021/13/03", "0.10.2021", "31.4.2021", "1 912 345 678", "912 345 678 901", "912 345 678.50", "12 34 56 78", "room 030 12", "version 3.10.20", "0 1234567", "Marc 3, 2021"]


@pytest.mark.parametrize("value,kind", FOUND)
def test_forms_are_found_kept_and_inverted(value, kind):
    p = pii.Pseudonyms("key")
    text, n, spans = p.replace(f"on {value}, they said")
    fresh = text[3 : -len(", they said")]
    assert n == 1 and spans[0][0] == kind and fresh != value
    assert p.value(kind, fresh, back=True) == value
    again = pii.Pseudonyms("key").replace(f"({fresh})")
    assert again[1] == 1 and again[2][0][0] == kind  # still of its kind, so that the holder of the key finds it
    shape = lambda x: re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", x))
    assert shape(fresh) == shape(value)


@pytest.mark.parametrize("text", LEFT)
def test_what_only_looks_alike_stays(text):
    assert pii.Pseudonyms("key").replace(text) == (text, 0, [])


def test_dates_are_permuted_within_their_form():
    p, rng, seen = pii.Pseudonyms("k"), random.Random(1), {}
    for _ in range(3000):
        y, m, d = rng.randrange(1900, 2100), rng.randrange(1, 13), rng.randrange(1, 29)
        for value in (f"{d}.{m}.{y}", f"{d:02d}.{m:02d}.{y}", f"{y}/{m:02d}/{d:02d}", f"{pii.MONTHS[3][m - 1]} {d}, {y}", f"{d}. {pii.MONTHS[4][m - 1]} {y}", f"{m}/{d}/{y}"):
            kind = "date" if value[-1].isdigit() and not re.search(r"[A-Za-z]", value) else "worddate"
            fresh = p.value(kind, value)
            assert p.value(kind, fresh, back=True) == value
            assert seen.setdefault(fresh, value) == value
