"""Personal data replaced by format-preserving pseudonyms from keyed Feistel permutations.

Each kind of value has a finite domain (Luhn-valid numbers of one length, telephone digits, IPv4 addresses, days of
the calendar, letters and digits of an address or key). A keyed Feistel network permutes the domain, by cycle walking
where the domain is no square, so the pseudonym has the value's format, equal values stay equal in all documents, and
the key's holder can invert it. Pseudonyms depend on the value alone: no table of values is gathered.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import hmac
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import need, small_batches, with_text

ROUNDS = 8
#: The key is a parameter of every call and has no default; this public one is for tests and demonstrations only.
DEMO_KEY = "demonstration key"
_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Names of the months in English, Spanish and French, of which no name is in two, then the English names'
#: first letters, then the German names, which some English ones equal: a full stop after the day tells them apart.
MONTHS = (
    ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
    ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
    ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
)
_MONTH = "|".join(name for names in MONTHS[:3] for name in names)
_SHORT, _GERMAN = "|".join(n for n in MONTHS[3] if n != "May"), "|".join(MONTHS[4])

_PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "secret": r"(?<![\w])(?=[A-Za-z]*\d)(?=\d*[A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:sk|pk|ghp|AKIA|xox[bp])[-_]?[A-Za-z0-9]{16,64})(?![\w])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)",
    "worddate": rf"(?<![\w.])(?:(?:{_MONTH}) \d{{1,2}}, \d{{4}}|\d{{1,2}} (?:de )?(?:{_MONTH}) (?:de )?\d{{4}}|(?:{_SHORT})\.? \d{{1,2}}, \d{{4}}|\d{{1,2}} (?:{_SHORT})\.? \d{{4}}|\d{{1,2}}\. (?:{_GERMAN}) \d{{4}})(?!\w)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])|(?<![\w.-])\d{3}\.\d{3}\.\d{4}(?![\w-]|\.\d)"
    # national forms: an area code from 0, five pairs from 0, three threes from 6 to 9
    r"|(?<![\w.+/-])0\d{2,4}[ /-]\d{4,8}(?![\w/-]|[.,]\d)|(?<![\w.+-])(?<!\d )0\d(?:(?: \d{2}){4}|(?:\.\d{2}){4})(?![\w-]| \d|\.\d)|(?<![\w.,+-])(?<!\d )[6-9]\d{2} \d{3} \d{3}(?![\w-]| \d|[.,]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "number": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()))
_MAYBE = re.compile(r"[0-9@]").search
_MONTH_NAME, _SHORT_NAME, _GERMAN_NAME = re.compile(_MONTH), re.compile(_SHORT), re.compile(_GERMAN)


class Feistel:
    """Keyed permutation of 0..size-1 for each tweak: a balanced Feistel network over two digits of base ceil(sqrt(size))."""

    def __init__(self, key: str, rounds: int = ROUNDS) -> None:
        self.key, self.rounds = key.encode(), rounds

    def _round(self, tweak: bytes, k: int, x: int, base: int) -> int:
        size = (base.bit_length() + 7) // 8 + 8  # a few bytes more than the base has, so that all values are near equally likely
        out = b""
        while len(out) < size:
            out += hmac.new(self.key, b"%s|%d|%d|%d" % (tweak, k, x, len(out)), hashlib.sha256).digest()
        return int.from_bytes(out[:size], "big") % base

    def _once(self, tweak: bytes, x: int, base: int, back: bool) -> int:
        left, right = divmod(x, base)
        for k in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                left, right = (right - self._round(tweak, k, left, base)) % base, left
            else:
                left, right = right, (left + self._round(tweak, k, right, base)) % base
        return left * base + right

    def permute(self, tweak: str, x: int, size: int, back: bool = False) -> int:
        """Image of ``x``; walks the cycle until it is back in the domain, on average less than twice."""
        if size < 2:
            return x
        base = math.isqrt(size - 1) + 1
        y = self._once(tweak.encode(), x, base, back)
        while y >= size:
            y = self._once(tweak.encode(), y, base, back)
        return y


def luhn_digit(digits: str) -> str:
    """Check digit that makes ``digits`` plus it Luhn-valid."""
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(digits)))
    return str(-total % 10)


def luhn_valid(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def iban_check(country: str, body: str) -> str:
    """Two check digits by the remainder modulo 97."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


@lru_cache(maxsize=4)
def _days(late: bool, short: bool) -> list[int] | range:
    """Days of the calendar: after a month's twelfth, if ``late``; with a day or month under 10, if ``short``."""
    if not (late or short):
        return range(_FIRST_DAY, _LAST_DAY + 1)
    dates = ((d, dt.date.fromordinal(d)) for d in range(_FIRST_DAY, _LAST_DAY + 1))
    return [d for d, x in dates if (not late or x.day > 12) and (not short or min(x.day, x.month) < 10)]


@lru_cache(maxsize=1)
def _outside_may() -> list[int]:
    return [d for d in range(_FIRST_DAY, _LAST_DAY + 1) if dt.date.fromordinal(d).month != 5]


def _valid_ssn(own: str) -> bool:
    return own[:3] not in ("000", "666") and own[0] != "9" and own[3:5] != "00" and own[5:] != "0000"


def _refill(shape: str, fresh: str) -> str:
    """``shape`` with its letters and digits replaced, in order, by those of ``fresh``."""
    it = iter(fresh)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in shape)


class Pseudonyms:
    """Pseudonyms of the values of one key."""

    def __init__(self, key: str, rounds: int = ROUNDS) -> None:
        self.feistel = Feistel(key, rounds)
        self.kept: dict[tuple[str, str], str] = {}

    def digits(self, kind: str, text: str, back: bool = False) -> str:
        return f"{self.feistel.permute(f'{kind}{len(text)}', int(text), 10 ** len(text), back):0{len(text)}d}" if text else ""

    def mixed(self, kind: str, text: str, back: bool = False) -> str:
        """Each letter stays a letter of its case and each digit a digit; the rest stays."""
        alphabets = [_DIGITS if c in _DIGITS else _LETTERS if c in _LETTERS else _LETTERS.upper() if c in _LETTERS.upper() else c for c in text]
        shape = "".join("9" if a == _DIGITS else "a" if a == _LETTERS else "A" if len(a) > 1 else a for a in alphabets)
        size, x = 1, 0
        for a, c in zip(alphabets, text, strict=True):
            x, size = x * len(a) + a.index(c), size * len(a)
        x = self.feistel.permute(f"{kind}|{shape}", x, size, back)
        out = []
        for a in reversed(alphabets):
            x, k = divmod(x, len(a))
            out.append(a[k])
        return "".join(reversed(out))

    def _hex(self, text: str, back: bool) -> str:
        x = self.feistel.permute(f"hex{len(text)}", int(text, 16), 16 ** len(text), back)
        return f"{x:0{len(text)}x}" if text == text.lower() else f"{x:0{len(text)}X}"

    def _date(self, text: str, back: bool) -> str | None:
        """Another day in the same form; a day that doesn't exist, or is out of the calendar's range, is none."""
        sep = next(c for c in text if not c.isdigit())
        first, second, third = (int(x) for x in text.split(sep))
        year_first = text.index(sep) == 4
        if year_first:
            orders = [(first, second, third, 0)]
        else:  # month first, if not day first: days over 12, so it stays plain that it is
            orders = [(third, second, first, 0), (third, first, second, 1)]
        short = len(text) < 10  # no leading zeros: days or months under 10, so it stays plain that they are left out
        for year, month, own, late in orders:
            try:
                day = dt.date(year, month, own).toordinal()
            except ValueError:
                continue
            days = _days(bool(late), short)
            at = bisect.bisect_left(days, day)
            if not _FIRST_DAY <= day <= _LAST_DAY or at == len(days) or days[at] != day or short and re.search(rf"(?:^|{re.escape(sep)})0", text):
                return None
            new = dt.date.fromordinal(days[self.feistel.permute(f"date{late}" + "short" * short, at, len(days), back)])
            if year_first:
                return f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}"
            a, b = (new.month, new.day) if late else (new.day, new.month)
            return f"{a}{sep}{b}{sep}{new.year:04d}" if short else f"{a:02d}{sep}{b:02d}{sep}{new.year:04d}"
        return None

    def _word_date(self, text: str, back: bool) -> str | None:
        """A date with its month in words, in the same language and order."""
        if re.match(r"\d+\.", text):
            name, names = _GERMAN_NAME.search(text).group(), MONTHS[4]
        elif found := _MONTH_NAME.search(text):
            name = found.group()
            names = next(x for x in MONTHS if name in x)
        else:
            name, names = _SHORT_NAME.search(text).group(), MONTHS[3]
        first, year = re.findall(r"\d+", text)
        try:
            day = dt.date(int(year), names.index(name) + 1, int(first)).toordinal()
        except ValueError:
            return None
        if not _FIRST_DAY <= day <= _LAST_DAY or first.startswith("0"):
            return None
        days = _outside_may() if names is MONTHS[3] else range(_FIRST_DAY, _LAST_DAY + 1)  # May is the long name, too
        fresh = dt.date.fromordinal(days[self.feistel.permute("worddate" if len(days) > 70_000 else "short worddate", bisect.bisect_left(days, day), len(days), back)])
        numbers = iter((str(fresh.day), f"{fresh.year:04d}"))
        return re.sub(r"\d+", lambda _: next(numbers), text.replace(name, names[fresh.month - 1]))

    def _ssn(self, own: str, back: bool) -> str:
        """Valid numbers (no area 000, 666 or over 899, no group 00, no serial 0000) stay valid, others stay invalid."""
        area, group, serial = int(own[:3]), int(own[3:5]), int(own[5:])
        if _valid_ssn(own):
            x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
            x = self.feistel.permute("ssn", x, 898 * 99 * 9999, back)
            x, serial = divmod(x, 9999)
            area, group = divmod(x, 99)
            return f"{area + 1 + (area >= 665):03d}{group + 1:02d}{serial + 1:04d}"
        while True:
            own = self.digits("ssn", own, back)
            if not _valid_ssn(own):
                return own

    def value(self, kind: str, text: str, back: bool = False) -> str | None:
        """Pseudonym of one value, or None if it fails its kind's validation. ``back`` inverts it."""
        if kind == "email":
            name, _, domain = text.partition("@")
            return f"{self.mixed('email', name, back)}@{domain}"
        if kind == "secret":
            return self._hex(text, back) if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) else self.mixed("secret", text, back)
        if kind == "ip":
            parts = [int(x) for x in text.split(".")]
            x = self.feistel.permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32, back)
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind in ("date", "worddate"):
            return self._date(text, back) if kind == "date" else self._word_date(text, back)
        own = re.sub(r"[^A-Za-z0-9]", "", text)
        if kind == "iban":
            if not 15 <= len(own) <= 34 or iban_check(own[:2], own[4:]) != own[2:4]:
                return None
            body = self.mixed("iban" + own[:2], own[4:], back)
            return _refill(text, own[:2] + iban_check(own[:2], body) + body)
        if kind == "phone":
            code = re.match(r"\+(\d{1,3})[ .(-]", text)
            keep = code.group(1) if code else own[:1] if own[0] == "0" or re.fullmatch(r"[6-9]\d\d \d{3} \d{3}", text) else ""  # the country stays, or what begins a national form
            return _refill(text, keep + self.digits("phone", own[len(keep) :], back))
        if kind == "ssn":
            return _refill(text, self._ssn(own, back))
        if kind == "number" and luhn_valid(own):
            body = self.digits("luhn", own[:-1], back)
            return _refill(text, body + luhn_digit(body))
        while True:  # not a payment card: an account number without a check digit keeps its own domain
            own = self.digits("account", own, back)
            if not luhn_valid(own):
                return _refill(text, own)

    def _known(self, kind: str, text: str) -> str | None:
        found = self.kept.get((kind, text))
        if found is None:
            found = self.value(kind, text)
            if found is None:
                return None
            if len(self.kept) > 30_000:
                self.kept.clear()
            self.kept[(kind, text)] = found
        return found

    def replace(self, text: str | None) -> tuple[str | None, int, list[tuple[str, int, int]]]:
        """(text with pseudonyms, their number, [(kind, start, end)] in the new text) of a whole text."""
        if not text or not _MAYBE(text):
            return text, 0, []
        out, spans, at, size = [], [], 0, 0
        for m in _FIND.finditer(text):
            fresh = self._known(m.lastgroup, m.group())
            if fresh is None:
                continue
            out += [text[at : m.start()], fresh]
            size += m.start() - at
            spans.append((m.lastgroup, size, size + len(fresh)))
            size += len(fresh)
            at = m.end()
        if not spans:
            return text, 0, []
        return "".join([*out, text[at:]]), len(spans), spans


def pseudonyms_of(spark: SparkSession, key: str):
    """Function of a whole text's column: struct(text, n_values, spans)."""
    small_batches(spark)

    @F.pandas_udf("text string, n_values int, spans array<struct<kind:string,start:int,end:int>>")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Pseudonyms(key)  # what it keeps goes with the task
        for texts in batches:
            rows = [own.replace(t) for t in texts]
            yield pd.DataFrame({"text": [r[0] for r in rows], "n_values": [r[1] for r in rows], "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in r[2]] for r in rows]})

    return mask


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_values, spans) per row of ``docs``. A null text stays null; a text of any length is read whole;
    repeated rows stay repeated; extra columns are left behind; an empty table gives an empty result.

    Dates that don't exist, IBANs with wrong check digits, names, addresses and the domains of e-mail addresses stay.
    """
    mask = pseudonyms_of(docs.sparkSession, key)
    found = need(docs, id_col, text_col).toDF("id", "text").select("id", mask(F.col("text").cast("string")).alias("p"))
    return found.select(F.col("id").alias(id_col), F.col("p.text").alias(text_col), "p.n_values", "p.spans")


def with_pseudonyms(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with its text pseudonymised; all other columns stay, whatever their names."""
    return with_text(docs, text_col, pseudonyms_of(docs.sparkSession, key))
