"""Which texts can hold a run of words all of whose neighbours are also neighbours in a benchmark: a sieve over many texts at once.

Texts are laid end to end as code points, cut into words by a table of characters, and each word's letters in lower case
are added up to a hash, so no text is taken apart in Python. The sieve only leaves texts out that can't hold such a run;
what it lets pass is looked at word by word.
"""

from __future__ import annotations

import functools
import re
import sys

import numpy as np

from ._common import MARK_BITS

#: Code points that are looked at together; longer texts pass unseen.
PIECE = 1 << 17
#: Stand for any number, and for any name or unit of measure.
NUMBER, SLOT = 1, 2
_LETTER, _DIGIT, _SIGN, _UPPER, _ODD = 1, 2, 3, 4, 8
_BASE, _MIX = 0x9E3779B1, np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE, base, np.uint32)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint32)


_POWERS, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 32))


@functools.cache
def _characters() -> np.ndarray:
    """Of each character: its lower case in 24 bits, and above them its kind; 0 for characters outside of words.

    Odd ones, whose lower case isn't one character or depends on others, and letters that aren't alphabetic (which may
    count as digits), are left to the reading word by word.
    """
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    every = points.tobytes().decode("utf-32-le", "surrogatepass")
    out = np.zeros(len(points), np.uint32)
    for pattern, kind in ((r"[^\W_]", _LETTER), (r"\d", _DIGIT), (r"[%$€£°]", _SIGN)):
        found = [ord(c) for c in re.findall(pattern, every)]
        out[found] = points[found] | kind << 24
    for c in re.findall(r"[^\W\d_]", every):
        low = c.lower()
        if low != c or not c.isalpha():
            odd = len(low) > 1 or c == "Σ" or not c.isalpha()
            out[ord(c)] = ord(low[0]) | (_LETTER | _UPPER * c.isupper() | _ODD * odd) << 24
    return out


def spelled(word: str) -> int:
    """Hash of a word that is in lower case."""
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)[:PIECE]
    return int((points * _POWERS[: len(points)]).sum(dtype=np.uint32))


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs of neighbours."""
    out = first.astype(np.uint64) * _MIX + second
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ out >> np.uint64(29)


def _known(first: np.ndarray, second: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = paired(first, second) & np.uint64(MARK_BITS - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _piece(texts: list[str], least: int, bits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts), bool)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    info = _characters()[np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)]
    kind = (info >> np.uint32(24)).astype(np.uint8)
    sort = kind & np.uint8(3)
    starts = sort != 0
    starts[1:] &= (sort[1:] != sort[:-1]) | (sort[1:] == _SIGN)
    at = np.flatnonzero(starts)
    odd = np.flatnonzero(kind & np.uint8(_ODD))
    out[np.searchsorted(begin, odd, "right") - 1] = True
    if not len(at):
        return out
    own = np.add.reduceat((info & np.uint32(0xFFFFFF)) * _POWERS[: len(info)], at, dtype=np.uint32) * _INVERSE[at]
    number = sort[at] == _DIGIT
    own[number] = NUMBER
    # A capitalised word may be a name, and what is next to a number a unit; the parts of 3.14 are two numbers here.
    maybe = ((kind[at] & _UPPER) != 0) & ((kind[at + 1] & (_UPPER | 3)) == _LETTER)
    maybe[1:] |= number[:-1]
    maybe[:-1] |= number[1:]
    maybe &= ~number
    hit = _known(own[:-1], own[1:], bits)
    k = np.flatnonzero(~hit & (maybe[:-1] | maybe[1:]))
    a, b = own[k], own[k + 1]
    c, d = np.where(maybe[k], np.uint32(SLOT), a), np.where(maybe[k + 1], np.uint32(SLOT), b)
    hit[k] = _known(c, b, bits) | _known(a, d, bits) | _known(c, d, bits)
    first = np.searchsorted(at, begin)  # each text's first word
    hit[first[(first > 0) & (first < len(at))] - 1] = False
    cuts = np.concatenate([[-1], np.flatnonzero(~hit), [len(at) - 1]])
    runs = cuts[:-1][np.diff(cuts) >= least] + 1
    out[np.searchsorted(first, runs, "right") - 1] = True
    return out


def passes(texts: list[str], least: int, bits: np.ndarray) -> np.ndarray:
    """For each text whether it may hold a run of ``least`` words whose pairs of neighbours are all in the filter ``bits``
    (of MARK_BITS bits, at the hashes :func:`paired`); pairs of two numbers have to be in it."""
    out = np.ones(len(texts), bool)
    group, size = [], 0
    for k, text in enumerate(texts):
        if len(text) >= PIECE:
            continue
        if size + len(text) >= PIECE:
            out[group] = _piece([texts[i] for i in group], least, bits)
            group, size = [], 0
        group.append(k)
        size += len(text) + 1
    if group:
        out[group] = _piece([texts[i] for i in group], least, bits)
    return out
