"""Whole batches of texts cut and hashed at once, as arrays of code points.

A batch is one array of code points with the places where its documents begin. Classes come from a table over all
code points; runs, pre-tokens and words are places where the class changes. A piece's 64-bit hash is polynomial over
random values of its code points, from running sums, so no Python object is made for a piece.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Code points with the Unicode property White_Space, as ranges.
WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
#: Odd, so that its powers have inverses modulo 2^64.
_R = 0x9E3779B97F4A7C15


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = LETTER
        elif kind == "N":
            out[i] = NUMBER
    for a, b in WHITE:
        out[a : b + 1] = SPACE
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(2)
def _values(seed: int = 0) -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_R) + np.uint64(seed))


_POWERS: list[np.ndarray] = []
#: Powers that a worker keeps; a longer text makes its own.
_KEPT_POWERS = 1 << 21


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    size = max(n, 1 << 20)
    made = [np.full(size, _R, np.uint64), np.full(size, pow(_R, -1, 1 << 64), np.uint64)]
    for p in made:
        p[0] = 1
        np.multiply.accumulate(p, out=p)
    if size <= _KEPT_POWERS:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def sums(values: np.ndarray) -> np.ndarray:
    """Running sums from which piece_hash takes any piece."""
    c = np.empty(len(values) + 1, np.uint64)
    c[0] = 0
    np.cumsum(values * _powers(len(values))[0], out=c[1:])
    return c


def piece_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = _powers(len(c))[1]
    return mix((c[ends] - c[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class HashClash(ValueError):
    """Two different pieces have one 64-bit hash: code points must have other values (another seed)."""


def distinct(cp: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique of pieces by their hashes, after every piece is compared to the one that stands for it, symbol by symbol."""
    found, sample, back = np.unique(h, return_index=True, return_inverse=True)
    n, twin = ends - starts, starts[sample][back]
    other = np.flatnonzero(twin != starts)
    if (n != (ends - starts)[sample][back]).any() or (cp[slices(starts[other], n[other])] != cp[slices(twin[other], n[other])]).any():
        raise HashClash
    return found, sample, back


def same_words(found: np.ndarray, distinct: np.ndarray, first: np.ndarray, names: list[str]) -> None:
    """That names of equal hashes found are equal; first: the place that stands for each of distinct."""
    if len(found) > len(distinct):
        for i, k in enumerate(first[np.searchsorted(distinct, found)].tolist()):
            if names[i] != names[k]:
                raise HashClash


def values_of(cp: np.ndarray, seed: int = 0) -> np.ndarray:
    return _values(seed)[cp]


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text begins, with the end."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    cp = np.frombuffer("".join(texts).encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
    return cp, at


def chunks(texts: list[str], chars: int = 1 << 20):
    """Slices of texts of about so many characters, so that arrays stay small; a longer text is a slice of its own."""
    a = n = 0
    for i, x in enumerate(texts):
        if n and n + len(x) > chars:
            yield a, i
            a, n = i, 0
        n += len(x)
    if a < len(texts):
        yield a, len(texts)


def _flags(n: int, at: np.ndarray) -> np.ndarray:
    """Where documents begin."""
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    first[n] = True
    return first


def _contractions(cp, cls, first, bound, spaced: bool) -> None:
    """Cuts 's 't 'm 'd 're 've 'll that begin a piece from the letters after them."""
    n = len(cp)
    tick = np.flatnonzero(cp[: n - 1] == 0x27) if n > 1 else np.empty(0, np.int64)
    tick = tick[(cls[tick + 1] == LETTER) & ~first[tick + 1]]
    before = first[tick] | (cls[tick - 1] != OTHER)
    if spaced:  # a space before it goes with the tick
        before &= first[tick] | (cp[tick - 1] != 0x20)
    tick = tick[before]
    if not len(tick):
        return
    one = np.isin(cp[tick + 1], [ord(x) for x in "stmd"])
    rest = tick[~one & (tick + 2 < n)]
    rest = rest[~first[rest + 2]]
    pair = cp[rest + 1] * np.uint32(256) + cp[rest + 2]
    two = rest[np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")]) & (cp[rest + 2] < 256)]
    for where, k in ((tick[one], 2), (two, 3)):
        bound[where + 1] = False
        bound[where + k] = True


def byte_level(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of the byte-level pattern: contractions; letters, digits or others, each with one space before; white space."""
    n = len(cp)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cls, first = classes()[cp], _flags(n, at)
    bound = first.copy()
    bound[1:n] |= cls[1:] != cls[:-1]
    # the last of white space that is followed by text in the same document stands alone, or goes with the text if it is a space
    last = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE) & ~first[1:n])
    bound[last] = True
    blank = last[cp[last] == 0x20]
    bound[blank + 1] = False
    _contractions(cp, cls, first, bound, True)
    places = np.flatnonzero(bound)
    return places[:-1], places[1:]


def lowered(cp: np.ndarray) -> np.ndarray:
    return _lower()[cp]


@functools.cache
def _lower() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        x = chr(i).lower()
        if len(x) == 1:
            out[i] = ord(x)
    return out


@functools.cache
def unusual() -> np.ndarray:
    """Code points that composition (NFC) may change or join to others, or whose small form is longer."""
    out = np.zeros(0x110000, bool)
    for i in range(0x110000):
        x = chr(i)
        out[i] = unicodedata.combining(x) != 0 or len(x.lower()) != 1 or (0xD800 <= i < 0xE000) or not unicodedata.is_normalized("NFC", x)
        parts = unicodedata.decomposition(x).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out[int(parts[1], 16)] = True
    out[0x1161:0x1176] = True
    out[0x11A8:0x11C3] = True
    return out


def word_level(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for the word pattern over small letters: contractions; letters; single digits; others. White space is left out."""
    n = len(cp)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cls, first = classes()[cp], _flags(n, at)
    bound = first.copy()
    bound[1:n] |= (cls[1:] != cls[:-1]) | (cls[1:] == NUMBER)
    _contractions(cp, cls, first, bound, False)
    places = np.flatnonzero(bound)
    starts, ends = places[:-1], places[1:]
    shown = cls[starts] != SPACE
    return starts[shown], ends[shown]


def blank_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs other than space and 9 to 13, of bytes or code points."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = _flags(n, at)
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    stops = word.copy()
    stops[:-1] &= ~word[1:] | first[1:n]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def owners(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The document of each place; at may repeat where texts are empty."""
    return np.searchsorted(at, places, "right") - 1


def slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the given slices, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def strings(column) -> list[str]:
    """A text column of an Arrow batch; null is the empty text."""
    return [x or "" for x in column.to_pylist()]
