"""Token ids by a public byte-level tokenizer, found once for each distinct pre-token of a batch.

The tokenizers library gives the ids of every pre-token that a batch holds; texts are put together from them. Strings
of special tokens inside a text are cut out first and become their id, as the library does by default.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np

from tidelog.llm import textscan


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def library(file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


@functools.cache
def specials(file: str) -> dict[str, int]:
    import json

    with open(file) as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class Encoder:
    """Ids of whole batches of texts. cached: pre-tokens kept between batches, forgotten all at once beyond that."""

    def __init__(self, file: str, cached: int = 500_000):
        self.file, self.cached = file, cached
        self.special = specials(file)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.mark = next(iter(self.special), None)
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)  # sorted hashes
        self.place = np.empty(0, np.int64)  # of the pre-token's ids in the pool
        self.count = np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and how many each has."""
        tokenize = library(self.file).model.tokenize
        # one translation for all: a byte that UTF-8 never has stands between the pieces
        shown = b"\xff".join([x.encode("utf-8", "replace") for x in pieces]).decode("latin-1").translate(_visible()).split("\n")
        found = [[t.id for t in tokenize(x)] for x in shown]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(count.sum())), count

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        if len(self.known) + len(hashes) > self.cached:
            self._forget()
        ids, count = self._ids(pieces)
        place = len(self.pool) + np.cumsum(count) - count
        at = np.searchsorted(self.known, hashes)
        self.known, self.place, self.count = np.insert(self.known, at, hashes), np.insert(self.place, at, place), np.insert(self.count, at, count)
        self.pool = np.concatenate([self.pool, ids])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cp, at = textscan.codepoints(texts)
        starts, ends = textscan.byte_level(cp, at)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        hashes = textscan.piece_hash(textscan.sums(textscan.values_of(cp)), starts, ends)
        distinct, sample, back = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != distinct[inside]
        if len(self.known) + new.sum() > self.cached:
            self._forget()
            new[:] = True
        if new.any():
            joined, k = "".join(texts), sample[new]
            self._learn(distinct[new], [joined[a:b] for a, b in zip(starts[k].tolist(), ends[k].tolist())])
        spot = np.searchsorted(self.known, distinct)
        place, count = self.place[spot][back], self.count[spot][back]
        ids = self.pool[textscan.slices(place, count)]
        upto = np.concatenate([[0], np.cumsum(count)])
        edge = np.searchsorted(starts, at)
        return ids, np.diff(upto[edge])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        if not self.cut or not any(s in x for x in texts for s in self.special if "<" in x):
            return self._plain(texts)
        parts, owner = [], []
        for i, x in enumerate(texts):
            cut = self.cut.split(x)
            parts += cut
            owner += [i] * len(cut)
        ids, count = self._plain([("" if x in self.special else x) for x in parts])
        out, totals, place = [], np.zeros(len(texts), np.int64), np.concatenate([[0], np.cumsum(count)])
        for k, (x, i) in enumerate(zip(parts, owner)):
            own = np.array([self.special[x]], np.uint32) if x in self.special else ids[place[k] : place[k + 1]]
            out.append(own)
            totals[i] += len(own)
        return np.concatenate(out) if out else ids, totals

    def batches(self, texts: list[str]):
        """encode() over slices of bounded size: (first text, past the last, ids, counts)."""
        for a, b in textscan.chunks(texts):
            yield a, b, *self.encode(texts[a:b])


@functools.cache
def _visible() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    out[0xFF] = "\n"  # no UTF-8 text has this byte, and no byte is shown as a line end
    return out


@functools.cache
def encoder(file: str) -> Encoder:
    return Encoder(file)
