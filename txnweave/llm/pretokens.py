"""Vectorised splitting of texts before byte-level merges, and a dictionary of encoded pieces.

``split_points`` gives the matches of the byte-level pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

as array operations: characters fall into letters, numbers, white space and others; a
piece is a run of one class; of white space before another class the last character is
on its own, or joins the next piece if it is U+0020; an apostrophe that is alone and
starts a piece takes the letters of an English contraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from .common import distinct_spans, padded, row_steps, same_spans

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Pieces that a dictionary holds before it starts anew.
DICTIONARY_PIECES = 1_500_000
#: And their bytes.
DICTIONARY_BYTES = 64 << 20
_APOSTROPHE, _BLANK = 0x27, 0x20


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    classes = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, everything):
            a, b = ord(m[0][0]), ord(m[0][-1])
            classes[a : b + 1] = kind
    return classes


def split_points(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions where pieces start. points: code points of all rows; rows: where rows start."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kinds = character_classes()[points]
    row = np.zeros(n + 1, bool)
    row[rows] = True
    row[n] = True
    start = row[:n].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    # The last white space before another piece of the row.
    last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~row[1:n])
    start[last] = True
    start[last[points[last] == _BLANK] + 1] = False
    p = np.flatnonzero((points == _APOSTROPHE) & start)
    p = p[p + 1 < n]
    p = p[~row[p + 1] & (kinds[p + 1] == LETTER)]
    if len(p):
        one = np.isin(points[p + 1], [ord(c) for c in "stmd"])
        q = np.minimum(p + 2, n - 1)
        pair = points[p + 1].astype(np.int64) * 0x110000 + points[q]
        two = (p + 2 < n) & ~row[np.minimum(p + 2, n)] & np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])
        for at, size in ((p[one], 2), (p[two & ~one], 3)):
            start[at + 1] = False
            end = at + size
            start[end[end < n]] = True
    return np.flatnonzero(start)


class Dictionary:
    """Encoded pieces, found by hash and compared byte by byte; ``encode`` gives the ids of pieces not seen before."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)
        #: The pieces' bytes (eight spare ones behind them) and where they end.
        self.raw = np.zeros(1 << 16, np.uint8)
        self.cuts = np.zeros(1 << 14, np.int64)
        # Sorted hashes and places: the bulk, and what came since it was last merged.
        self.bulk = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.recent = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        #: Pieces whose hash another piece has.
        self.odd: dict[bytes, int] = {}

    @staticmethod
    def _put(values: np.ndarray, ends: np.ndarray, n: int, new: np.ndarray, sizes: np.ndarray, spare: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Append new values of n.. items of some sizes to growing arrays."""
        while len(ends) <= n + len(sizes):
            ends = np.concatenate([ends, np.zeros_like(ends)])
        base = int(ends[n])
        ends[n + 1 : n + 1 + len(sizes)] = base + np.cumsum(sizes)
        while len(values) < base + len(new) + spare:
            values = np.concatenate([values, np.zeros_like(values)])
        values[base : base + len(new)] = new
        return values, ends

    def _append(self, pieces: list[bytes]) -> None:
        made = self.encode(pieces)
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        self.ids, self.ends = self._put(self.ids, self.ends, self.n, np.fromiter(chain.from_iterable(made), np.int32, int(sizes.sum())), sizes)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.raw, self.cuts = self._put(self.raw, self.cuts, self.n, np.frombuffer(b"".join(pieces), np.uint8), sizes, 8)
        self.n += len(made)

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order]

    def lookup(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of distinct pieces data[start:end] with their hashes."""
        if self.n and (self.n + len(hashes) > DICTIONARY_PIECES or self.cuts[self.n] > DICTIONARY_BYTES):
            self.clear()
        place = np.full(len(hashes), -1, np.int64)
        for keys, places in (self.bulk, self.recent):
            if len(keys):
                at = np.searchsorted(keys, hashes)
                at[at == len(keys)] = 0
                hit = keys[at] == hashes
                place[hit] = places[at[hit]]
        piece = lambda i: data[starts[i] : ends[i]].tobytes()
        hit = np.flatnonzero(place >= 0)
        sizes = (ends - starts)[hit]
        same = self.cuts[place[hit] + 1] - self.cuts[place[hit]] == sizes
        same[same] = same_spans(padded(data), starts[hit[same]], self.raw, self.cuts[place[hit[same]]], sizes[same])
        clash = hit[~same]
        for i in clash.tolist():
            place[i] = self.odd.get(piece(i), -1)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(self.n, self.n + len(new))
            self._append([piece(i) for i in new.tolist()])
            for i in np.intersect1d(clash, new).tolist():
                self.odd[piece(i)] = int(place[i])
            new = np.setdiff1d(new, clash)
            self.recent = self._merged(self.recent, (hashes[new], place[new]))
            if len(self.recent[0]) > 1 << 16:
                self.bulk, self.recent = self._merged(self.bulk, self.recent), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return place


def encode_rows(data: np.ndarray, offsets: np.ndarray, words: Dictionary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, ids before each row) of UTF-8 rows, a step at a time."""
    for i, j in row_steps(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.append(np.flatnonzero((part & 0xC0) != 0x80), len(part))
        ends = np.searchsorted(lead, at)
        starts = split_points(points, ends[:-1])
        if not len(starts):
            yield i, j, np.zeros(0, np.int32), np.zeros(j - i + 1, np.int64)
            continue
        a, b = lead[starts], lead[np.append(starts[1:], len(points))]
        hashes, first, inverse = distinct_spans(part, a, b)
        which = words.lookup(hashes, part, a[first], b[first])[inverse]
        begin = words.ends[which]
        sizes = words.ends[which + 1] - begin
        before = np.concatenate([[0], np.cumsum(sizes)])
        total = int(before[-1])
        ids = words.ids[np.repeat(begin - before[:-1], sizes) + np.arange(total)]
        yield i, j, ids, before[np.searchsorted(starts, ends, "left")]
