"""Vectorised pre-tokens of byte-level BPE vocabularies, and a bounded table of their pieces."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from .common import U64, mix, prefix_hash, ragged, span_hash

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_APOSTROPHE = 0x27
#: No later plane has letters or numbers.
_LAST_PLANE = 0x40000
#: Code points tried out at once.
_TRIED = 4096


@lru_cache(maxsize=4)
def classes(path: str) -> np.ndarray:
    """White space, letter, number or other, by code point, as the tokenizer at ``path`` has them.

    Starts from this Python's Unicode tables.  Letters, numbers and points that have no
    meaning in them are then tried out next to an ``a`` and a ``1``, since the tokenizer may
    know another Unicode version.
    """
    letters = "".join(unicodedata.category(chr(point))[0] for point in range(sys.maxunicode + 1))
    major = np.frombuffer(letters.encode(), np.uint8)
    table = np.full(len(major), OTHER, np.uint8)
    for name, kind in (("L", LETTER), ("N", NUMBER), ("Z", SPACE)):
        table[major == ord(name)] = kind
    table[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85]] = SPACE
    others = np.flatnonzero(major[:_LAST_PLANE] == ord("C"))
    free = np.array([p for p in others.tolist() if unicodedata.category(chr(p)) == "Cn"], np.int64)
    split = load_tokenizer(path).pre_tokenizer.pre_tokenize_str
    for kind, before in ((LETTER, "a"), (NUMBER, "1")):
        points = np.append(np.flatnonzero(table == kind), free)
        joined = np.zeros(len(points), bool)
        for low in range(0, len(points), _TRIED):
            some = points[low:low + _TRIED].tolist()
            for _, (start, end) in split("".join(f"{before}{chr(p)}\n" for p in some)):
                if start % 3 == 0 and end - start == 2:
                    joined[low + start // 3] = True
        table[points] = OTHER
        table[points[joined]] = kind
        free = np.setdiff1d(free, points[joined])
    return table


def pretoken_starts(points: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Where pre-tokens begin in texts laid end to end, by the pattern

    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``

    ``offsets`` bound the texts; no pre-token crosses them.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes(path)[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    last = first[1:]                                   # of its text
    first = first[:n]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    following = np.empty(n, np.uint8)
    following[:-1] = kind[1:]
    following[-1] = SPACE
    # the last white space before something else is a token of its own or joins what follows
    before = (kind == SPACE) & ~last & (following != SPACE)
    start |= before
    glued = np.flatnonzero(before & (points == 0x20))
    start[glued + 1] = False
    marks = np.flatnonzero(start & (points == _APOSTROPHE) & ~last)
    if len(marks):
        one = points[marks + 1]
        more = marks[~last[marks + 1]]
        pair = np.zeros(n, bool)
        a, b = points[more + 1], points[more + 2]
        pair[more] = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | (
            (a == ord("l")) & (b == ord("l")))
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = pair[marks] & ~single
        for which, length in ((single, 2), (double, 3)):
            at = marks[which]
            start[at + 1] = False
            after = at + length
            inside = after[after < n]
            start[inside] = True
    return np.flatnonzero(start)


def span_keys(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit key for every pre-token."""
    ends = np.append(starts[1:], len(points))
    return span_hash(prefix_hash(mix(points.astype(U64) + U64(1))), starts, ends)


@lru_cache(maxsize=4)
def load_tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    return {t["content"]: t["id"] for t in added}


def split_specials(text: bytes, specials: dict[str, int]) -> list[bytes | int]:
    """A text cut at the strings of special tokens, which become ids; the longest string wins."""
    parts: list[bytes | int] = [text]
    for content, token in sorted(specials.items(), key=lambda x: -len(x[0])):
        parts = [y for x in parts for y in (_cut_out(x, content.encode(), token)
                                            if isinstance(x, bytes) else [x])]
    return parts


def _cut_out(text: bytes, content: bytes, token: int) -> list[bytes | int]:
    out: list[bytes | int] = []
    for part in text.split(content):
        out += [part, token]
    return out[:-1]


@lru_cache(maxsize=1)
def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = [""] * 256, 0
    for byte in range(256):
        if byte in plain:
            letters[byte] = chr(byte)
        else:
            letters[byte] = chr(256 + extra)
            extra += 1
    return letters


@lru_cache(maxsize=4)
def piece_encoder(path: str) -> Callable[[bytes], list[int]]:
    """Ids of one pre-token, given its UTF-8 bytes."""
    model = load_tokenizer(path).model
    table = dict(enumerate(_byte_letters()))

    def encode(word: bytes) -> list[int]:
        return [t.id for t in model.tokenize(word.decode("latin-1").translate(table))]
    return encode


class PieceTable:
    """Pieces of pre-tokens by key, in sorted arrays; holds at most ``limit`` entries.

    Only a memory of work done: when full it starts anew, and results stay the same.
    """

    def __init__(self, limit: int = 2_000_000, young: int = 100_000):
        self.limit, self.young_limit = limit, young
        self.clear()

    def clear(self) -> None:
        self.levels = [self._empty(), self._empty()]
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    @staticmethod
    def _empty():
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _add(self, level: int, entries) -> None:
        merged = [np.concatenate(p) for p in zip(self.levels[level], entries)]
        order = np.argsort(merged[0], kind="stable")
        self.levels[level] = tuple(a[order] for a in merged)

    def lookup(self, keys: np.ndarray, encode: Callable[[int], list[int]]
               ) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``flat`` and length of the pieces of each key; ``encode(i)`` makes key i's."""
        if len(self.levels[0][0]) + len(self.levels[1][0]) + len(keys) > self.limit:
            self.clear()
        place = np.zeros(len(keys), np.int64)
        length = np.full(len(keys), -1, np.int32)
        for known, places, lengths in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                place[hit] = places[at[hit]]
                length[hit] = lengths[at[hit]]
        missing = np.flatnonzero(length < 0)
        if len(missing):
            made = [encode(int(i)) for i in missing]
            sizes = np.fromiter(map(len, made), np.int32, len(made))
            ids = np.fromiter((x for m in made for x in m), np.uint32, int(sizes.sum()))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
            self.flat[self.used:self.used + len(ids)] = ids
            places = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
            place[missing], length[missing] = places, sizes
            self._add(1, (keys[missing], places, sizes))
            if len(self.levels[1][0]) > self.young_limit:
                self._add(0, self.levels[1])
                self.levels[1] = self._empty()
        return place, length


def span_ids(points: np.ndarray, offsets: np.ndarray, starts: np.ndarray, table: PieceTable,
             encode: Callable[[int, int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts laid end to end, and the offsets of each text's ids.

    The texts are cut at ``starts``; ``encode(start, end)`` makes the ids of a span that the
    table doesn't hold yet, once for equal spans of the block.
    """
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    keys, first, inverse = np.unique(span_keys(points, starts), return_index=True,
                                     return_inverse=True)
    bounds = np.append(starts, len(points))
    place, length = table.lookup(
        keys, lambda i: encode(int(bounds[first[i]]), int(bounds[first[i] + 1])))
    sizes = length[inverse].astype(np.int64)
    ids = table.flat[ragged(place[inverse], sizes)]
    ends = np.append(0, np.cumsum(sizes))
    return ids, ends[np.searchsorted(starts, offsets)]


def block_ids(points: np.ndarray, offsets: np.ndarray, data: np.ndarray, lead: np.ndarray,
              table: PieceTable, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte-level BPE ids of texts laid end to end, and the offsets of each text's ids."""
    encode, at = piece_encoder(path), np.append(lead, len(data))
    return span_ids(points, offsets, pretoken_starts(points, offsets, path), table,
                    lambda start, end: encode(data[at[start]:at[end]].tobytes()))
