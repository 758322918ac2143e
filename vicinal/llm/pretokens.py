"""The split of byte-level BPE vocabularies, made for whole batches of texts at once.

The pattern (contractions, runs of letters, digits or other signs with one
space before them, white space) is decided from the class of each code point and
of its neighbours, so it can be evaluated on arrays.  Classes are those that the
pattern's own library gives; a worker asks for them when it meets a code point
for the first time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from vicinal.llm.textcore import SPARE, U, keys, named

#: Fixed value: the pattern whose split this is.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
L, N, S, O, END = range(5)
_UNKNOWN = 255
_cls = np.full(0x110000, _UNKNOWN, np.uint8)
_KINDS = ((regex.compile(r"\p{L}"), L), (regex.compile(r"\p{N}"), N), (regex.compile(r"\s"), S))


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point."""
    kind = _cls[points]
    if (new := np.flatnonzero(kind == _UNKNOWN)).size:
        for c in np.unique(points[new]).tolist():
            _cls[c] = next((k for pattern, k in _KINDS if pattern.fullmatch(chr(c))), O)
        kind[new] = _cls[points[new]]
    return kind


def starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin.  points: code points of texts, each followed by one place that ``ends`` marks."""
    n = len(points)
    kind = classes(points)
    kind[ends] = END
    new = np.empty(n, bool)
    if not n:
        return new
    new[0] = True
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
    # The last sign of white space before a word: a space joins the word, any other stands alone.
    at = np.flatnonzero(new[1:] & (kind[:-1] == S) & (kind[1:] != END)) + 1
    new[at - 1] = True
    joined = at[points[at - 1] == 32]
    new[joined] = False
    # Contractions: an apostrophe that begins a piece, not joined to a space.
    at = np.flatnonzero((points[:-1] == 39) & new[:-1] & (kind[:-1] == O) & (kind[1:] == L))
    if at.size:
        pad = np.concatenate([points, np.zeros(3, points.dtype)])
        kinds = np.concatenate([kind, np.full(3, END, np.uint8)])
        a, b = pad[at + 1], pad[at + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        for where, size in ((at[one], 2), (at[two & ~one], 3)):
            new[where + 1] = False
            after = where + size
            after = after[(kinds[after] == L)]
            new[after] = True
    return new


class Pieces:
    """The pieces of texts in order and what names them; ``first[i]`` pieces lie before text i.

    A null text is empty.  A piece is known by its length in bytes and two numbers
    (``keys``): its bytes up to 16, a digest of 128 bits beyond.
    """

    def __init__(self, texts: pa.Array, pattern: str = PATTERN) -> None:
        if pattern != PATTERN:
            raise ValueError("only the split of PATTERN is known")
        strings = pc.fill_null(texts, "").to_pylist()
        self.joined = "\x00".join(strings) + "\x00"
        raw = self.joined.encode("utf-8", "surrogatepass")
        data = np.zeros(len(raw) + SPARE, np.uint8)
        data[: len(raw)] = np.frombuffer(raw, np.uint8)
        if len(raw) == len(self.joined):
            points = data[: len(raw)]
            place = None
        else:
            points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            place = np.append(np.flatnonzero(data[: len(raw)] & 0xC0 != 0x80), len(raw))  # where the bytes of each code point begin
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(size + 1) - 1
        at = np.flatnonzero(starts(points, ends))
        to = np.append(at[1:], len(points))
        mark = np.searchsorted(at, ends)
        real = np.ones(len(at), bool)
        real[mark] = False
        self.first = np.concatenate([[0], mark + 1 - np.arange(1, len(ends) + 1)])
        self.at, self.to = at[real], to[real]
        begin, end = (self.at, self.to) if place is None else (place[self.at], place[self.to])
        self.size = end - begin
        self.a, self.b = keys(data, begin, self.size)
        self.name = named(self.a, self.b, self.size)

    def strings(self, which: np.ndarray) -> list[str]:
        joined = self.joined
        return [joined[a:b] for a, b in zip(self.at[which].tolist(), self.to[which].tolist(), strict=True)]


class Memo:
    """Ids of pieces, kept between batches in a table of fixed size: a worker's memory is bounded.

    A piece has one place, where it is compared as a whole (see ``Pieces``); a piece
    that finds another there is encoded anew and takes it.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], bits: int = 20, most: int = 6 << 20) -> None:
        self.encode, self.bits, self.most = encode, bits, most
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.a, self.b, self.size = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int32)
        self.begin, self.count = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _add(self, ids: np.ndarray) -> int:
        at = self.used
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def batch(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids before each text."""
        if self.used > self.most:
            self.clear()
        slot = (pieces.name >> U(64 - self.bits)).astype(np.int64)
        begin, count = self.begin[slot], self.count[slot]
        miss = np.flatnonzero((self.a[slot] != pieces.a) | (self.b[slot] != pieces.b) | (self.size[slot] != pieces.size) | (count == 0))
        if miss.size:
            a, b, size = pieces.a[miss], pieces.b[miss], pieces.size[miss]
            order = np.lexsort((size, b, a))
            new = np.ones(len(order), bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (size[order][1:] != size[order][:-1])
            back = np.empty(len(order), np.int64)
            back[order] = np.cumsum(new) - 1
            where = miss[order[new]]
            at, many, found = self.encode(pieces.strings(where))
            at = at + self._add(found)
            begin[miss], count[miss] = at[back], many[back]
            # Of two new pieces with one place the last one stays.
            to, last = np.unique(slot[where][::-1], return_index=True)
            last = len(where) - 1 - last
            self.a[to], self.b[to], self.size[to] = pieces.a[where[last]], pieces.b[where[last]], pieces.size[where[last]]
            self.begin[to], self.count[to] = at[last], many[last]
        before = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        ids = self.pool[np.repeat(begin - before[:-1], count) + np.arange(before[-1])]
        return ids, before[pieces.first]
