"""Array-at-a-time word splitting and hashing shared by the text operators.

A word is a maximal run of ``0-9``, ``a-z`` (``A-Z`` is lower-cased first) and
everything outside ASCII.  UTF-8 keeps the bytes of non-ASCII characters at or
above 0x80, so the same rule holds byte by byte and the Arrow buffer of a text
column can be read without decoding a single string.

Words and word runs are named by 64-bit hashes.  A word of 16 bytes or fewer
enters its hash as it is, a longer one by a digest, and both through mixing steps
without algebraic structure, so no kind of text collides more often than another:
a pair of different words shares a name with a probability of 5e-20, and a corpus
of 10^9 different words has such a pair with about 0.03.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240229)
_LANE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes that arrays need behind the last word for ``keys``.
SPARE = 16

#: Texts are worked on in chunks of about so many bytes, longer texts alone.
CHUNK = 1 << 20


def arrow_batches(spark, records: int = 512, size: int = 8 << 20) -> None:
    """Bounds the Arrow batches that Python workers get, so that long texts fit; a session that has lower bounds keeps them.

    Plans read these settings when they run, so they stay.
    """
    for name, most in (("maxRecordsPerBatch", records), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.match(r"[0-9]+", spark.conf.get(key))
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    return np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))


def keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of each stretch of bytes: the bytes themselves up to 16, a digest of 128 bits beyond.

    data: contiguous, with SPARE bytes behind the last stretch.
    """
    eights = _eights(data)
    a = eights[start] & _MASK[np.minimum(size, 8)]
    b = np.zeros(len(a), np.uint64)
    more = np.flatnonzero(size > 8)
    b[more] = eights[start[more] + 8] & _MASK[np.minimum(size[more] - 8, 8)]
    if (long := np.flatnonzero(size > 16)).size:
        whole = memoryview(data)
        digests = b"".join(blake2b(whole[x:y], digest_size=16).digest() for x, y in zip(start[long].tolist(), (start[long] + size[long]).tolist(), strict=True))
        a[long], b[long] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    return a, b


def named(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash of a stretch of bytes from its numbers and its length."""
    with np.errstate(over="ignore"):
        return mix(mix(a ^ size.astype(np.uint64) * U(0x9E3779B97F4A7C15)) + (b ^ U(0x6A09E667F3BCC909)) * U(0xD1342543DE82EF95))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at * 0
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of values that hold about ``size`` bytes, one value at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


class Words:
    """The words of consecutive texts: ``hash`` of each, and ``first[i]``, the number of words before text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> None:
        """cuts: offsets of the texts (or lines) that words are counted by; offsets if None."""
        n = len(data)
        low = np.zeros(n + SPARE, np.uint8)
        low[:n] = LOWER[data]
        inside = IS_WORD[low[:n]]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        size = self.end - self.start
        self.low = low
        self.hash = named(*keys(low, self.start, size), size)
        self.first = np.searchsorted(self.start, offsets if cuts is None else cuts)

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have more bytes than ``size`` (8 at most), and hashes of the first ``size`` of each."""
        which = np.flatnonzero(self.end - self.start > size)
        return which, mix((_eights(self.low)[self.start[which]] & _MASK[size]) ^ U(size << 56 | 1 << 63))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive words; runs across texts are for the caller to leave out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out += hashes[k : k + n] * _LANE[k % 64] ** U(1 + k // 64)
        return mix(out + U(width))


def shingles(words: Words, width: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word runs of each text and the index of the text of each.

    whole: a text of fewer words, but not none, has one run of all its words.
    """
    first = words.first
    count = np.diff(first)
    run = runs(words.hash, width)
    text = np.repeat(np.arange(len(count)), count)[: len(run)]
    ok = np.arange(len(run)) + width <= first[1:][text] if len(run) else np.zeros(0, bool)
    run, text = run[ok], text[ok]
    if whole and (short := np.flatnonzero((count > 0) & (count < width))).size:
        extra = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width - 1):
                has = count[short] > k
                extra[has] += words.hash[first[short[has]] + k] * _LANE[k]
            extra = mix(extra + count[short].astype(np.uint64))
        run, text = np.concatenate([run, extra]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        run, text = run[order], text[order]
    return run, text


def word_hash(word: str) -> np.uint64:
    """The hash that a single word gets in any text."""
    data = np.frombuffer(word.encode(), np.uint8)
    found = Words(data, np.array([0, len(data)]))
    if len(found.hash) != 1:
        raise ValueError(f"{word!r} is not one word")
    return found.hash[0]


def blocks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of a text column: from, to, bytes and offsets."""
    data, offsets = text_bytes(column)
    for a, b in chunks(offsets, size):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
