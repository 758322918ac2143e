"""Byte-level BPE by a table of last tokens.

For each prefix of a byte string the encoding ends in one token, and that token
is the only one that both ends the prefix and goes with the last token of the
prefix before it.  Two tokens go together if, with merges made in order of
rank, no merge across their border comes before both are whole.  Kept per
prefix, these last tokens give the ids by walking back, let bytes be appended
without looking at earlier ones again, and after an edit need new values only
until as many of them in a row as the longest token has bytes are as before.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.pretokens import Memo, Pieces
from vicinal.llm.textcore import arrow_batches, blocks


def load_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 bytes and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Vocabulary:
    """Tokens by rank, their last merges, and which pairs of tokens go together."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.usable = {b: i for b, i in ranks.items() if len(b) == 1}
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) > 1 and (halves := self._last_merge(b, i)):
                self.halves[i] = halves
                self.usable[b] = i
        self.longest = max(map(len, self.usable), default=1)
        self.by_end: dict[int, list[int]] = {}
        for b in self.usable:
            self.by_end.setdefault(b[-1], []).append(len(b))
        self.lengths = {e: sorted(set(n), reverse=True) for e, n in self.by_end.items()}
        #: Tokens by their bytes in order: byte -> node, and at -1 the token that ends here.
        self.tree: dict = {}
        for b, i in self.usable.items():
            node = self.tree
            for x in b:
                node = node.setdefault(x, {})
            node[-1] = i

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that merge into this one; None if merges of lower rank never leave two."""
        parts = [token[k : k + 1] for k in range(len(token))]
        if any(p not in self.ranks for p in parts):
            return None
        while len(parts) > 2:
            found = min(((r, k) for k in range(len(parts) - 1) if (r := self.ranks.get(parts[k] + parts[k + 1], rank)) < rank), default=None)
            if found is None:
                return None
            k = found[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def together(self, a: int, b: int) -> bool:
        """Whether the encoding of these tokens' bytes is these two tokens."""
        after = self.pairs.get(a)
        if after is None:
            after = self.pairs[a] = {}
        known = after.get(b)
        if known is None:
            self.n_pairs += 1
            if self.n_pairs > 500_000:
                self.pairs, self.n_pairs = {a: after}, 0
                after.clear()
            known = after[b] = self._together(a, b)
        return known

    def _together(self, a: int, b: int) -> bool:
        """Takes merges back, last one first, and looks each time for a merge across the border that would have come before."""
        ranks, bytes_of, halves = self.ranks, self.bytes_of, self.halves
        before = len(ranks) << 1  # a merge across the border of lower rank than this spoils the pair
        while True:
            across = ranks.get(bytes_of[a] + bytes_of[b])
            if across is not None and across < before:
                return False
            cut_a, cut_b = halves.get(a), halves.get(b)
            if cut_a is None and cut_b is None:
                return True
            if cut_b is None or cut_a is not None and a > b:
                before, a = a, cut_a[1]
            else:  # of equal ranks, the merge on the left comes first
                before, b = b + 1, cut_b[0]

    def last(self, data: bytes, i: int, table: list[int]) -> int:
        """The last token of data[:i], given those of shorter prefixes."""
        usable = self.usable
        for k in self.lengths[data[i - 1]]:
            if k > i:
                continue
            token = usable.get(data[i - k : i])
            if token is None:
                continue
            if k == i:
                return token
            if self.together(table[i - k], token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def back(self, table: list[int], n: int) -> list[int]:
        """The ids of a prefix of n bytes."""
        out = []
        while n:
            token = table[n]
            out.append(token)
            n -= len(self.bytes_of[token])
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece; one that is a token as a whole is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        # From each prefix on, in order, the tokens that may follow its last one.  A prefix has
        # one last token, so a prefix that has got it needs no other look.
        n = len(piece)
        table: list[int] = [-1] * (n + 1)
        tree, together = self.tree, self.together
        for s in range(n):
            node, e = tree, s
            before = table[s]
            after = self.pairs.get(before) or {}
            while e < n:
                node = node.get(piece[e])
                if node is None:
                    break
                e += 1
                if table[e] < 0 and (token := node.get(-1)) is not None:
                    if s == 0:
                        table[e] = token
                    else:
                        known = after.get(token)
                        if known or known is None and together(before, token):
                            table[e] = token
        if n and table[n] < 0:
            raise ValueError("the vocabulary lacks a byte")
        return self.back(table, n)


class PrefixTable:
    """One piece with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.table = vocabulary, b"", [-1]
        self.computed = 0
        self.append(data)

    def append(self, more: bytes) -> None:
        self.replace(len(self.data), len(self.data), more)

    def replace(self, a: int, b: int, new: bytes) -> None:
        """Bytes a to b become ``new``; ``computed`` counts the prefixes that got a new value."""
        old, shift = self.table, len(new) - (b - a)
        self.data = self.data[:a] + new + self.data[b:]
        table, same = old[: a + 1], 0
        for i in range(a + 1, len(self.data) + 1):
            token = self.vocabulary.last(self.data, i, table)
            table.append(token)
            self.computed += 1
            same = same + 1 if i - shift > b and old[i - shift] == token else 0
            if same >= self.vocabulary.longest and i - shift - same >= b:
                table += old[i - shift + 1 :]
                break
        self.table = table

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        return [whole] if whole is not None else self.vocabulary.back(self.table, len(self.data))


class EditableText:
    """A text, split into pieces, whose ids follow appends and edits."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = "") -> None:
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.text, self.pieces = "", []
        self.append(text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, a: int, b: int, new: str) -> None:
        """Characters a to b become ``new``; pieces from two before the edit to the first old border behind it are made again."""
        starts, at = [], 0
        for p, _ in self.pieces:
            starts.append(at)
            at += len(p)
        keep = max(0, sum(s < a for s in starts) - 2)
        begin = starts[keep] if keep < len(starts) else at
        shift = len(new) - (b - a)
        old = {s + shift: k for k, s in enumerate(starts) if s >= b}
        self.text = self.text[:a] + new + self.text[b:]
        made, rest = [], []
        for m in self.pattern.finditer(self.text, begin):
            if m.start() >= a + len(new) and m.start() in old:
                rest = self.pieces[old[m.start()] :]
                break
            made.append((m.group(), tuple(self.vocabulary.encode(m.group().encode()))))
        self.pieces = self.pieces[:keep] + made + rest

    def ids(self) -> list[int]:
        return [i for _, ids in self.pieces for i in ids]


class Decoder:
    """Bytes of ids, for arrays."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        most = max(vocabulary.bytes_of) + 1
        self.size = np.zeros(most, np.int64)
        for i, b in vocabulary.bytes_of.items():
            self.size[i] = len(b)
        self.begin = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(vocabulary.bytes_of.get(i, b"") for i in range(most)), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and the number of bytes before each id and after the last."""
        size = self.size[ids]
        before = np.concatenate([[0], np.cumsum(size)])
        return self.pool[np.repeat(self.begin[ids] - before[:-1], size) + np.arange(before[-1])], before


class PieceEncoder:
    """Many pieces by the table of last tokens, as ``Memo`` takes them."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        encode = self.vocabulary.encode
        found = [encode(p.encode("utf-8", "surrogatepass")) for p in pieces]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.cumsum(size) - size, size, np.array([i for x in found for i in x], np.uint32)


_loaded: dict[str, Vocabulary] = {}


def vocabulary_at(path: str) -> Vocabulary:
    """The vocabulary of a rank file, read once a process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(load_ranks(path))
    return _loaded[path]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of every text, one row for each row.

    Ids are hashed as little-endian unsigned 32-bit integers; the decoded bytes
    are those of the ids, not of the text.  With keep_ids, a column ids follows.
    A null text is empty (no tokens); null and repeated ids stay as they are, and
    equal texts have equal ids; an empty table gives no rows; other columns are not
    read, whatever their names.  A text of any length is encoded as a whole, and one
    without spaces costs time in proportion to its length.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_at(ranks)
        memo, decode = Memo(PieceEncoder(vocabulary)), Decoder(vocabulary)
        for batch in batches:
            for a, b, _, _ in blocks(batch.column(1)):
                ids, first = memo.batch(Pieces(batch.column(1).slice(a, b - a), pattern))
                raw = ids.astype("<u4").tobytes()
                data, before = decode(ids)
                data, at = data.tobytes(), before[first].tolist()
                cuts = first.tolist()
                out = [batch.column(0).slice(a, b - a), pa.array(np.diff(first))]
                out.append(pa.array([sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]))
                out.append(pa.array([sha256(data[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]))
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)
