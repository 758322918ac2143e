"""Benchmark decontamination with suffix arrays of the training texts.

A shard is a run of training documents of bounded size.  Its words are laid in a
row, with a different end mark behind each document, and the places whose next
words can begin a match are sorted by what follows them: a suffix array.  All
suffixes of benchmark items are searched in the array of each shard by halving;
the neighbours of a suffix's place give its longest verbatim match, and the range
of places that begin with its next ``window`` words gives every occurrence of
that window.  Occurrences that continue each other are one match, so each
document's longest one is known too.  Shards need nothing from each other, and
nothing is shuffled.  The benchmark travels in blocks of bounded size; one that
has several takes a pass over the documents for each, and only one block is in
memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm import shared
from vicinal.llm.textcore import Words, arrow_batches, blocks, runs

#: Bytes of item text that a pass over the documents takes.
ITEM_BLOCK = 8 << 20


class SuffixArray:
    """Places of a row of words, sorted by the words that follow.

    words: word numbers; marks between texts are negative and all different, so
    no match runs over them, and the last word is a mark.  places: those that are
    sorted; None for all.
    """

    def __init__(self, words: np.ndarray, places: np.ndarray | None = None) -> None:
        n = len(words)
        self.words = words
        if places is None:
            places = np.arange(n)
        if not len(places):
            self.order = places
            return
        # Ranks of word runs of doubled length, until no two sorted places tie.
        rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
        width = 1
        key = rank[places]
        while True:
            by = np.argsort(key, kind="stable")
            ties = key[by][1:] == key[by][:-1]
            if not ties.any() or width >= n:
                break
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:]
            both = rank * (int(rank.max()) + 1) + after
            rank = np.unique(both, return_inverse=True)[1].astype(np.int64) + 1
            key = rank[places]
            width *= 2
        self.order = places[by]

    def compare(self, at: np.ndarray, row: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes at ``at`` against patterns row[begin : begin + size] (0: they begin with them), and the words that agree."""
        order, agree = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64)
        going = np.flatnonzero(size > 0)
        k = 0
        while len(going):
            x, y = self.words[at[going] + k], row[begin[going] + k]
            same = x == y
            order[going[~same]] = np.where(x < y, -1, 1)[~same]
            k += 1
            going = going[same]
            agree[going] = k
            going = going[size[going] > k]
        return order, agree

    def bounds(self, row: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern, places from and to in the array of the suffixes that begin with it; all are halved at once."""
        ends = []
        for limit in (0, 1):
            a, b = np.zeros(len(begin), np.int64), np.full(len(begin), len(self.order))
            while (going := np.flatnonzero(a < b)).size:
                m = (a[going] + b[going]) // 2
                less = self.compare(self.order[m], row, begin[going], size[going])[0] < limit
                a[going[less]] = m[less] + 1
                b[going[~less]] = m[~less]
            ends.append(a)
        return ends[0], ends[1]

    def longest(self, row: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most words with which each pattern begins that occur, and a place where they do (-1: none)."""
        a, _ = self.bounds(row, begin, size)
        best, where = np.zeros(len(begin), np.int64), np.full(len(begin), -1)
        for k in (a - 1, a):
            ok = np.flatnonzero((k >= 0) & (k < len(self.order)))
            agree = self.compare(self.order[k[ok]], row, begin[ok], size[ok])[1]
            better = agree > best[ok]
            best[ok[better]], where[ok[better]] = agree[better], self.order[k[ok[better]]]
        return best, where


@dataclass
class Items:
    """A block of benchmark items: ``row`` has their words as places in ``known`` (sorted hashes), ``first[i]`` words lie before item i."""

    ids: list[str | None]
    row: np.ndarray
    known: np.ndarray
    first: np.ndarray
    window: int

    def __post_init__(self) -> None:
        count = np.diff(self.first)
        self.item = np.repeat(np.arange(len(count), dtype=np.int32), count)
        left = self.first[1:][self.item] - np.arange(len(self.row))
        need = np.minimum(self.window, count)[self.item]
        self.starts = np.flatnonzero(left >= need)  # places where a window begins
        self.size = need[self.starts]
        self.left = left[self.starts]
        self.heads: list[tuple[int, np.ndarray, np.ndarray]] = []  # window size, its starts, and hashes of their first words
        for size in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == size)
            self.heads.append((size, own, head(self.known[self.row], size)[self.starts[own]]))


def head(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first words of windows of that size, three of them at most."""
    return runs(words, min(size, 3))


def item_blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str, size: int | None = None) -> Iterator[Items]:
    """Blocks of items.  One block is in memory at a time; an item without words has no windows."""
    size = size or ITEM_BLOCK
    ids: list[str | None] = []
    texts: list[str] = []
    held = 0

    def made() -> Items:
        parts, first = [np.zeros(0, np.uint64)], [0]
        for _, _, data, offsets in blocks(pa.array(texts, pa.string())):
            found = Words(data, offsets)
            parts.append(found.hash)
            first += (first[-1] + found.first[1:]).tolist()
        known, row = np.unique(np.concatenate(parts), return_inverse=True)
        return Items(list(ids), row.astype(np.int32), known, np.array(first), window)

    rows = benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    for row in rows.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1] or "")
        held += len(texts[-1]) + 64
        if held >= size:
            yield made()
            ids, texts, held = [], [], 0
    if ids:
        yield made()


class Shard:
    """Documents in a row with the suffix array of the places that matter for a block of items."""

    def __init__(self, words: np.ndarray, first: np.ndarray, items: Items) -> None:
        self.items = items
        n_docs = len(first) - 1
        # Words as numbers of the items' vocabulary; words that no item has are told apart from all others.
        at = np.minimum(np.searchsorted(items.known, words), max(len(items.known) - 1, 0))
        has = items.known[at] == words if len(items.known) else np.zeros(len(words), bool)
        near = np.zeros(len(words), bool)
        asked = []  # windows whose first words the shard has
        for size, own, heads in items.heads:
            found = head(words, size)
            if len(found) and len(heads):
                keys = np.unique(heads)
                place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == found)
                near[hit] = True
                seen = np.zeros(len(keys), bool)
                seen[place[hit]] = True
                asked.append(own[seen[np.searchsorted(keys, heads)]])
        self.asked = np.sort(np.concatenate(asked)) if asked else np.zeros(0, np.int64)
        row = np.full(len(words) + n_docs, -1, np.int64)
        shift = np.repeat(np.arange(n_docs), np.diff(first))
        row[np.arange(len(words)) + shift] = np.where(has, at, -1)
        gap = np.flatnonzero(row < 0)
        row[gap] = -1 - np.arange(len(gap))
        self.doc_of = np.repeat(np.arange(n_docs), np.diff(first) + 1)
        self.begin = first[:-1] + np.arange(n_docs)
        places = np.flatnonzero(near)
        places = places + shift[places]
        # Only stretches around these places are kept, each up to the next mark: a match ends
        # where the vocabulary of the items does.
        mark = row < 0
        run = np.cumsum(mark) - mark  # a mark belongs to the run that it ends
        wanted = np.zeros(int(run[-1]) + 1 if len(run) else 0, bool)
        wanted[run[places]] = True
        self.kept = np.flatnonzero(wanted[run]) if len(run) else places
        self.array = SuffixArray(row[self.kept], np.searchsorted(self.kept, places))

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every window (a place in ``items.starts``), all places in the row of words where it occurs."""
        items, own = self.items, self.asked
        a, b = self.array.bounds(items.row, items.starts[own], items.size[own])
        many = b - a
        each = np.repeat(np.arange(len(own)), many)
        at = a[each] + np.arange(len(each)) - (np.cumsum(many) - many)[each]
        return own[each], self.kept[self.array.order[at]]

    def longest(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Item, word in it, words that match, document and word in it, for each suffix of an item that begins a window."""
        items, own = self.items, self.asked
        best, where = self.array.longest(items.row, items.starts[own], items.left[own])
        for at, size, place in zip(items.starts[own].tolist(), best.tolist(), where.tolist(), strict=True):
            if size:
                i, place = int(items.item[at]), int(self.kept[place])
                doc = int(self.doc_of[place])
                yield i, at - int(items.first[i]), size, doc, place - int(self.begin[doc])


def _matches(shard: Shard, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Occurrences that continue each other, as one match each: document, words, first word in the document, item, first word in the item."""
    items = shard.items
    at = items.starts[window]
    item, size = items.item[at].astype(np.int64), items.size[window]
    order = np.lexsort((place, place - at, item))
    item, size, at, place = item[order], size[order], at[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (at[1:] != at[:-1] + 1)
    cut = np.flatnonzero(new)
    words = np.diff(np.append(cut, len(order))) - 1 + size[cut]
    doc = shard.doc_of[place[cut]]
    return doc, words, place[cut] - shard.begin[doc], item[cut], at[cut] - items.first[item[cut]]


def _shards(batches: Iterable[pa.RecordBatch], column: int, words_per_shard: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    held: list[pa.RecordBatch] = []
    parts: list[np.ndarray] = []
    first: list[np.ndarray] = [np.zeros(1, np.int64)]
    n = 0
    for batch in batches:
        for a, b, data, offsets in blocks(batch.column(column)):
            found = Words(data, offsets)
            held.append(batch.slice(a, b - a))
            parts.append(found.hash)
            first.append(found.first[1:] + n)
            n += len(found.hash)
            if n >= words_per_shard:
                yield held, np.concatenate(parts), np.concatenate(first)
                held, parts, first, n = [], [], [np.zeros(1, np.int64)], 0
    if held:
        yield held, np.concatenate(parts), np.concatenate(first)


#: What a pass hands to the next one: the hit words as bits, the items, and the longest match
#: (its words, the item, its first word in the item and in the document).
_STATE = "hit binary, items array<string>, words long, item string, item_word long, doc_word long"
_STATE_TYPES = (pa.binary(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64(), pa.int64())
_OUT = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "longest", "longest_item", "longest_item_word", "longest_doc_word")
_OUT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64())
_OUT_SCHEMA = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, longest long, longest_item string, longest_item_word long, longest_doc_word long"


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, words_per_shard: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """What benchmark items share with each document, one row for each row of docs.

    id_col and the columns in ``keep``, n_words, n_hit (words inside an
    occurrence of a window), n_items, items (their ids, each once, sorted as
    strings), items_sha256 (of these, comma-joined), contaminated; longest (words
    of the longest match, 0 without one), longest_item, longest_item_word and
    longest_doc_word (of several longest ones the first by document word, then
    item id, then item word).  A window is ``window`` consecutive words of an
    item; an item of fewer, but not none, is one window.  Null texts have no
    words; words inside windows of an item without an id are hit, but it is not
    listed; rows of one item id are one item; equal rows of docs each get a row;
    an empty benchmark leaves every document clean.  A very long text is a shard
    of its own.  Columns of docs that have the name of an added one are only
    returned if they are kept, beside it, so rename them then.
    """
    arrow_batches(docs.sparkSession)
    kept = list(dict.fromkeys([id_col, *keep]))
    inner = [f"k{k}" for k in range(len(kept))]
    own = ", ".join(f"k{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(kept))
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(kept, inner, strict=True)), F.col(f"`{text_col}`").cast("string").alias("scanned"))
    waiting = item_blocks(benchmark, window, item_id, item_text)
    now = next(waiting, None) or Items([], np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(1, np.int64), window)
    first = True
    while now is not None:
        after = next(waiting, None)
        sent = docs.sparkSession.sparkContext.broadcast(now)  # of ITEM_BLOCK bytes of text
        work = _pass(sent, len(inner), words_per_shard, first, after is None)
        if after is None:
            rows = rows.mapInArrow(work, f"{own}, {_OUT_SCHEMA}")
        else:
            before, rows = rows, shared.cut(rows.mapInArrow(work, f"{own}, scanned string, {_STATE}"), "passed")
            sent.destroy()
            if not first:
                shared.drop(before)
        now, first = after, False
    return rows.withColumnsRenamed(dict(zip(inner, kept, strict=True)))


def _pass(sent, n_kept: int, words_per_shard: int, first_pass: bool, last_pass: bool):
    """One block of items against all documents: rows of kept columns, text and state in; the same, or the result, out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, words, first in _shards(batches, n_kept, words_per_shard):
            items = sent.value
            n_docs = len(first) - 1
            shard = Shard(words, first, items)
            window, place = shard.occurrences()
            edge = np.zeros(len(words) + n_docs + 1, np.int64)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + items.size[window], -1)
            hit = np.cumsum(edge)[:-1] > 0
            named: list[set[str]] = [set() for _ in range(n_docs)]
            best: list[tuple] = [(0, 0, "", 0)] * n_docs  # less words, word in the document, item, word in it
            for doc, size, doc_word, item, item_word in zip(*(x.tolist() for x in _matches(shard, window, place)), strict=True):
                name = items.ids[item]
                if name is not None:
                    named[doc].add(name)
                best[doc] = min(best[doc], (-size, doc_word, name or "", item_word))
            at = 0
            for batch in held:
                to = at + batch.num_rows
                if not first_pass:
                    old = [batch.column(n_kept + 1 + k).to_pylist() for k in range(len(_STATE_TYPES))]
                    for k in range(batch.num_rows):
                        a, b = shard.begin[at + k], shard.begin[at + k] + first[at + k + 1] - first[at + k]
                        hit[a:b] |= np.unpackbits(np.frombuffer(old[0][k], np.uint8), count=b - a).astype(bool)
                        named[at + k].update(old[1][k])
                        best[at + k] = min(best[at + k], (-old[2][k], old[5][k], old[3][k], old[4][k]))
                spans = [(shard.begin[k], shard.begin[k] + first[k + 1] - first[k]) for k in range(at, to)]
                listed = [sorted(x) for x in named[at:to]]
                top = best[at:to]
                if last_pass:
                    n_hit = [int(hit[a:b].sum()) for a, b in spans]
                    found = [[n for _, n, _, _ in top], [t for _, _, t, _ in top], [w for _, _, _, w in top]]
                    values = [[int(b - a) for a, b in spans], n_hit, [len(x) for x in listed], listed, [sha256(",".join(x).encode()).hexdigest() for x in listed], [n > 0 for n in n_hit], [-n for n, *_ in top]]
                    values += [[x if n else None for x, (n, *_) in zip(f, top, strict=True)] for f in (found[1], found[2], found[0])]
                    values[7] = [t or None for t in values[7]]
                    out = [pa.array(v, t) for v, t in zip(values, _OUT_TYPES, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n_kept)), *out], [*(f"k{k}" for k in range(n_kept)), *_OUT])
                else:
                    values = [[np.packbits(hit[a:b]).tobytes() for a, b in spans], listed, [-n for n, *_ in top], [t for _, _, t, _ in top], [w for *_, w in top], [d for _, d, _, _ in top]]
                    out = [pa.array(v, t) for v, t in zip(values, _STATE_TYPES, strict=True)]
                    names = [*(f"k{k}" for k in range(n_kept)), "scanned", *(x.split()[0] for x in _STATE.split(", "))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n_kept + 1)), *out], names)
                at = to

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, words_per_shard: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The longest verbatim match of every benchmark suffix (item_id, item_word) and where it is (id_col, doc_word, n_words).

    Suffixes are those that begin a window and whose first words (three at most)
    occur somewhere.  Of equal lengths the least document wins.  A pass over the
    documents for each block of items; rows and items without an id are left out.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc is not null")
    every = None
    for items in item_blocks(benchmark, window, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names = ["item_id", "item_word", "n_words", "doc", "doc_word"]
            for held, words, first in _shards(batches, 1, words_per_shard):
                docs_of = pa.chunked_array([batch.column(0) for batch in held]).combine_chunks()
                rows = [x for x in Shard(words, first, sent.value).longest() if sent.value.ids[x[0]] is not None]
                if rows:
                    item, item_word, size, doc, word = (list(c) for c in zip(*rows, strict=True))
                    out = [pa.array([sent.value.ids[i] for i in item]), pa.array(item_word), pa.array(size), docs_of.take(pa.array(doc)), pa.array(word)]
                    yield pa.RecordBatch.from_arrays(out, names)

        found = rows.mapInArrow(run, f"item_id string, item_word long, n_words long, doc {kind}, doc_word long")
        best = shared.cut(found.groupBy("item_id", "item_word").agg(F.min(F.struct((-F.col("n_words")).alias("n"), "doc", "doc_word")).alias("b")), "longest")
        sent.destroy()
        every = best if every is None else every.unionByName(best)
    if every is None:
        return docs.sparkSession.createDataFrame([], f"item_id string, item_word long, `{id_col}` {kind}, doc_word long, n_words long")
    best = every.groupBy("item_id", "item_word").agg(F.min("b").alias("b"))
    return best.select("item_id", "item_word", F.col("b.doc").alias(id_col), "b.doc_word", (-F.col("b.n")).alias("n_words"))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that share a window with an item; the columns stay as they are, whatever their names."""
    columns = docs.columns
    inner = [f"c{k}" for k in range(len(columns))]
    own = docs.toDF(*inner)
    found = find(own, benchmark, window, id_col=inner[columns.index(id_col)], text_col=inner[columns.index(text_col)], keep=tuple(inner))
    return found.where("not contaminated").select(*inner).toDF(*columns)
