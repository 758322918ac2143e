"""Line dedup by an exact set-similarity join.

The tokens of a line are its runs of ``width`` words.  They are ordered by how
rare they are in all documents (by a table of counts; ties by hash), and only the
first ones, so many that two lines above the threshold must have one in common,
are dealt out (prefix filter).  Lines that meet at a token and whose sizes and
places of the token allow the threshold (length and positional filters) form a
run; tokens with the same lines make one run.  Inside each run the Jaccard
similarity is computed from the tokens themselves.  A line goes if a line before
it (by document id, then a hash of the row, then line number) is similar.

Lines travel packed: a map task writes the entries of a batch that go to one bin
of tokens as one row, so the shuffle moves some ten bytes an entry.  Of equal lines
a map task sends on the first only.  Tokens so frequent that a bin could not hold
them meet in no bin: their lines form runs by size, which are cut like all runs.
Long runs are cut into blocks.  Lines are compared in their block and with the
first line of the run, which settles heaps of near copies; only lines that are
like neither go on to the other blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm import bloom, shared, similar
from vicinal.llm.textcore import U, Words, arrow_batches, blocks, mix, shingles

#: Places of the table of counts: one for some thousand tokens, but so many at least and at most.
RARITY, MOST_RARITY = 1 << 16, 1 << 24
#: Codes (see ``rarity``) from which a token is too frequent for one bin: 4 million occurrences.
HOT = 8 * 22
#: Bytes of input that a bin of entries stands for.
BIN = 4 << 20
#: Lines that a map task remembers, as a power of two.
RECENT = 18
NULL = np.iinfo(np.int64).min
#: Runs of so many lines at most are looked at pair by pair before their tokens are fetched.
SMALL = 32


def node_of(doc: np.ndarray, row: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of a line's place.  Two places of one hash would only share a group, where the tokens decide."""
    with np.errstate(over="ignore"):
        return mix(mix(mix(doc.view(np.uint64)) ^ row.view(np.uint64)) + line.astype(np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """doc (the id; the least integer for null), row (a hash of the text, another one without an id) and text: what tells rows apart."""
    i, text = shared.integer_id(docs, id_col), F.col(f"`{text_col}`").cast("string")
    return F.coalesce(i, F.lit(int(NULL))).alias("doc"), F.xxhash64(text, i.isNull()).alias("row"), text.alias("text")


class Lines:
    """The lines of texts: ``doc`` (index of the text), ``number`` in it, and their tokens with the line of each.

    asked: says of the lines, by their ``doc`` and ``number``, which ones are wanted;
    only those have tokens then.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, whole: bool = False, asked: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        breaks = np.flatnonzero(data == 10) + 1
        begin = np.concatenate([offsets[:-1], breaks])
        owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks - 1, "right") - 1])
        order = np.lexsort((begin, owner))
        begin, self.doc = begin[order], owner[order]
        first = np.searchsorted(self.doc, np.arange(len(offsets) - 1))
        self.number = np.arange(len(begin)) - first[self.doc]
        cuts = np.append(begin, len(data))
        if asked is None:
            self.token, self.line = shingles(Words(data, cuts), width, whole)
            return
        hit = asked(self.doc, self.number)
        size = np.diff(cuts)
        of = np.flatnonzero(hit)
        self.token, line = shingles(Words(data[np.repeat(hit, size)], np.concatenate([[0], np.cumsum(size[of])])), width, whole) if len(of) else (np.zeros(0, np.uint64), of)
        self.line = of[line]


def _place(token: np.ndarray, places: int) -> np.ndarray:
    """The place of each token in a table of a power of two of places."""
    return (token >> U(65 - places.bit_length())).astype(np.int64)


def _ranked(lines: Lines, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all lines without repeats, rare ones first: key, line, place in the line, the size of each line, and the tokens.

    A key is the rarity (8 bits) and 40 bits of the hash: the order of keys is the
    order of tokens, and keys are equal for equal tokens.
    """
    key = codes[_place(lines.token, len(codes))].astype(np.uint64) << U(40) | (lines.token & U((1 << 40) - 1))
    # Keys have 48 bits, so with fewer lines than 65,536 one number has both.
    order = np.argsort(lines.line.astype(np.uint64) << U(48) | key) if len(lines.doc) < 1 << 16 else np.lexsort((key, lines.line))
    key, line, token = key[order], lines.line[order], lines.token[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    key, line, token = key[new], line[new], token[new]
    size = np.bincount(line, minlength=len(lines.doc))
    place = np.arange(len(line)) - (np.cumsum(size) - size)[line]
    return key, line, place, size, token


def _prints(token: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """A hash of the set of tokens of each line, 64 bits of 64-bit tokens: it alone says that two lines are equal."""
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(out, line, mix(token + U(0x51ED270B)))
    return out


def _pack(columns: list[np.ndarray], types: tuple[str, ...]) -> bytes:
    """Arrays of equal length, byte planes after one another, which compress well."""
    return len(columns[0]).to_bytes(4, "little") + b"".join(np.ascontiguousarray(c.astype(t)).view(np.uint8).reshape(len(c), -1).T.tobytes() for c, t in zip(columns, types, strict=True))


#: Key, document, row, line, print, size and place of an entry; lines that go have but document, row and line, members of a run its name before.
_TYPES = ("<u8", "<i8", "<i8", "<u4", "<u8", "<u4", "<u4")
_GONE = _TYPES[1:4]
_MEMBER = _TYPES[:4]
_ENTRY_OF, _GONE_OF, _MEMBER_OF = range(3)


def _unpack(raw: bytes, types: tuple[str, ...]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for t in types:
        w = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T).view(t).ravel())
        at += n * w
    return out


def rarity(rows: DataFrame, width: int, size: int, whole: bool = False) -> np.ndarray:
    """For each place of the table a code that grows with the logarithm of the tokens counted there, over all documents; size: bytes of their texts."""
    places = RARITY
    while places < MOST_RARITY and places << 13 < size:
        places <<= 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(places, np.int32)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                own, n = np.unique(_place(Lines(data, offsets, width, whole).token, places), return_counts=True)
                total[own] += n.astype(np.int32)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["place", "n"])

    counted = rows.select("text").mapInArrow(run, "place int, n int").groupBy("place").agg(F.sum("n").alias("n"))
    code = F.least(F.lit(255), F.floor(8 * F.log2(1 + F.col("n")))).cast("short")
    table = counted.select("place", code.alias("code")).toArrow()  # MOST_RARITY rows at most
    codes = np.zeros(places, np.uint8)
    codes[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return codes


class Recent:
    """Lines that a map task has sent on, by print, in a table of fixed size."""

    def __init__(self) -> None:
        n = 1 << RECENT
        self.prints, self.doc, self.row, self.line = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)

    def later(self, prints: np.ndarray, doc: np.ndarray, row: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Which of these lines, all different, stand behind an equal one that was sent; the others are sent now."""
        slot = (prints >> U(64 - RECENT)).astype(np.int64)
        d, r, n = self.doc[slot], self.row[slot], self.line[slot]
        known = (self.prints[slot] == prints) & (n >= 0)
        gone = known & ((d < doc) | (d == doc) & ((r < row) | (r == row) & (n < line)))
        new = np.flatnonzero(~gone)
        self.prints[slot[new]], self.doc[slot[new]], self.row[slot[new]], self.line[slot[new]] = prints[new], doc[new], row[new], line[new]
        return gone


def _entries(rows: DataFrame, codes: np.ndarray, width: int, threshold: Fraction, bins: int, whole: bool = False) -> DataFrame:
    """bin, kind and packed: entries of prefixes, lines that go as an equal one stands before them in the task, and members of runs of very frequent tokens."""
    sent = rows.sparkSession.sparkContext.broadcast(codes)  # MOST_RARITY bytes at most
    # Classes of sizes: each ends where the least one's partners do, so partners are in the same or the next one.
    ends, size_of_class = [], Fraction(1)
    while threshold < 1 and size_of_class < 1 << 40:
        size_of_class /= threshold
        ends.append(ceil(size_of_class))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            ids, rests = (batch.column(k).to_numpy() for k in (1, 2))
            for a, _, data, offsets in blocks(batch.column(0)):
                lines = Lines(data, offsets, width, whole)
                key, line, place, size, token = _ranked(lines, sent.value)
                if not len(key):
                    continue
                doc, row, number = ids[a + lines.doc], rests[a + lines.doc], lines.number
                prints = _prints(token, line, len(size))
                full = np.flatnonzero(size)
                by = full[np.lexsort((number[full], row[full], doc[full], prints[full]))]
                same = np.zeros(len(by), bool)
                same[1:] = prints[by][1:] == prints[by][:-1]
                head = by[np.maximum.accumulate(np.where(~same, np.arange(len(by)), 0))]
                later = same & ((doc[by] != doc[head]) | (row[by] != row[head]) | (number[by] != number[head]))
                own = by[~same]
                known = recent.later(prints[own], doc[own], row[own], number[own])
                gone = np.concatenate([by[later], own[known]])
                out_bin, out_kind, out = [], [], []

                def put(where: int, kind: int, columns: list[np.ndarray], types: tuple[str, ...], out_bin=out_bin, out_kind=out_kind, out=out) -> None:
                    out_bin.append(where)
                    out_kind.append(kind)
                    out.append(_pack(columns, types))

                if len(gone):
                    put(int(prints[gone[0]] % U(bins)), _GONE_OF, [doc[gone], row[gone], number[gone]], _GONE)
                stays = np.zeros(len(size), bool)
                stays[own[~known]] = True
                prefix = size - (-(-threshold.numerator * size // threshold.denominator)) + 1
                use = np.flatnonzero(stays[line] & (place < prefix[line]))
                hot = key[use] >= U(HOT << 40)
                if hot.any():
                    # Lines of similar sizes meet in one of two neighbouring classes of sizes.
                    k, ln = key[use[hot]], line[use[hot]]
                    size_class = np.searchsorted(ends, size[ln], "right").astype(np.uint64)
                    with np.errstate(over="ignore"):
                        names = np.concatenate([mix(mix(k) + size_class + U(j)) for j in (0, 1)])
                    twice = np.concatenate([ln, ln])
                    put(int(prints[ln[0]] % U(bins)), _MEMBER_OF, [names, doc[twice], row[twice], number[twice]], _MEMBER)
                    # Lines whose rarest token is that frequent meet equal ones by their prints.
                    alone = use[hot & (place[use] == 0)]
                    use, extra = use[~hot], alone
                else:
                    extra = use[:0]
                every = np.concatenate([use, extra])
                k = np.concatenate([key[use], prints[line[extra]] | U(1 << 63)])
                ln, p = line[every], place[every]
                where = (mix(k) % U(bins)).astype(np.int64)
                order = np.lexsort((k, where))
                cut = np.flatnonzero(np.diff(where[order], prepend=-1))
                for x, y in zip(cut.tolist(), np.append(cut[1:], len(order)).tolist(), strict=True):
                    o = order[x:y]
                    put(int(where[o[0]]), _ENTRY_OF, [k[o], doc[ln[o]], row[ln[o]], number[ln[o]], prints[ln[o]], size[ln[o]], p[o]], _TYPES)
                yield pa.RecordBatch.from_arrays([pa.array(out_bin, pa.int64()), pa.array(out_kind, pa.int8()), pa.array(out, pa.binary())], ["bin", "kind", "packed"])

    return rows.select("text", "doc", "row").mapInArrow(run, "bin long, kind byte, packed binary")


_MET = "gone boolean, run long, node long, doc long, row long, line long"


def _met(entries: DataFrame, threshold: Fraction) -> DataFrame:
    """gone, run, node, doc, row, line: lines that go because an equal one stands before them, and runs of lines that meet at a token.

    Equal lines meet at all tokens of their prefixes, with equal size, place and
    print.  All but the first go, which is said where their first token is; the first
    alone meets lines that differ.
    """
    p, q = threshold.numerator, threshold.denominator
    names = [x.split()[0] for x in _MET.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for b, kind, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if kind == _GONE_OF:
                    yield said(*_unpack(raw, _GONE))
                elif kind == _MEMBER_OF:
                    name, doc, row, line = _unpack(raw, _MEMBER)
                    yield members(name.view(np.int64), doc, row, line)
                else:
                    if b != at:
                        yield from meet(held)
                        held, at = [], b
                    held.append(raw)
        yield from meet(held)

    def said(doc: np.ndarray, row: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
        zero = pa.array(np.zeros(len(doc), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(doc), bool)), zero, zero, pa.array(doc), pa.array(row), pa.array(line.astype(np.int64))], names)

    def members(name: np.ndarray, doc: np.ndarray, row: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
        out = [name, node_of(doc, row, line), doc, row, line.astype(np.int64)]
        keep = np.unique(np.stack(out[:2]), axis=1, return_index=True)[1]
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keep), bool)), *(pa.array(c[keep]) for c in out)], names)

    def meet(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        columns = [np.concatenate(c) for c in zip(*(_unpack(x, _TYPES) for x in held), strict=True)]
        by = np.argsort(columns[0], kind="stable")
        key = columns[0][by]
        many = np.zeros(len(key), bool)
        many[1:] = key[1:] == key[:-1]
        many[:-1] |= many[1:]
        key, doc, row, line, prints, size, place = (c[by[many]] for c in columns)
        order = np.lexsort((line, row, doc, prints, place, size, key))
        key, doc, row, line, prints, size, place = (c[order] for c in (key, doc, row, line, prints, size.astype(np.int64), place.astype(np.int64)))
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (size[1:] == size[:-1]) & (place[1:] == place[:-1]) & (prints[1:] == prints[:-1])
        if same.any():
            head = np.maximum.accumulate(np.where(~same, np.arange(len(key)), 0))
            go = np.flatnonzero(same & (place == 0) & ((doc != doc[head]) | (row != row[head]) | (line != line[head])))
            if len(go):
                yield said(doc[go], row[go], line[go])
            key, doc, row, line, size, place = (c[~same] for c in (key, doc, row, line, size, place))
        by_print = key >> U(63) == 1  # these were for equal lines alone
        if by_print.any():
            key, doc, row, line, size, place = (c[~by_print] for c in (key, doc, row, line, size, place))
        if not len(key):
            return
        group = np.cumsum(np.diff(key, prepend=key[0]) != 0)
        # Sizes are in order: similar lines of a token stand in one run of neighbours that pass
        # the length filter.  Positional filter: where a token is the first one that two lines
        # share, the rest of both must allow the overlap; later shared tokens need not link
        # them again.  Of two lines the shorter one's rest decides, so a place beyond what the
        # best partner would allow drops the entry, and neighbours are tried as pairs.
        runs = np.cumsum((np.diff(group, prepend=group[0]) != 0) | np.concatenate([[False], size[:-1] * q < size[1:] * p]))
        number = np.bincount(runs)
        first = np.cumsum(number) - number
        ok = np.zeros(len(key), bool)
        for step in range(1, SMALL):
            i = np.flatnonzero((number[runs] <= SMALL) & (np.arange(len(key)) - first[runs] >= step))
            if not len(i):
                break
            j = i - step
            near = (size[j] * q >= size[i] * p) & (np.minimum(size[i] - place[i], size[j] - place[j]) >= similar.least_overlap(size[i], size[j], threshold))
            ok[i[near]] = ok[j[near]] = True
        big = number[runs] > SMALL
        ok[big] = size[big] - place[big] >= similar.least_overlap(size[big], -(-p * size[big] // q), threshold)
        runs, doc, row, line = runs[ok], doc[ok], row[ok], line[ok]
        if not len(runs):
            return
        # Tokens with the same lines make one run.
        with np.errstate(over="ignore"):
            name = np.zeros(int(runs[-1]) + 1, np.uint64)
            np.add.at(name, runs, mix(node_of(doc, row, line).view(np.uint64) ^ U(0x5851F42D4C957F2D)))
        yield members(name[runs].view(np.int64), doc, row, line)

    dealt = entries.repartition("bin").sortWithinPartitions("bin")
    return dealt.mapInArrow(run, _MET)


def _sets(rows: DataFrame, wanted: DataFrame, width: int, whole: bool = False) -> DataFrame:
    """node and set of tokens of the lines of ``wanted`` (by node; where a filter of fixed size can hold them, else of all)."""
    n = wanted.count()
    sent = rows.sparkSession.sparkContext.broadcast(bloom.build(wanted, F.col("node"), n)) if n <= bloom.MOST_KEYS else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rests = (batch.column(k).to_numpy() for k in (1, 2))
            for a, _, data, offsets in blocks(batch.column(0)):
                named = lambda doc, number, a=a, ids=ids, rests=rests: node_of(ids[a + doc], rests[a + doc], number)
                # A line's place says whether it is wanted, so the words of the others aren't looked at.
                lines = Lines(data, offsets, width, whole, (lambda doc, number, named=named: sent.value.contains(named(doc, number))) if sent else None)
                node = named(lines.doc, lines.number)
                cut = np.searchsorted(lines.line, np.arange(len(node) + 1))
                hit = np.flatnonzero(cut[1:] > cut[:-1])
                if not len(hit):
                    continue
                sets = [np.unique(lines.token[cut[x] : cut[x + 1]]).tobytes() for x in hit.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(sets, pa.binary())], ["node", "set"])

    # Rows that are equal in id and text give a line several times; its set is the same.
    return rows.select("text", "doc", "row").mapInArrow(run, "node long, set binary")


def repeats(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """doc, row and line (from 0) of every line that has a similar one before it, by document id (null first), row, then line.

    row is a hash of the text, so rows of one id, or none, are told apart, and rows
    equal in id and text are one.  Lines of fewer than ``width`` words have one run
    of all their words, or without ``whole`` are never similar to others.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    exact = Fraction(str(threshold))
    rows = docs.select(*_keyed(docs, id_col, text_col)).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    met = shared.cut(_met(_entries(rows, rarity(rows, width, size, whole), width, exact, max(64, size // BIN), whole), exact), "met")

    runs = met.where("not gone").select("run", "node", "doc", "row", "line").distinct()
    # Who meets whom is settled before the tokens are fetched, so these move but twice.
    order = F.struct("doc", "row", "line")
    met_in = shared.cut(similar.in_blocks(runs, "run", order), "units")
    sets = _sets(rows, met_in.select("node").distinct(), width, whole)
    place = ["doc", "row", "line"]
    columns = ["part", "blocks", "node", *place, "set"]

    def sorted_once(held: dict[str, list]) -> dict[str, np.ndarray | list]:
        """Members in order, each once: rows equal in id and text give a line several times."""
        every = [np.array(held[c], np.int64) for c in place]
        by = np.lexsort((np.array(held["part"]), *every[::-1]))
        new = np.ones(len(by), bool)
        new[1:] = np.any([c[by][1:] != c[by][:-1] for c in every], axis=0)
        by = by[new]
        out: dict[str, np.ndarray | list] = {c: np.array(held[c], np.int64)[by] for c in columns[:-1]}
        return out | {"set": [np.frombuffer(held["set"][k], "<u8") for k in by.tolist()]}

    def alike(own: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Those of b that are similar to their a."""
        size = np.array([len(x) for x in own])
        short, long = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        ok = short * exact.denominator >= long * exact.numerator
        a, b = a[ok], b[ok]
        return b[similar.overlaps(own, a, b) >= similar.least_overlap(size[a], size[b], exact)] if len(a) else b

    def inside(held: dict[str, list]) -> dict[str, np.ndarray] | None:
        """One block and the first line of its run (part 1, if it isn't in the block): lines that go, and where the run has other blocks those that are still open."""
        unit = sorted_once(held)
        own, n = unit["set"], len(unit["set"])
        gone = np.zeros(n, bool)
        # Each line against the first one before all pairs: heaps of near copies end there.
        gone[alike(own, np.zeros(n - 1, np.int64), np.arange(1, n))] = True
        later = np.flatnonzero(~gone)[1:]
        later = later[later > 1]
        if len(later):
            gone[alike(own, np.concatenate([np.arange(1, x) for x in later.tolist()]), np.repeat(later, later - 1))] = True
        said = np.flatnonzero((unit["part"] == 0) & (gone | (unit["blocks"] > 1)))
        return {c: unit[c][said] for c in ("node", *place)} | {"gone": gone[said]} if len(said) else None

    def across(held: dict[str, list]) -> dict[str, np.ndarray] | None:
        """Open lines (part 1) against a block (part 0)."""
        unit = sorted_once(held)
        a, b = np.flatnonzero(unit["part"] == 0), np.flatnonzero(unit["part"] == 1)
        i, j = np.nonzero(a[:, None] < b[None, :])
        gone = np.unique(alike(unit["set"], a[i], b[j])) if len(i) else i
        return {c: unit[c][gone] for c in place} if len(gone) else None

    # The first line of a run goes to every block but its own.
    zero = F.lit(0).cast("long")
    others = F.explode(F.sequence(zero, F.col("blocks") - 1))
    first = met_in.where("is_first and blocks > 1").select("run", "blocks", "node", *place, F.col("block").alias("own"), others.alias("block")).where("block <> own")
    parts = ["run", "block", "part", "blocks", "node", *place]
    placed = met_in.withColumn("part", zero).select(*parts).unionByName(first.withColumn("part", F.lit(1).cast("long")).select(*parts))
    checked = shared.cut(similar.dealt(placed.join(sets, "node"), ["run", "block"], columns, inside, "node long, doc long, row long, line long, gone boolean"), "checked")
    close = checked.where("gone").select(*place)

    # Lines that are like none in their block, nor the first of the run, meet the other blocks, BLOCK of them at a time.
    sizes = met_in.where("is_first and blocks > 1").select("run", "blocks")
    left = checked.where("not gone").join(sizes, "run").join(close.distinct(), place, "left_anti").select("run", "node", *place, F.col("block").alias("own"), F.col("blocks").alias("of"))
    if not left.isEmpty():
        left = shared.cut(similar.in_blocks(left, "run", order, 1).withColumnsRenamed({"block": "asked", "blocks": "many"}), "open")
        asked = left.withColumn("blocks", F.col("of")).select("run", "asked", "own", "blocks", "node", *place, others.alias("block")).where("block <> own").withColumn("part", F.lit(1).cast("long"))
        groups = left.where("is_first").select("run", F.explode(F.sequence(zero, F.col("many") - 1)).alias("asked"))
        both = met_in.join(groups, "run").withColumn("part", zero).select("asked", *parts).unionByName(asked.select("asked", *parts))
        far = similar.dealt(both.join(sets, "node"), ["run", "asked", "block"], columns, across, "doc long, row long, line long")
        close = close.unionByName(shared.cut(far.select(*place), "far"))
        shared.drop(left)
    shared.drop(met_in)
    return met.where("gone").select(*place).unionByName(close)


def remove(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """docs with text_col without its repeated lines, and n_lines, n_removed after its other columns.

    A line is what stands between line ends; it goes if a line before it, in order
    of id_col (null first), row and line, has a set of ``width``-word runs with a
    Jaccard similarity of ``threshold`` or more.  Shorter lines of 1 word or more
    have one run of all their words; without ``whole`` they stay.  Null texts stay
    null and have no lines; lines without words stay.  Rows of one id, or without
    one, are told apart by a hash of their texts, which also orders them; rows equal
    in id and text are one row, whose lines go from each of them.  id_col has to be
    of an integer type.  An empty table gives no rows; a very long text or line is
    worked on alone; columns named like the two that are added are replaced, others
    may have any name.
    """
    arrow_batches(docs.sparkSession)
    gone = repeats(docs, width, threshold, id_col, text_col, whole)
    gone = gone.groupBy("doc", "row").agg(F.collect_set("line").alias("lines"))  # as many as one document has
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    at = columns.index(text_col)
    inner = [f"k{k}" for k in range(len(columns))]
    doc, row, _ = _keyed(docs, id_col, text_col)
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(columns, inner, strict=True)), doc, row)
    rows = rows.join(gone, ["doc", "row"], "left").select(*inner, "lines")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for text, lines in zip(batch.column(at).to_pylist(), batch.column(len(inner)).to_pylist(), strict=True):
                parts = [] if text is None else text.split("\n")
                n_lines.append(len(parts))
                if lines and text is not None:
                    drop = set(lines)
                    kept = [x for k, x in enumerate(parts) if k not in drop]
                    n_removed.append(len(parts) - len(kept))
                    text = "\n".join(kept)
                else:
                    n_removed.append(0)
                texts.append(text)
            out = [batch.column(k) if k != at else pa.array(texts, pa.string()) for k in range(len(inner))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*inner, "n_lines", "n_removed"])

    schema = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(columns, inner, strict=True)) + ", n_lines long, n_removed long"
    return rows.mapInArrow(run, schema).toDF(*columns, "n_lines", "n_removed")
