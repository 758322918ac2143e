"""Similarity join on word shingles, with candidates pruned by what their MinHash values say so far.

Documents with the same set of shingles are one class.  Classes that agree in a
band of MinHash values are candidates; with 32 bands of 4 a pair at the threshold
of 0.8 has no band in common with a probability of 5e-8.  The classes of a band
value meet in blocks, with their MinHash values only, and a pair belongs to the
first band that it shares.  Values are looked at 16 at a time, and a pair is
dropped as soon as the posterior probability (uniform prior) that its similarity
reaches the threshold falls below the tolerance.  Only members of pairs that are
left get their shingles, and the Jaccard similarity of these pairs is computed
from them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm import bloom, shared, similar
from vicinal.llm.components import components
from vicinal.llm.textcore import U, Words, arrow_batches, blocks, mix, shingles

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
_rng = np.random.default_rng(11)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | U(1)
_B = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After 16, 32, ... values, the least number of equal ones with which a pair goes on.

    With m of n values equal, the chance of equality has the posterior
    Beta(m + 1, n - m + 1); that it is t or more is a sum of binomial terms.
    """
    t = threshold + (1 - threshold) / 65536  # values of 16 bits also agree by accident
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        above = [sum(comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1)) for m in range(n + 1)]
        out.append(next(m for m in range(n + 1) if above[m] >= tolerance))
    return out


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted set of shingles of each text."""
    found, text = shingles(Words(data, offsets), width)
    cut = np.searchsorted(text, np.arange(len(offsets)))
    return [np.unique(found[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES values of 16 bits for each set that isn't empty (zeros for others)."""
    out = np.zeros((len(sets), HASHES), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    every = np.concatenate([sets[i] for i in full])
    size = np.array([len(sets[i]) for i in full])
    first = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[full, k] = (mix(np.minimum.reduceat(every * _A[k] + _B[k], first)) >> U(48)).astype(np.uint16)
    return out


def _summaries(docs: DataFrame, width: int) -> DataFrame:
    """id, row, print (of the set of shingles; null without any) and MinHash values of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(2)):
                sets = sets_of(data, offsets, width)
                values = minhash(sets)
                own = [len(s) > 0 for s in sets]
                prints = [blake2b(s.tobytes(), digest_size=16).digest() if k else None for s, k in zip(sets, own, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 1)), pa.array(prints, pa.binary()), pa.array([v.tobytes() if k else None for v, k in zip(values, own, strict=True)], pa.binary())], ["id", "row", "print", "values"])

    return docs.mapInArrow(run, "id long, row long, print binary, values binary")


def _bands(rows: DataFrame) -> DataFrame:
    """One row for each band of each class: key, band and node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(batch.num_rows, BANDS)
                key = mix(values + (np.arange(BANDS, dtype=np.uint64) << U(56)) * U(0x9E3779B1))
                band = np.tile(np.arange(BANDS, dtype=np.int16), batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(band), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "band", "node"])

    return rows.select("node", "values").mapInArrow(run, "key long, band short, node long")


def _unpruned(values: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray, floor: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of rows of values) that share no band before theirs and that the posterior doesn't drop."""
    keep = [np.zeros(0, np.int64)]
    bands = np.ascontiguousarray(values).view("<u8")
    for at in range(0, len(a), 1 << 16):
        own = np.arange(at, min(len(a), at + (1 << 16)))
        for k in range(BANDS):
            if not len(own):
                break
            own = own[(band[own] <= k) | (bands[a[own], k] != bands[b[own], k])]
        equal = np.zeros(len(own), np.int64)
        for k, least in enumerate(floor):
            part = slice(k * STEP, (k + 1) * STEP)
            equal += (values[a[own], part] == values[b[own], part]).sum(1)
            ok = equal >= least
            own, equal = own[ok], equal[ok]
        keep.append(own)
    left = np.concatenate(keep)
    return a[left], b[left]


def _met(dealt: DataFrame, floor: list[int]) -> DataFrame:
    """key, i, j, band, block and node of the members of units (key, i, j) that are in a pair that isn't pruned."""
    names = ["key", "i", "j", "band", "block", "node"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in similar.whole_units(batches, 3):
            n = rows.num_rows
            unit = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
            end = np.append(begin[1:], n)[unit]
            i, j, band, block = (rows.column(k).to_numpy() for k in range(1, 5))
            values = np.frombuffer(b"".join(rows.column(6).to_pylist()), "<u2").reshape(n, HASHES)
            many = end - 1 - np.arange(n)  # each row meets those behind it in its unit
            found = np.zeros(n, bool)
            at = 0
            sums = np.cumsum(many)
            while at < n:
                to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + (1 << 18), "right")))
                a = np.repeat(np.arange(at, to), many[at:to])
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to])
                ok = (i[a] == j[a]) | (block[a] != block[b])
                a, b = _unpruned(values, a[ok], b[ok], band[a[ok]], floor)
                found[a] = found[b] = True
                at = to
            if found.any():
                yield pa.RecordBatch.from_arrays([rows.column(k) for k in range(6)], names).filter(pa.array(found))

    return similar.spread(dealt, ["key", "i", "j"], ["band", "block", "node", "values"]).mapInArrow(run, "key long, i long, j long, band short, block long, node long")


def _sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, print and set of the rows whose id is wanted (where a filter of fixed size can hold these ids, else of all)."""
    n = wanted.count()
    sent = rows.sparkSession.sparkContext.broadcast(bloom.build(wanted, F.xxhash64("id"), n)) if n <= bloom.MOST_KEYS else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent:
                batch = batch.filter(pa.array(sent.value.contains(batch.column(2).to_numpy())))
            for a, b, data, offsets in blocks(batch.column(1)):
                raw = [s.tobytes() for s in sets_of(data, offsets, width)]
                prints = [blake2b(s, digest_size=16).digest() if s else None for s in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(prints, pa.binary()), pa.array(raw, pa.binary())], ["id", "print", "set"])

    return rows.withColumn("hash", F.xxhash64("id")).mapInArrow(run, "id long, print binary, set binary")


def _classes(docs: DataFrame, width: int, threshold: float, tolerance: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """id, row (a hash of the text) and print of every row; and id, print, class_id, n_links and copy_id of every document (id and print, not null)."""
    arrow_batches(docs.sparkSession)
    exact = Fraction(str(threshold))
    floor = least_matches(threshold, tolerance)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(shared.integer_id(docs, id_col).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    table = shared.cut(_summaries(rows, width), "minhash")
    # Texts without words have no print; they take no part in the join, where they would meet in one task.
    once = table.where("id is not null and print is not null").groupBy("id", "print").agg(F.first("values").alias("values"))
    # An id stands for its document, but where it has several different ones.
    several = once.groupBy("id").agg(F.min("print").alias("a"), F.max("print").alias("z")).where("a <> z").select("id", F.lit(True).alias("several"))
    once = shared.cut(once.join(several, "id", "left").select("id", "print", "values", F.when(F.col("several"), F.xxhash64("id", "print")).otherwise(F.col("id")).alias("node")), "once")
    classes = once.groupBy("print").agg(F.min(F.struct("id", "node")).alias("rep"), F.count("*").alias("size")).select("print", "rep.node", "size")
    reps = shared.cut(once.join(classes, ["print", "node"]), "classes")

    # Who meets whom is settled before the shingles are fetched, so these move but twice.
    met = shared.cut(_met(similar.units(_bands(reps), "key", F.col("node")).join(reps.select("node", "values"), "node"), floor), "met")
    members = met.join(reps, "node")
    members = members.join(_sets(rows.where("id is not null").select("id", "text"), reps.join(met.select("node").distinct(), "node").select("id"), width), ["id", "print"])

    def work(held: dict[str, list]) -> dict[str, np.ndarray] | None:
        once = np.unique(np.array(held["node"], np.int64), return_index=True)[1]  # rows equal in id and text come several times
        nodes, ids, weight, block, band = (np.array(held[c], np.int64)[once] for c in ("node", "id", "size", "block", "band"))
        own = [np.frombuffer(held["set"][k], "<u8") for k in once.tolist()]
        values = np.frombuffer(b"".join([held["values"][k] for k in once.tolist()]), "<u2").reshape(len(ids), HASHES)
        size = np.array([len(s) for s in own])
        a, b = similar.pairs_of(block, held["same"][0])
        short, long = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        ok = short * exact.denominator >= long * exact.numerator
        a, b = _unpruned(values, a[ok], b[ok], band[a[ok]], floor)
        if not len(a):
            return None
        ok = similar.overlaps(own, a, b) >= similar.least_overlap(size[a], size[b], exact)
        a, b = a[ok], b[ok]
        if not len(a):
            return None
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        root = similar.forest(len(ids), a, b, ids)
        has = links > 0
        return {"node": nodes[has], "links": links[has], "root": nodes[root[has]]}

    columns = ["same", "band", "block", "node", "id", "size", "values", "set"]
    linked = similar.dealt(members.withColumn("same", F.col("i") == F.col("j")), ["key", "i", "j"], columns, work, "node long, links long, root long")
    linked = shared.cut(linked.select("node", "links", "root"), "linked")
    shared.drop(met)
    joined = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = linked.groupBy("node").agg(F.sum("links").alias("links")).join(joined, "node", "left").select("node", "links", F.coalesce("root", "node").alias("root"))
    nodes = nodes.join(reps.select("node", "id"), "node")
    nodes = nodes.join(nodes.groupBy("root").agg(F.min("id").alias("class_id")), "root").select("node", "links", "class_id")
    of_print = reps.select("print", "node", F.col("id").alias("copy_id"), "size").join(nodes, "node", "left")
    found = once.select("id", "print").join(of_print, "print")
    found = found.select("id", "print", F.coalesce("class_id", "copy_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "copy_id")
    return table.select("id", "row", "print"), found


def join(docs: DataFrame, width: int = 5, threshold: float = 0.8, tolerance: float = 1e-8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, class_id, n_links, copy_id.

    Two documents are linked if the Jaccard similarity of their sets of word
    shingles (``width`` words; all words of a shorter text) is ``threshold`` or
    more.  n_links counts the linked documents, copies too; copy_id is the least
    id with the same set, class_id the least id that links reach.  Texts without
    words and null texts are linked to nothing.  Rows of one id with the same set, or
    without words, are one document; those with different sets are different ones,
    which each have a row and their links.  Rows with a null id get a row each, with
    nulls and no links.  id_col has to be of an integer type.  An empty table gives
    no rows; a very long text is worked on alone; other columns are not read,
    whatever their names.
    """
    rows, found = _classes(docs, width, threshold, tolerance, id_col, text_col)
    columns = [F.col("id").alias(id_col), "class_id", "n_links", "copy_id"]
    null, zero = F.lit(None).cast("long"), F.lit(0).cast("long").alias("n_links")
    alone = rows.where("id is not null and print is null").select("id").distinct().select("id", F.col("id").alias("class_id"), zero, F.col("id").alias("copy_id"))
    return found.select(*columns).unionByName(alone.select(*columns)).unionByName(rows.where("id is null").select("id", null.alias("class_id"), zero, null.alias("copy_id")).select(*columns))


def one_of_each(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, that of the least id; texts without words and rows without an id stay.

    Of different texts of that id the one whose hash is least stays; rows equal in
    id and text stay or go together.  Columns may have any names.
    """
    rows, found = _classes(docs, width, threshold, 1e-8, id_col, text_col)
    rows = rows.where("print is not null").join(found.select("id", "print", "class_id"), ["id", "print"]).select("id", "row", "class_id")
    first = rows.where("id = class_id").groupBy("id").agg(F.min("row").alias("least"))
    gone = rows.join(first, "id", "left").where("id <> class_id or row <> least").select("id", "row").distinct()
    inner = [f"k{k}" for k in range(len(docs.columns))]
    text = F.col(f"`{text_col}`").cast("string")
    left = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, inner, strict=True)), shared.integer_id(docs, id_col).alias("id"), F.xxhash64(text).alias("row"))
    return left.join(gone, ["id", "row"], "left_anti").select(*inner).toDF(*docs.columns)
