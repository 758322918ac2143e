"""Comparison of members of groups in blocks.

Members of a group are dealt to ceil(n / BLOCK) blocks; a unit of work is one block
with what it has to meet (itself, another block, some members more), so it is of
bounded size however large the group is.  A unit gives members, counts or a forest
of links, never the links themselves, so what leaves it is linear in its members
however many of them are alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def least_overlap(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> np.ndarray:
    """The least overlap that sets of these sizes need for the Jaccard threshold."""
    p, q = threshold.numerator, threshold.denominator
    return -(-p * (a + b) // (p + q))


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[k] and b[k]; the sets are sorted and without repeats."""
    if len(a) <= 4 * len(sets):
        out = np.empty(len(a), np.int64)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = sets[i], sets[j]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            out[k] = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
        return out
    # Many pairs: products of 0/1 matrices over the elements that more than one set has.
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[where] > 1
    number = np.cumsum(count > 1) - 1
    column, owner = number[where[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        x, y = np.searchsorted(column, [at, at + step])
        m = np.zeros((len(sets), step), np.float32)
        m[owner[x:y], column[x:y] - at] = 1
        total += m @ m.T
    return total[a, b].astype(np.int64)


def pairs_of(blocks: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members: all, if one block meets itself, else those of different blocks."""
    if same:
        return np.triu_indices(len(blocks), 1)
    first = blocks == blocks.min()
    a, b = np.flatnonzero(first), np.flatnonzero(~first)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def forest(n: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of n members the member of least rank that links reach from it."""
    root = np.arange(n)
    by = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[by] = np.arange(n)
    best = place.copy()
    while True:
        new = best.copy()
        np.minimum.at(new, a, best[b])
        np.minimum.at(new, b, best[a])
        new = new[by[new]] if n else new
        if (new == best).all():
            break
        best = new
    root = by[best]
    return root


def in_blocks(members: DataFrame, group: str, order: Column, least: int = 2) -> DataFrame:
    """Members of groups of ``least`` or more, with block, blocks (of the group) and is_first (whether its order is the least one)."""
    # Counts are summed before they are dealt, and groups of one block need no copies.
    count = members.groupBy(group).agg(F.count("*").alias("members"), F.min(order).alias("first_one")).where(F.col("members") >= least)
    rows = members.join(count, group).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("long"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(order), F.col("blocks"))).withColumn("is_first", order == F.col("first_one"))
    return rows.drop("members", "first_one")


def units(members: DataFrame, group: str, order: Column) -> DataFrame:
    """Each member once for every pair of blocks that its block is in: columns i, j (blocks of the unit) and block."""
    rows = in_blocks(members, group, order).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks", "is_first")


def whole_units(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of one or more whole units, and where each begins; units are runs of rows with equal first ``n_keys`` columns."""
    held: list[pa.RecordBatch] = []

    def begins(rows: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for k in range(n_keys):
            own = rows.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= own[1:] != own[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = held[-1] if held else None
        goes_on = last is not None and all(last.column(k)[-1] == batch.column(k)[0] for k in range(n_keys))
        at = int(begins(batch)[-1])
        if goes_on and at == 0:  # one unit that began before
            held.append(batch)
            continue
        if held or at:
            rows = pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks().to_batches()
            for part in rows:
                yield part, begins(part)
        held = [batch.slice(at)]
    if held:
        for part in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield part, begins(part)


def spread(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with these columns, those of a unit (equal keys) behind each other in one task."""
    return df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)


def dealt(df: DataFrame, keys: list[str], columns: list[str], work: Callable[[dict[str, list]], dict[str, np.ndarray] | None], schema: str) -> DataFrame:
    """What ``work`` makes of the lists of each unit's columns, with the unit's keys (of long) before it."""
    names = [*keys, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in whole_units(batches, len(keys)):
            values = {c: rows.column(len(keys) + k).to_pylist() for k, c in enumerate(columns)}
            of = [rows.column(k).to_numpy() for k in range(len(keys))]
            for a, b in zip(begin.tolist(), np.append(begin[1:], rows.num_rows).tolist(), strict=True):
                if b - a > 1 and (out := work({c: v[a:b] for c, v in values.items()})) is not None:
                    n = len(next(iter(out.values())))
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, k[a])) for k in of), *(pa.array(out[c]) for c in names[len(keys) :])], names)

    return spread(df, keys, columns).mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", " + schema)
