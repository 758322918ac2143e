"""Exact search among many references of few places: a tree deals them into boxes, and a query meets only boxes that can hold a neighbour."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal import storage
from vicinal.operators import knn

#: Rows of a leaf that the tree aims at, and leaves at most (beyond them leaves grow).
LEAF, MOST_LEAVES = 2048, 1 << 14
#: Rows of references that the tree is fitted on; all rows are dealt by it.
SAMPLE = 200_000
#: Rows of one unit, about: a leaf of more, which copies make, is cut.  Queries that one unit of work has, about.
UNIT, ASKED = 65536, 4096
#: Places beyond which boxes leave out next to nothing.
MOST_PLACES = 24
#: Rows of a leaf of the tree inside a unit, where every row is asked about.
INNER = 128


@dataclass
class Tree:
    """Inner nodes: rows whose place ``dim`` is at most ``cut`` go left.  A negative child -1 - n is leaf n; leaves are numbered from left to right."""

    dim: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    size: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64) if len(self.dim) else np.full(len(x), -1)
        while len(inner := np.flatnonzero(node >= 0)):
            at = node[inner]
            node[inner] = self.child[at, np.where(x[inner, self.dim[at]] <= self.cut[at], 0, 1)]
        return -1 - node


def fitted(x: np.ndarray, least: float) -> Tree:
    """A tree whose leaves have about ``least`` rows of x or less; more only where all are equal."""
    dim, cut, child, size = [], [], [], []

    def grow(own: np.ndarray) -> int:
        low, high = own.min(0), own.max(0)
        # The place of the widest spread that has two values.
        d = int(np.argmax(own.std(0) * (high > low))) if len(own) > least else 0
        if len(own) <= least or not high[d] > low[d]:
            size.append(len(own))
            return -len(size)
        at = np.median(own[:, d])
        at = at if at < high[d] else own[own[:, d] < high[d], d].max()
        left = own[:, d] <= at
        dim.append(d)
        cut.append(at)
        child.append(None)
        n = len(dim) - 1
        child[n] = (grow(own[left]), grow(own[~left]))
        return n

    if len(x):
        grow(x)
    else:
        size.append(0)
    return Tree(np.array(dim, np.int64), np.array(cut), np.array(child, np.int64).reshape(-1, 2), np.array(size))


@dataclass
class Boxes:
    """Units (unit, n, ids, labels, vectors: bytes) of all references, with the tree that dealt them and the bounds of each.

    start: the first unit of each leaf, and behind the last one the number of units.
    A unit keeps the ``k`` least ids of equal vectors, as no others can be among k neighbours.
    """

    units: DataFrame
    tree: Tree
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int

    def bounds(self, low: np.ndarray, high: np.ndarray, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The least squared distance of each box low to high from each unit; never above one that is summed place by place, as rounding keeps order."""
        out = np.zeros((len(low), len(self.low[of])))
        for d in range(low.shape[1]):
            gap = np.maximum(self.low[of][None, :, d] - high[:, d, None], low[:, d, None] - self.high[of][None, :, d])
            out += np.maximum(gap, 0.0) ** 2
        return out

    def near(self, q: np.ndarray, limit: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries, and units from ``first`` to before ``last`` that may hold rows within each query's limit."""
        some = first + np.flatnonzero(self.bounds(np.fmin.reduce(q, 0)[None], np.fmax.reduce(q, 0)[None], slice(first, last))[0] <= limit.max())
        i, j = np.nonzero(self.bounds(q, q, some) <= limit[:, None])
        return i, some[j]

    def blocks(self, size: int) -> Iterator[tuple[int, int, dict[int, tuple[bytes, bytes, bytes]]]]:
        """First unit, the one behind the last, and the bytes of units between them: all units in order, some ``size`` bytes at a time."""
        each = F.length("ids") + F.length("labels") + F.length("vectors")
        total = self.units.agg(F.sum(each)).first()[0] or 0
        first, held, block = 0, 0, {}
        # The driver has one partition at a time, which is of some ``size`` bytes too.
        for r in self.units.repartitionByRange(max(1, -(-total // size)), "unit").sortWithinPartitions("unit").toLocalIterator():
            block[r["unit"]] = own = tuple(bytes(r[c]) for c in ("ids", "labels", "vectors"))
            held += sum(map(len, own))
            if held >= size:
                yield first, r["unit"] + 1, block
                first, held, block = r["unit"] + 1, 0, {}
        if block:
            yield first, max(block) + 1, block


_UNITS = "unit int, n long, low array<double>, high array<double>, ids binary, labels binary, vectors binary"


def counted(q: np.ndarray, whole: Boxes, blocks: Iterable[tuple[int, int, Callable[[], dict]]], k: int) -> np.ndarray:
    """The labels' sum of the k nearest references of each row of q.  blocks: bounds of each, and what loads it; one is held at a time."""
    order = np.argsort(own := whole.start[whole.tree.leaf(q)], kind="stable")  # near ones together
    q, own = q[order], own[order]
    limit = np.full(len(q), np.inf)
    rows = tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64))
    for own_units in (True, False):
        for first, last, load in blocks:
            if own_units:
                i = np.flatnonzero((own >= first) & (own < last))
                unit = own[i]
            else:
                met = [(a + i, j) for a in range(0, len(q), 64) for i, j in [whole.near(q[a : a + 64], limit[a : a + 64], first, last)]]
                i, unit = (np.concatenate(c) for c in zip(*met, strict=True))
                i, unit = i[unit != own[i]], unit[unit != own[i]]
            if not len(i):
                continue
            block, found = load(), [rows]
            by = np.argsort(unit, kind="stable")
            for at in np.split(by, np.flatnonzero(np.diff(unit[by])) + 1):
                if (bytes_ := block.get(int(unit[at[0]]))) is not None:
                    x = best(q[i[at]], limit[i[at]], *unpacked(*bytes_), k)
                    found.append((i[at][x[0]], *x[1:]))
            rows = tuple(np.concatenate(c) for c in zip(*found, strict=True))
            keep = knn.top(rows[0], rows[1], rows[2], k)
            rows = tuple(c[keep] for c in rows)
            limit = reached(rows[0], rows[1], len(q), k)
    out = np.zeros(len(q), np.int64)
    np.add.at(out, order[rows[0]], rows[3])
    return out


def within(q: np.ndarray, tree: Tree, own: np.ndarray, x: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """As best() without limits, by a tree that was fitted on the rows of the unit: a query meets its own leaf, and then others that lie near enough, the nearest first."""
    at, of = tree.leaf(x), tree.leaf(q)
    order, asked = np.argsort(at, kind="stable"), np.argsort(of, kind="stable")
    x, own, labels, leaves = x[order], own[order], labels[order], np.arange(len(tree.size) + 1)
    start, ask = np.searchsorted(at[order], leaves), np.searchsorted(of[asked], leaves)
    boxes = Boxes(None, tree, start, np.minimum.reduceat(x, start[:-1]), np.maximum.reduceat(x, start[:-1]), k)
    found = []
    for leaf in leaves[:-1]:
        if not len(i := asked[ask[leaf] : ask[leaf + 1]]):
            continue
        held, part = slice(start[leaf], start[leaf + 1]), q[i]
        rows = best(part, np.full(len(i), np.inf), own[held], x[held], labels[held], k)
        limit, gap = reached(rows[0], rows[1], len(i), k), boxes.bounds(part, part)
        least = gap.min(0)
        for j in np.argsort(least, kind="stable"):
            if least[j] > limit.max():
                break
            if j == leaf or not len(some := np.flatnonzero(gap[:, j] <= limit)):
                continue
            held = slice(start[j], start[j + 1])
            more = best(part[some], limit[some], own[held], x[held], labels[held], k)
            if len(more[0]):
                rows = tuple(np.concatenate(c) for c in zip(rows, (some[more[0]], *more[1:]), strict=True))
                keep = knn.top(rows[0], rows[1], rows[2], k)
                rows = tuple(c[keep] for c in rows)
                limit = reached(rows[0], rows[1], len(i), k)
        found.append((i[rows[0]], *rows[1:]))
    rows = tuple(np.concatenate(c) for c in zip(*found, strict=True))
    keep = np.argsort(rows[0], kind="stable")
    return tuple(c[keep] for c in rows)


#: Of a unit all of whose rows are asked about: its different vectors, the first neighbours of each in it (place, distance,
#: reference, label), all ids with the place of their vector, and ids of rows that have a place that is no number.
_ASKED = {"q": np.float64, "at": np.int32, "d2": np.float64, "ref": np.int64, "label": np.int64, "all_ids": np.int64, "place": np.int32, "odd": np.int64}


def build(refs: DataFrame, k: int = knn.K, rows: int | None = None, everyone: bool = False) -> Boxes | None:
    """Boxes of all references (ref_id, vector, is_fraud), written once; rows with a place that is no number are left out, as they are nobody's neighbours.  None without references.

    everyone: all references are queries too, and units say what their own rows find in them (for ``votes``).
    """
    known = refs.where("vector is not null").select("ref_id", "vector", F.coalesce(F.col("is_fraud").cast("long"), F.lit(0)).alias("is_fraud"))
    rows = known.count() if rows is None else rows
    if not rows:
        return None
    share = max(1, rows // SAMPLE)
    x = knn.to_matrix(known.where(F.pmod(F.xxhash64("ref_id"), F.lit(share)) == 0).select("vector").toArrow().column(0).combine_chunks()).astype(float)
    x = x[np.isfinite(x).all(1)] if len(x) else x
    tree = fitted(x, len(x) * max(LEAF, rows / MOST_LEAVES) / rows)
    cuts = np.maximum(1, np.ceil(tree.size * share / UNIT)).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(cuts)])
    sent = refs.sparkSession.sparkContext.broadcast((tree, start, cuts))
    more = _ASKED if everyone else {}

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, start, cuts = sent.value
        for batch in batches:
            if batch.num_rows:
                leaf = tree.leaf(knn.to_matrix(batch.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array((start[leaf] + batch.column(1).to_numpy() % cuts[leaf]).astype(np.int32)), *batch.columns[2:], batch.column(0)], ["unit", "ref_id", "is_fraud", "vector"])

    def pack(own: pa.Table) -> pa.Table:
        x = knn.to_matrix(own.column("vector").combine_chunks()).astype(float) + 0.0  # no negative zeros
        ids, labels = own.column("ref_id").to_numpy(), own.column("is_fraud").to_numpy()
        fine = np.isfinite(x).all(1)
        odd, x, ids, labels = ids[~fine], x[fine], ids[fine].astype(np.int64), labels[fine].astype(np.int64)
        if not len(x) and not (everyone and len(odd)):
            return pa.schema([("unit", pa.int32()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), *((c, pa.binary()) for c in ("ids", "labels", "vectors", *more))]).empty_table()
        _, first, same = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
        same, all_ids, q = same.ravel(), ids, x[first]
        keep = knn.top(same, np.zeros(len(x)), ids, k)
        x, ids, labels = np.ascontiguousarray(x[keep]), ids[keep], labels[keep]
        out = {"unit": pa.array([own.column("unit")[0].as_py()], pa.int32()), "n": pa.array([len(x)], pa.int64()), "low": [x.min(0) if len(x) else [np.inf] * x.shape[1]], "high": [x.max(0) if len(x) else [-np.inf] * x.shape[1]], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "vectors": [x.tobytes()]}
        if everyone:
            at, d, ref, label = (np.zeros(0, t) for t in (np.int32, np.float64, np.int64, np.int64))
            if len(x):
                inner = fitted(x, INNER)
                order = np.argsort(inner.leaf(q), kind="stable")  # near ones together
                q, to = q[order], np.argsort(order)
                same = to[same]
                at, d, ref, label = within(q, inner, ids, x, labels, k)
            parts = {"q": q, "at": at, "d2": d, "ref": ref, "label": label, "all_ids": all_ids, "place": same, "odd": odd}
            out |= {c: [np.ascontiguousarray(parts[c].astype(t)).tobytes()] for c, t in more.items()}
        return pa.table(out)

    dealt = known.select("vector", F.pmod(F.xxhash64(F.lit(7), "ref_id"), F.lit(1 << 30)), "ref_id", "is_fraud").mapInArrow(deal, "unit int, ref_id long, is_fraud long, vector array<double>")
    units = storage.cut(dealt.groupBy("unit").applyInArrow(pack, _UNITS + "".join(f", {c} binary" for c in more)), "boxes")
    found = units.select("unit", "low", "high").toArrow()  # MOST_LEAVES rows, and one for every UNIT references
    at, dims = found.column(0).to_numpy(), x.shape[1] if x.ndim == 2 else 0
    low, high = np.full((start[-1], dims), np.inf), np.full((start[-1], dims), -np.inf)
    if len(at):
        low[at], high[at] = (knn.to_matrix(found.column(c).combine_chunks()) for c in (1, 2))
    return Boxes(units, tree, start, low, high, k)


def unpacked(ids: bytes, labels: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(vectors).reshape(len(own), -1), np.frombuffer(labels, np.int64)


def best(q: np.ndarray, limit: np.ndarray, own: np.ndarray, x: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Place of the query, distance, reference and label of the k nearest rows of a unit within each query's limit; distances are summed place by place."""
    found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    xx = (x * x).sum(1)
    for a in range(0, len(q), 64):
        part, held = q[a : a + 64], limit[a : a + 64]
        qq = (part * part).sum(1)
        for b in range(0, len(x), 4096):
            # A product of matrices leaves out what is surely too far; its error is below a billionth of a thousandth of the squares.
            d = qq[:, None] + xx[None, b : b + 4096] - 2.0 * (part @ x[b : b + 4096].T)
            slack = 1e-12 * (qq + xx[b : b + 4096].max() + 1.0)
            at = np.minimum(held, np.partition(d, k - 1, axis=1)[:, k - 1] + slack if d.shape[1] >= k else np.inf)
            i, j = np.nonzero(d <= (at + slack)[:, None])
            j += b
            exact = np.zeros(len(i))
            for place in range(x.shape[1]):
                exact += (part[i, place] - x[j, place]) ** 2
            keep = exact <= held[i]
            i, j, exact = i[keep], j[keep], exact[keep]
            keep = knn.top(i, exact, own[j], k)
            found.append((i[keep] + a, exact[keep], own[j[keep]], labels[j[keep]]))
    rows = tuple(np.concatenate(c) for c in zip(*found, strict=True))
    keep = knn.top(rows[0], rows[1], rows[2], k)
    return tuple(c[keep] for c in rows)


def reached(i: np.ndarray, d: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th least distance of each of n queries; infinite where there are fewer."""
    out = np.zeros(n)
    np.maximum.at(out, i, d)
    return np.where(np.bincount(i, minlength=n) >= k, out, np.inf)


def met(boxes: Boxes, asked: DataFrame, run, schema: str) -> DataFrame:  # noqa: ANN001
    """Queries with a unit, dealt so that a unit of work has some ASKED of them, with that unit."""
    # One row for each unit that is asked, which is a small table.
    slices = F.broadcast(asked.groupBy("unit").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("slices")))
    left = asked.join(slices, "unit").withColumn("slice", F.pmod(F.xxhash64("q_id"), "slices").cast("int")).drop("slices")
    right = boxes.units.select("unit", "ids", "labels", "vectors").join(slices, "unit").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    return left.groupBy("unit", "slice").cogroup(right.groupBy("unit", "slice")).applyInArrow(run, schema)


def again(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What queries within their reach find in a unit that isn't their own."""

    def more(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return knn._FOUND.empty_table()
        q, reach = knn.to_matrix(left.column("q").combine_chunks()).astype(float), left.column("reach").to_numpy()
        i, d, ref, label = best(q, reach, *unpacked(*(right.column(c)[0].as_py() for c in ("ids", "labels", "vectors"))), k)
        return pa.Table.from_arrays([pa.array(left.column("q_id").to_numpy()[i]), pa.array(ref), pa.array(d), pa.array(label)], schema=knn._FOUND)

    return more


_VOTED = "fraud_count int, all_ids array<long>, q_id long, q array<double>, reach double, ref_id array<long>, d2 array<double>, is_fraud array<long>, visits array<int>"


def votes(boxes: Boxes) -> DataFrame:
    """q_id and fraud_count of all rows of boxes that were built for everyone.

    Most queries have all their neighbours in their own unit, and are counted there.
    The others are asked once for each vector of a unit (named by both) in every unit
    that reaches near enough.
    """
    k, dims = boxes.k, boxes.low.shape[1]
    sent = boxes.units.sparkSession.sparkContext.broadcast((boxes.tree, boxes.start, boxes.low, boxes.high))

    def counted(own: pa.Table) -> pa.Table:
        whole, unit = Boxes(None, *sent.value, k), own.column("unit")[0].as_py()
        q, at, d, ref, label, ids, place, odd = (np.frombuffer(own.column(c)[0].as_py(), t) for c, t in _ASKED.items())
        q = q.reshape(-1, dims)
        n = len(q)
        reach, count, visits = reached(at, d, n, k), np.zeros(n, np.int64), {}
        np.add.at(count, at, label)
        for a in range(0, n, 64):
            i, j = whole.near(q[a : a + 64], reach[a : a + 64])
            i, j = i[j != unit], j[j != unit]
            for x in np.unique(i):
                visits[a + int(x)] = j[i == x]
        far = np.fromiter(visits, np.int64, len(visits))
        wide = np.zeros(n, bool)
        wide[far] = True
        done = ~wide[place]
        by = np.argsort(place, kind="stable")
        copies, own_rows = np.searchsorted(place[by], np.arange(n + 1)), np.searchsorted(at, np.arange(n + 1))
        rows = {"fraud_count": [None] * len(far), "all_ids": [ids[by[copies[x] : copies[x + 1]]] for x in far], "q_id": [(unit << 32) + int(x) for x in far], "q": list(q[far]), "reach": reach[far]}
        rows |= {name: [c[own_rows[x] : own_rows[x + 1]] for x in far] for name, c in (("ref_id", ref), ("d2", d), ("is_fraud", label))}
        rows["visits"] = [visits[x].astype(np.int32) for x in far]
        open_ = pa.table({name: pa.array(c, _VOTED_ARROW.field(name).type) for name, c in rows.items()}, schema=_VOTED_ARROW)
        settled = {"fraud_count": np.concatenate([count[place[done]], np.zeros(len(odd), np.int64)]).astype(np.int32), "q_id": np.concatenate([ids[done], odd])}
        m = len(settled["q_id"])
        closed = pa.table({f.name: pa.array(settled[f.name]) if f.name in settled else pa.nulls(m, f.type) for f in _VOTED_ARROW}, schema=_VOTED_ARROW)
        return pa.concat_tables([closed, open_])

    own = boxes.units.select("unit", *_ASKED)
    x = storage.cut(own.groupBy("unit").applyInArrow(counted, _VOTED), "votes")
    wide = x.where("fraud_count is null")
    near = wide.select("q_id", F.inline(F.arrays_zip("ref_id", "d2", "is_fraud")))
    near = near.unionByName(met(boxes, wide.select(F.explode("visits").alias("unit"), "q_id", "q", "reach"), again(k), knn._FOUND_SQL))
    late = knn.vote(knn.ranked(near, k), wide).join(wide.select("q_id", "all_ids"), "q_id").select(F.explode("all_ids").alias("q_id"), "fraud_count")
    return x.where("fraud_count is not null").select("q_id", "fraud_count").unionByName(late)


_VOTED_ARROW = pa.schema([
    ("fraud_count", pa.int32()), ("all_ids", pa.list_(pa.int64())), ("q_id", pa.int64()), ("q", pa.list_(pa.float64())), ("reach", pa.float64()), ("ref_id", pa.list_(pa.int64())),
    ("d2", pa.list_(pa.float64())), ("is_fraud", pa.list_(pa.int64())), ("visits", pa.list_(pa.int32())),
])
_BOUNDS = "q_id long, q array<double>, reach double, ref_id array<long>, d2 array<double>, is_fraud array<long>, visits array<int>"


def nearest(queries: DataFrame, boxes: Boxes, k: int = knn.K) -> DataFrame:
    """q_id, ref_id, d2, is_fraud: rows among which are the k nearest of each query (q_id, q), some more of them besides.

    A query first meets the unit of its own leaf; the k-th distance there bounds
    what it may still find, and it meets the other units that reach that near.
    """
    if k > boxes.k:
        raise ValueError(f"boxes made for {boxes.k} neighbours don't hold {k}")
    sent = queries.sparkSession.sparkContext.broadcast((boxes.tree, boxes.start, boxes.low, boxes.high))
    shape = lambda: Boxes(None, *sent.value, k)

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = sent.value[1][sent.value[0].leaf(knn.to_matrix(batch.column(1)))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(unit), *batch.columns], ["unit", "q_id", "q"])

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        whole, q = shape(), knn.to_matrix(left.column("q").combine_chunks()).astype(float)
        n = len(q)
        rows = tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64))
        if n and right.num_rows:
            rows = best(q, np.full(n, np.inf), *unpacked(*(right.column(c)[0].as_py() for c in ("ids", "labels", "vectors"))), k)
        reach, visits = reached(rows[0], rows[1], n, k), [np.zeros(0, np.int32)] * n
        for a in range(0, n, 64):
            i, j = whole.near(q[a : a + 64], reach[a : a + 64])
            for place, units in enumerate(np.split(j, np.searchsorted(i, np.arange(1, len(q[a : a + 64]))))):
                visits[a + place] = units[units != left.column("unit")[0].as_py()].astype(np.int32)
        ends = np.searchsorted(rows[0], np.arange(1, n))
        lists = [np.split(c, ends) if n else [] for c in rows[1:]]
        return pa.table({"q_id": left.column("q_id"), "q": pa.array(list(q), pa.list_(pa.float64())), "reach": pa.array(reach), "ref_id": pa.array(lists[1], pa.list_(pa.int64())), "d2": pa.array(lists[0], pa.list_(pa.float64())), "is_fraud": pa.array(lists[2], pa.list_(pa.int64())), "visits": pa.array(visits, pa.list_(pa.int32()))})

    asked = queries.where("q is not null").select("q_id", "q").mapInArrow(own, "unit int, q_id long, q array<double>")
    bounds = storage.cut(met(boxes, storage.cut(asked, "asked"), first, _BOUNDS), "bounds")
    found = bounds.select("q_id", F.inline(F.arrays_zip("ref_id", "d2", "is_fraud")))
    visits = bounds.select(F.explode("visits").alias("unit"), "q_id", "q", "reach")
    return found.unionByName(met(boxes, visits, again(k), knn._FOUND_SQL))
