"""Exact nearest neighbours, the vote of their labels, and the decision."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.functions import distance

K = 5
THRESHOLD = 0.6
GRAY = (2, 3)
#: Bytes of the query vectors that one task holds, and queries that are compared at once.
QUERY_BLOCK = 16 << 20
AT_ONCE = 256
#: References of a unit of work, where the queries are more than one block.
REF_BLOCK = 1 << 18
#: Queries beyond which references that lie in a few files are dealt to all cores.
SPREAD = 1000
#: Pairs of queries and references beyond which references are first dealt into boxes (see boxes.py), if their places are few.
MOST_PAIRS = 1 << 30


def to_matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def top(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least (distance, id) of each query among rows of query, distance and id."""
    order = np.lexsort((ids, d, q))
    first = np.searchsorted(q[order], q[order], "left")
    return order[np.arange(len(order)) - first < k]


class Best:
    """The k nearest references of each of some queries among those seen so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str) -> None:
        self.ids, self.vectors, self.k, self.metric = ids, vectors, k, metric
        self.found = tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64))  # query, distance, reference, label
        self.limit = np.full(len(ids), np.inf)

    def see(self, own: np.ndarray, vectors: np.ndarray, label: np.ndarray) -> None:
        found, k = [self.found], self.k
        if self.metric == "l2":
            vectors = vectors.astype(np.float64, copy=False)
        for a in range(0, len(self.ids), AT_ONCE):
            for b in range(0, len(own), 4096):
                if self.metric == "l2":
                    q, x, limit = self.vectors[a : a + AT_ONCE], vectors[b : b + 4096], self.limit[a : a + AT_ONCE]
                    i, j = distance.screened(q, x, k, limit)
                    d = distance.paired(q[i], x[j])
                    near = d <= limit[i]
                    i, j, d = i[near], j[near], d[near]
                    near = top(i, d, own[b + j], k)
                    i, j, d = i[near], j[near], d[near]
                    found.append((i + a, d, own[b + j], label[b + j]))
                    continue
                d = distance.matrix(self.vectors[a : a + AT_ONCE], vectors[b : b + 4096], self.metric)
                at = np.minimum(self.limit[a : a + AT_ONCE], np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.inf)
                i, j = np.nonzero(d <= at[:, None])
                found.append((i + a, d[i, j], own[b + j], label[b + j]))
        best = tuple(np.concatenate(c) for c in zip(*found, strict=True))
        keep = top(best[0], best[1], best[2], k)
        self.found = best = tuple(c[keep] for c in best)
        full = np.bincount(best[0], minlength=len(self.ids)) >= k
        worst = np.zeros(len(self.ids))
        np.maximum.at(worst, best[0], best[1])
        self.limit[full] = worst[full]

    def rows(self) -> pa.RecordBatch:
        q, d, own, label = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(own), pa.array(d), pa.array(label)], schema=_FOUND)


_FOUND = pa.schema([("q_id", pa.int64()), ("ref_id", pa.int64()), ("d2", pa.float64()), ("is_fraud", pa.int64())])
_FOUND_SQL = "q_id long, ref_id long, d2 double, is_fraud long"


def _labels(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.fill_null(0)).astype(np.int64)


def exact_knn(queries: DataFrame, refs: DataFrame, k: int = K, metric: str = "l2") -> DataFrame:
    """q_id, rk (from 1), ref_id, d2, is_fraud: the k nearest references of each query, ties by ref_id.

    queries: q_id and q; refs: ref_id, vector and is_fraud.  d2 is the squared
    Euclidean distance, or that of the other metric.  A stated set of queries meets
    all references in blocks.  Queries of one block (their size is checked) are sent
    to all tasks, and references stay where they are read; more are dealt out, each
    block of queries with each block of references as one unit of bounded size.
    Either way a task passes on the k best of its references for each query only.
    Where pairs are very many and places few, a query meets only those references
    that lie in boxes near enough, which gives the same rows.
    """
    asked = queries.where("q is not null").select("q_id", "q")
    known = refs.where("vector is not null").select("ref_id", "vector", F.col("is_fraud").cast("long").alias("is_fraud"))
    size, n, places = asked.agg(F.sum(8 + 8 * F.size("q").cast("long")), F.count("*"), F.max(F.size("q"))).first()
    if not size:
        return refs.sparkSession.createDataFrame([], "q_id long, rk int, ref_id long, d2 double, is_fraud int")
    from vicinal.operators import boxes

    if metric == "l2" and places <= boxes.MOST_PLACES and n * (rows := known.count()) > MOST_PAIRS:
        return ranked(boxes.nearest(asked, boxes.build(known, k, rows), k), k)
    if size > QUERY_BLOCK:
        return ranked(_dealt(asked, known, size, k, metric), k)
    rows = asked.toArrow()  # QUERY_BLOCK bytes at most
    sent = refs.sparkSession.sparkContext.broadcast((rows.column(0).to_numpy(), to_matrix(rows.column(1).combine_chunks()).astype(float)))

    # A few files are too few tasks for many comparisons.
    if n > SPREAD and known.rdd.getNumPartitions() < 2 * (cores := refs.sparkSession.sparkContext.defaultParallelism):
        known = known.repartition(2 * cores)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*sent.value, k, metric)
        for batch in batches:
            best.see(batch.column(0).to_numpy(), to_matrix(batch.column(1)), _labels(batch.column(2)))
        yield best.rows()

    return ranked(known.mapInArrow(run, _FOUND_SQL), k)


def votes_of_all(refs: DataFrame, k: int = K) -> DataFrame:
    """q_id and fraud_count of all references (ref_id, vector, is_fraud) among all of them, each also its own neighbour; the same as by ``exact_knn`` and ``vote``."""
    from vicinal.operators import boxes

    known = refs.where("vector is not null")
    rows, places = known.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not rows or places > boxes.MOST_PLACES or rows * rows <= MOST_PAIRS:
        q = refs.select(F.col("ref_id").alias("q_id"), F.col("vector").alias("q"))
        return vote(exact_knn(q, refs, k), q)
    none = refs.where("vector is null").select(F.col("ref_id").alias("q_id"), F.lit(0).alias("fraud_count"))
    return boxes.votes(boxes.build(known, k, rows, everyone=True)).unionByName(none)


def _dealt(asked: DataFrame, known: DataFrame, size: int, k: int, metric: str) -> DataFrame:
    """The k best of each unit: a block of queries and a block of references."""
    parts, cuts = -(-size // QUERY_BLOCK), -(-known.count() // REF_BLOCK) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.select(F.pmod(F.xxhash64("q_id"), F.lit(parts)).cast("int").alias("part"), every(cuts).alias("cut"), "q_id", "q")
    r = known.select(every(parts).alias("part"), F.pmod(F.xxhash64("ref_id"), F.lit(cuts)).cast("int").alias("cut"), "ref_id", "vector", "is_fraud")

    def unit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        best = Best(left.column("q_id").to_numpy(), to_matrix(left.column("q").combine_chunks()).astype(float), k, metric)
        best.see(right.column("ref_id").to_numpy(), to_matrix(right.column("vector").combine_chunks()), _labels(right.column("is_fraud")))
        return pa.Table.from_batches([best.rows()])

    return q.groupBy("part", "cut").cogroup(r.groupBy("part", "cut")).applyInArrow(unit, _FOUND_SQL)


def ranked(candidates: DataFrame, k: int = K) -> DataFrame:
    """The k nearest of q_id, ref_id, d2, is_fraud for each query."""
    by = Window.partitionBy("q_id").orderBy("d2", "ref_id")
    return candidates.withColumn("rk", F.row_number().over(by)).where(F.col("rk") <= k).select("q_id", "rk", "ref_id", "d2", F.col("is_fraud").cast("int").alias("is_fraud"))


def vote(neighbours: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """q_id and fraud_count; queries without neighbours have 0 if the queries are given."""
    counts = neighbours.groupBy("q_id").agg(F.sum("is_fraud").cast("int").alias("fraud_count"))
    if queries is None:
        return counts
    return queries.select("q_id").join(counts, "q_id", "left").select("q_id", F.coalesce("fraud_count", F.lit(0)).alias("fraud_count"))


def score(fraud_count: Column, k: int = K) -> Column:
    """The share of fraud among k, however many neighbours there were."""
    return fraud_count / F.lit(float(k))


def decide(votes: DataFrame, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """votes with fraud_score and approved (score below the threshold)."""
    return votes.withColumn("fraud_score", score(F.col("fraud_count"), k)).withColumn("approved", F.col("fraud_score") < F.lit(threshold))


def is_gray(fraud_count: Column) -> Column:
    return fraud_count.isin(*GRAY)


def response(decisions: DataFrame) -> DataFrame:
    """decisions with the JSON body of the answer; the score has four places there."""
    body = F.concat(F.lit('{"approved":'), F.col("approved").cast("string"), F.lit(',"fraud_score":'), F.format_string("%.4f", "fraud_score"), F.lit("}"))
    return decisions.withColumn("body", body)
