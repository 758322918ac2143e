"""Inverted lists over clusters, product quantization, and the searches that use them."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal import storage
from vicinal.functions import distance
from vicinal.operators import knn

VERSION = 1
#: Rows of one list, and queries that probe it, that one unit of work has; more are cut.
LIST_BLOCK = 65536
PROBE_BLOCK = 4096
#: Queries of a unit of work that looks through all lists.
RERANK_BLOCK = 1024
#: Tasks that learn codes from a sample, whose sums the driver adds up.
PARTS = 64


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector; of equal ones the first."""
    out = np.empty(len(vectors), np.int64)
    for a in range(0, len(vectors), 1024):
        out[a : a + 1024] = distance.matrix(vectors[a : a + 1024], centres).argmin(1)
    return out


def assign(refs: DataFrame, centres: np.ndarray, column: str = "vector") -> DataFrame:
    """refs with cluster, the nearest centre; the centres are at most some thousand vectors."""
    sent = refs.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def pick(v: pd.Series) -> pd.Series:
        return pd.Series(nearest(np.stack(v.to_numpy()).astype(float), sent.value) if len(v) else [], dtype="int32")

    return refs.withColumn("cluster", pick(column))


def seeded_centres(refs: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k least ids."""
    return np.array([r[0] for r in refs.where("vector is not null").orderBy("ref_id").select("vector").limit(k).collect()], float)


def lloyd(refs: DataFrame, centres: np.ndarray, rounds: int = 1, seed: int = 42) -> np.ndarray:
    """Centres after so many rounds of assigning and averaging; a cluster without members gets the vector of some row, by a hash of its id and the round."""
    for number in range(rounds):
        means = sums(refs, centres).select("cluster", "n", "total").collect()  # one row for each centre
        centres = centres.copy()
        for r in means:
            centres[r["cluster"]] = np.array(r["total"]) / r["n"]
        empty = sorted(set(range(len(centres))) - {r["cluster"] for r in means})
        if empty and means:
            rows = sampled(refs.where("vector is not null"), len(empty), seed + 12345 * (number + 1)).orderBy("ref_id").select("vector").collect()
            centres[empty[: len(rows)]] = np.array([r[0] for r in rows], float)
    return centres


def sums(refs: DataFrame, centres: np.ndarray) -> DataFrame:
    """cluster, n, total (array) and wcss of each cluster that has members; each task sums its own rows first."""
    sent = refs.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        n, total, wcss = np.zeros(len(c), np.int64), np.zeros(c.shape), np.zeros(len(c))
        for batch in batches:
            x = knn.to_matrix(batch.column(0)).astype(float)
            if len(x):
                at = nearest(x, c)
                n += np.bincount(at, minlength=len(c))
                np.add.at(total, at, x)
                wcss += np.bincount(at, weights=((x - c[at]) ** 2).sum(1), minlength=len(c))
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(list(total[own]), pa.list_(pa.float64())), pa.array(wcss[own])], ["cluster", "n", "total", "wcss"])

    rows = refs.where("vector is not null").select("vector").mapInArrow(run, "cluster int, n long, total array<double>, wcss double")
    dims = centres.shape[1]
    return rows.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(d))) for d in range(dims))).alias("total"), F.sum("wcss").alias("wcss"))


def train_centres(refs: DataFrame, k: int, seed: int = 42, rounds: int = 25, trials: int = 1, sample: int = 600_000, column: str = "vector") -> np.ndarray:
    """k-means centres from the sample of rows whose ids hash least; of several trials the one of least inertia.

    Where the trainer gives fewer than k, other different vectors of the sample take
    the empty places; fewer come back only where there are no more of them.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = sampled(refs.where(F.col(column).isNotNull()), sample, seed).select("ref_id", F.col(column).cast("array<double>").alias("v"))
    # A limit leaves one partition, with which one task would learn.
    rows = rows.repartition(min(PARTS, refs.sparkSession.sparkContext.defaultParallelism)).withColumn("features", array_to_vector("v")).cache()
    best, least = None, float("inf")
    for t in range(trials):
        model = KMeans(k=k, seed=seed + t, maxIter=rounds, tol=0.0).fit(rows)
        if model.summary.trainingCost < least:
            best, least = np.array(model.clusterCenters()), model.summary.trainingCost
    if len(best) < k:
        more = [np.array(r[0]) for r in sampled(rows.dropDuplicates(["v"]), k, seed).select("v").collect()]
        known = {c.tobytes() for c in best}
        best = np.array([*best, *(c for c in more if c.tobytes() not in known)][:k])
    rows.unpersist()
    return best


def sampled(refs: DataFrame, n: int, seed: int = 42, id_col: str = "ref_id") -> DataFrame:
    """n rows, those whose seed and id have the least MD5: the same ones at every run, and in SQL too.

    Only rows whose hash is small enough to be among half as many again as wanted
    are ordered, so tasks pass on some n rows in all, not n each.
    """
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    share = min(1.0, (1.5 * n + 50) / max(1, refs.count()))
    limit = f"{int(share * 0xFFFFFFFF):08x}"
    return refs.where(F.substring(hashed, 1, 8) <= limit).orderBy(hashed, id_col).limit(n)


@dataclass
class Codebook:
    """Centres of each of m sub-spaces: shape (m, codes, dims / m)."""

    centres: np.ndarray

    @property
    def m(self) -> int:
        return len(self.centres)

    def parts(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), self.m, -1).astype(float)

    def encode(self, x: np.ndarray) -> np.ndarray:
        p = self.parts(x)
        return np.stack([nearest(p[:, s], self.centres[s]) for s in range(self.m)], axis=1).astype(np.int16)

    def decoded(self, code: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for; a quantized distance is the distance from such a vector."""
        return np.concatenate([self.centres[s][code[:, s].astype(np.int64)] for s in range(self.m)], axis=1)

    def summed(self, tables: np.ndarray, i: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Quantized distances of the queries at i of ``tables`` from rows of codes, in the order of parts."""
        out = np.zeros(len(i))
        for s in range(self.m):
            out += tables[i, s, code[:, s].astype(np.int64)]
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of each part of each query from each centre."""
        p = self.parts(q)
        return np.stack([distance.matrix(p[:, s], self.centres[s]) for s in range(self.m)], axis=1)


def split_check(dims: int, m: int) -> None:
    if m < 1 or dims % m:
        raise ValueError(f"{dims} places can't be cut into {m} equal parts")


def seeded_codebook(refs: DataFrame, m: int, codes: int) -> Codebook:
    """The parts of the vectors of the least ids."""
    x = seeded_centres(refs, codes)
    split_check(x.shape[1], m)
    return Codebook(np.ascontiguousarray(x.reshape(len(x), m, -1).transpose(1, 0, 2)))


def part_sums(rows: DataFrame, book: Codebook) -> tuple[np.ndarray, np.ndarray, float]:
    """For each part and code the number of vectors nearest to it and their sum, and the squared distances of all parts; one pass over a sample."""
    sent = rows.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = sent.value
        n, total, wcss = np.zeros(book.centres.shape[:2], np.int64), np.zeros(book.centres.shape), 0.0
        for batch in batches:
            x = knn.to_matrix(batch.column(0)).astype(float)
            if len(x):
                p, code = book.parts(x), book.encode(x).astype(np.int64)
                for s in range(book.m):
                    n[s] += np.bincount(code[:, s], minlength=n.shape[1])
                    np.add.at(total[s], code[:, s], p[:, s])
                    wcss += float(((p[:, s] - book.centres[s][code[:, s]]) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()]), pa.array([total.tobytes()]), pa.array([wcss])], ["n", "total", "wcss"])

    # A row for each of PARTS tasks at most, of as many numbers as the codebook has.
    n, total, wcss = np.zeros(book.centres.shape[:2], np.int64), np.zeros(book.centres.shape), 0.0
    for r in rows.select("vector").coalesce(PARTS).mapInArrow(run, "n binary, total binary, wcss double").collect():
        n += np.frombuffer(r["n"], np.int64).reshape(n.shape)
        total += np.frombuffer(r["total"]).reshape(total.shape)
        wcss += r["wcss"]
    return n, total, wcss


def train_codebook(refs: DataFrame, m: int, codes: int, seed: int = 42, rounds: int = 30, trials: int = 1, sample: int = 600_000) -> Codebook:
    """k-means in each part, on the vectors themselves (not on what a cluster centre leaves of them).

    All parts learn in the same pass over the sample.  The first centres, and what
    replaces codes that no vector is nearest to, are vectors of the sample by the
    hash of their ids; of several trials the one of least inertia is taken.
    """
    dims = len(refs.where("vector is not null").select("vector").first()[0])
    split_check(dims, m)
    rows = sampled(refs.where("vector is not null").select("ref_id", "vector"), sample, seed).repartition(min(PARTS, refs.sparkSession.sparkContext.defaultParallelism)).cache()
    best, least = None, float("inf")
    for t in range(trials):
        found = sampled(rows, 2 * codes, seed + 1 + t).collect()
        first = np.array([r["vector"] for r in sorted(found, key=lambda r: r["ref_id"])], float)
        parts = first.reshape(len(first), m, -1).transpose(1, 0, 2)
        # Different ones first; fewer codes than asked for where there are fewer vectors.
        starts = [p[np.sort(np.unique(p, axis=0, return_index=True)[1])] for p in parts]
        short = min(codes, *map(len, starts))
        book, spare = Codebook(np.stack([s[:short] for s in starts])), np.random.default_rng(seed + t)
        wcss = float("inf")
        for _ in range(rounds):
            n, total, now = part_sums(rows, book)
            centres = np.where(n[:, :, None] > 0, total / np.maximum(n, 1)[:, :, None], book.centres)
            for s, code in zip(*np.nonzero(n == 0), strict=True):
                centres[s, code] = starts[s][spare.integers(len(starts[s]))]
            done, wcss = not now < wcss * (1 - 1e-4), now
            if done:
                break
            book = Codebook(centres)
        if wcss < least:
            best, least = book, wcss
    rows.unpersist()
    return best


def encode(refs: DataFrame, book: Codebook) -> DataFrame:
    """refs with code, an array of small integers."""
    sent = refs.sparkSession.sparkContext.broadcast(book)

    @F.pandas_udf("array<smallint>")
    def pick(v: pd.Series) -> pd.Series:
        return pd.Series(list(sent.value.encode(np.stack(v.to_numpy()))) if len(v) else [], dtype=object)

    return refs.withColumn("code", pick("vector"))


@dataclass
class Index:
    """Lists (cluster, ref_id, vector, code, is_fraud) with what searches them."""

    lists: DataFrame
    centres: np.ndarray
    book: Codebook | None


def build(refs: DataFrame, centres: np.ndarray, book: Codebook | None) -> Index:
    """Lists of all rows, written once as every search reads them more than once; without a codebook they have no codes."""
    rows = assign(refs.where("vector is not null"), centres)
    return Index(storage.cut(encode(rows, book) if book else rows, "lists"), centres, book)


def build_trained(refs: DataFrame, clusters: int, m: int, codes: int, seed: int = 42) -> Index:
    return build(refs, train_centres(refs, clusters, seed), train_codebook(refs, m, codes, seed))


def write(index: Index, path: str) -> None:
    """The index as tables: lists dealt by cluster and sorted, centres, codebook, and a description."""
    spark = index.lists.sparkSession
    index.lists.repartition("cluster").sortWithinPartitions("cluster", "ref_id").write.mode("overwrite").parquet(f"{path}/lists")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centres)], "cluster int, c array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    rows = [(s, i, c.tolist()) for s, part in enumerate(index.book.centres) for i, c in enumerate(part)]
    spark.createDataFrame(rows, "m int, code int, c array<double>").write.mode("overwrite").parquet(f"{path}/codebook")
    meta = {"version": VERSION, "clusters": len(index.centres), "m": index.book.m, "codes": index.book.centres.shape[1], "dims": index.centres.shape[1]}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{path}/meta")


def read(spark: SparkSession, path: str) -> Index:
    """An index that ``write`` made; one of another version is refused."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.get("version") != VERSION:
        raise ValueError(f"index version {meta.get('version')!r} is not {VERSION}")
    centres = np.array([r["c"] for r in spark.read.parquet(f"{path}/centres").orderBy("cluster").collect()])
    book = np.array([r["c"] for r in spark.read.parquet(f"{path}/codebook").orderBy("m", "code").collect()])
    return Index(spark.read.parquet(f"{path}/lists"), centres, Codebook(book.reshape(meta["m"], meta["codes"], -1)))


def probe(queries: DataFrame, centres: np.ndarray, nprobe: int) -> DataFrame:
    """q_id, q, cluster, probe (from 1): the nprobe nearest centres of each query, ties by number."""
    sent = queries.sparkSession.sparkContext.broadcast(centres)
    n = min(nprobe, len(centres))

    @F.pandas_udf("array<int>")
    def pick(v: pd.Series) -> pd.Series:
        return pd.Series([np.argsort(d, kind="stable")[:n].astype(np.int32) for d in distance.matrix(np.stack(v.to_numpy()).astype(float), sent.value)] if len(v) else [], dtype=object)

    rows = queries.where("q is not null").select("q_id", "q", F.posexplode(pick("q")).alias("at", "cluster"))
    return rows.select("q_id", "q", "cluster", (F.col("at") + 1).alias("probe"))


def scan(probes: DataFrame, index: Index, candidates: int, coarse: bool = True) -> DataFrame:
    """q_id, rk, ref_id, d2, is_fraud: the best ``candidates`` of the probed lists, by quantized (coarse) or exact distance."""
    return knn.ranked(scanned(probes, index, candidates, coarse), candidates)


def scanned(probes: DataFrame, index: Index, candidates: int, coarse: bool = True) -> DataFrame:
    """q_id, probe, ref_id, d2, is_fraud: for each probe the best ``candidates`` of each part of its list.

    Queries meet the lists that they probe.  Lists beyond LIST_BLOCK rows are cut, and
    so are the queries of a list beyond PROBE_BLOCK, so that a unit of work is of
    bounded size on both sides, and each passes on its best only.
    """
    sent = probes.sparkSession.sparkContext.broadcast(index.book)  # m x codes small vectors
    parts = lambda rows, size, name: rows.groupBy("cluster").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = parts(index.lists, LIST_BLOCK, "cuts").join(parts(probes, PROBE_BLOCK, "slices"), "cluster")
    value = "code" if coarse else "vector"
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    lists = index.lists.join(sizes, "cluster").select("cluster", F.pmod(F.xxhash64("ref_id"), "cuts").cast("int").alias("cut"), every("slices").alias("slice"), "ref_id", value, F.col("is_fraud").cast("long"))
    asked = probes.join(sizes, "cluster").select("cluster", every("cuts").alias("cut"), F.pmod(F.xxhash64("q_id"), "slices").cast("int").alias("slice"), "q_id", "probe", "q")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("q_id", pa.int64()), ("probe", pa.int32()), ("ref_id", pa.int64()), ("d2", pa.float64()), ("is_fraud", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, probe, q = left.column("q_id").to_numpy(), left.column("probe").to_numpy(), knn.to_matrix(left.column("q").combine_chunks())
        refs, label = right.column("ref_id").to_numpy(), right.column("is_fraud").to_numpy()
        x = knn.to_matrix(right.column(value).combine_chunks())
        if not coarse:
            best = knn.Best(ids, q.astype(float), candidates, "l2")
            best.see(refs, x, label)
            i, d, ref, own = best.found
            return pa.Table.from_arrays([pa.array(c) for c in (ids[i], probe[i], ref, d, own)], schema=schema)
        found, decoded = [], sent.value.decoded(x)
        for a in range(0, len(ids), knn.AT_ONCE):
            part = q[a : a + knn.AT_ONCE].astype(float)
            i, j = distance.screened(part, decoded, candidates, np.full(len(part), np.inf))
            d = sent.value.summed(sent.value.tables(part), i, x[j])
            keep = knn.top(i, d, refs[j], candidates)
            i, j, d = i[keep], j[keep], d[keep]
            found.append((ids[a + i], probe[a + i], refs[j], d, label[j]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=schema)

    units = ["cluster", "cut", "slice"]
    return asked.groupBy(*units).cogroup(lists.groupBy(*units)).applyInArrow(run, "q_id long, probe int, ref_id long, d2 double, is_fraud long")


def check(k: int, candidates: int) -> None:
    if candidates < k:
        raise ValueError(f"{candidates} candidates can't hold {k} neighbours")


def search(queries: DataFrame, index: Index, k: int = knn.K, nprobe: int = 16, candidates: int = 10) -> DataFrame:
    """The k best of the probed lists by quantized distance."""
    check(k, candidates)
    return scan(probe(queries, index.centres, nprobe), index, candidates).where(F.col("rk") <= k)


def rerank(queries: DataFrame, candidates: DataFrame, refs: DataFrame, k: int = knn.K) -> DataFrame:
    """The k nearest of the candidates by exact distance; candidates that refs lacks count as infinitely far."""
    rows = candidates.select("q_id", "ref_id").join(queries.select("q_id", "q"), "q_id").join(refs.select("ref_id", "vector", "is_fraud"), "ref_id", "left")
    rows = rows.select("q_id", "ref_id", F.coalesce(distance.l2_squared(F.col("q"), F.col("vector")), F.lit(float("inf"))).alias("d2"), F.coalesce("is_fraud", F.lit(0)).alias("is_fraud"))
    return knn.ranked(rows, k)


def reranked(queries: DataFrame, index: Index, k: int = knn.K, nprobe: int = 16, candidates: int = 10) -> DataFrame:
    """The same as rerank() of scan() with the vectors that the lists hold: q_id, rk, ref_id, d2, is_fraud.

    For many queries: a unit of work is a block of queries with a block of rows of
    all lists, which knows exact distances too, so that candidates need not be passed
    on where one block holds all rows; else it passes on its best ``candidates``.
    """
    check(k, candidates)
    spark, n, rows = index.lists.sparkSession, queries.count(), index.lists.count()
    slices, cuts = max(1, -(-n // RERANK_BLOCK), min(-(-n // 64), spark.sparkContext.defaultParallelism)), max(1, -(-rows // knn.REF_BLOCK))
    sent = spark.sparkContext.broadcast((index.book, index.centres))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.where("q is not null").select(part("q_id", slices).alias("slice"), every(cuts).alias("cut"), "q_id", "q")
    lists = index.lists.select(every(slices).alias("slice"), part("ref_id", cuts).alias("cut"), "cluster", "ref_id", "code", "vector", F.coalesce(F.col("is_fraud").cast("long"), F.lit(0)).alias("is_fraud"))
    schema = pa.schema([("q_id", pa.int64()), ("ref_id", pa.int64()), ("coarse", pa.float64()), ("d2", pa.float64()), ("is_fraud", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        book, centres = sent.value
        own, q = left.column("q_id").to_numpy(), knn.to_matrix(left.column("q").combine_chunks()).astype(float)
        cluster, refs, label = (right.column(c).to_numpy() for c in ("cluster", "ref_id", "is_fraud"))
        code, x = (knn.to_matrix(right.column(c).combine_chunks()) for c in ("code", "vector"))
        decoded, found = book.decoded(code), []
        order = np.argsort(distance.matrix(q, centres), axis=1, kind="stable")[:, : min(nprobe, len(centres))]
        skipped = np.ones((len(q), len(centres)), bool)
        np.put_along_axis(skipped, order, False, axis=1)
        for a in range(0, len(q), 64):
            some = q[a : a + 64]
            i, j = distance.screened(some, decoded, candidates, np.full(len(some), np.inf), skipped[a : a + 64][:, cluster])
            coarse = book.summed(book.tables(some), i, code[j])
            keep = knn.top(i, coarse, refs[j], candidates)
            i, j, coarse = i[keep], j[keep], coarse[keep]
            d = distance.paired(some[i], x[j].astype(float))
            keep = knn.top(i, d, refs[j], k) if cuts == 1 else slice(None)
            found.append((own[a + i[keep]], refs[j[keep]], coarse[keep], d[keep], label[j[keep]]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=schema)

    near = asked.groupBy("slice", "cut").cogroup(lists.groupBy("slice", "cut")).applyInArrow(run, "q_id long, ref_id long, coarse double, d2 double, is_fraud long")
    if cuts > 1:
        best = Window.partitionBy("q_id").orderBy("coarse", "ref_id")
        near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= candidates)
    return knn.ranked(near.select("q_id", "ref_id", "d2", "is_fraud"), k)


def gray_zone(queries: DataFrame, index: Index, refs: DataFrame, k: int = knn.K, nprobe: int = 16, candidates: int = 10, wide_nprobe: int = 32, wide_candidates: int = 20, count_source: str = "exact") -> DataFrame:
    """q_id, fraud_count, widened: reranked search, and a wider one where 2 or 3 of the first neighbours are fraud.

    count_source: whose labels the first count takes, those of the exact or of the
    coarse first k; the second pass always counts exact ones.
    """
    check(k, candidates)
    check(k, wide_candidates)
    if count_source not in ("exact", "coarse"):
        raise ValueError(f"unknown count source {count_source!r}")
    coarse = scan(probe(queries, index.centres, nprobe), index, candidates)
    first = rerank(queries, coarse, refs, k) if count_source == "exact" else coarse.where(F.col("rk") <= k)
    votes = knn.vote(first, queries)
    gray = votes.where(knn.is_gray(F.col("fraud_count"))).select("q_id")
    again = queries.join(gray, "q_id", "left_semi")
    second = knn.vote(rerank(again, scan(probe(again, index.centres, wide_nprobe), index, wide_candidates), refs, k), again).withColumnRenamed("fraud_count", "second")
    return votes.join(second, "q_id", "left").select("q_id", F.coalesce("second", "fraud_count").alias("fraud_count"), F.col("second").isNotNull().alias("widened"))
