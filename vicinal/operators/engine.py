"""Search strategies by name, their configuration, and decisions end to end."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.functions import features
from vicinal.operators import boxes, knn
from vicinal.operators import index as ix


@dataclass
class SearchConfig:
    strategy: str = "ivf_pq"
    clusters: int = 4096
    nprobe: int = 16
    candidates: int = 10
    rerank: bool = True
    rerank_nprobe: int = 16
    rerank_candidates: int = 10
    count_source: str = "exact"
    debug: bool = False

    @classmethod
    def from_environment(cls, prefix: str = "VICINAL_", environment: dict[str, str] | None = None, start: SearchConfig | None = None) -> SearchConfig:
        """Defaults (or ``start``), replaced by variables such as VICINAL_NPROBE."""
        env = os.environ if environment is None else environment
        return (start or cls())._with({f.name: raw for f in fields(cls) if (raw := env.get(prefix + f.name.upper())) is not None})

    @classmethod
    def from_file(cls, text: str) -> SearchConfig:
        """From the text of a configuration file: nested keys and values, as in KEYS below ``app``; others are left out."""
        path: list[tuple[int, str]] = []
        found = {}
        for line in text.splitlines():
            line = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
            name, mark, value = line.strip().partition(":")
            if not mark:
                continue
            depth = len(line) - len(line.lstrip())
            path = [*((d, n) for d, n in path if d < depth), (depth, name.strip())]
            key = ".".join(n for _, n in path)
            if key in KEYS and (value := value.strip().strip("\"'")):
                found[KEYS[key]] = value
        return cls()._with(found)

    def _with(self, values: dict[str, str]) -> SearchConfig:
        out = replace(self)
        for name, raw in values.items():
            kind = type(getattr(out, name))
            setattr(out, name, raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw))
        return out


# Keys of a configuration file.
KEYS = {
    "app.vector-search.index": "strategy",
    "app.vector-search.clusters": "clusters",
    "app.vector-search.nprobe": "nprobe",
    "app.vector-search.candidates": "candidates",
    "app.vector-search.rerank.enabled": "rerank",
    "app.vector-search.rerank.nprobe": "rerank_nprobe",
    "app.vector-search.rerank.candidates": "rerank_candidates",
    "app.fraud.debug": "debug",
}


def _brute_force(queries: DataFrame, refs: DataFrame, index: ix.Index | boxes.Boxes | None, config: SearchConfig) -> DataFrame:
    if isinstance(index, boxes.Boxes):
        return knn.vote(knn.ranked(boxes.nearest(queries, index)), queries)
    return knn.vote(knn.exact_knn(queries, refs), queries)


def _ivf_pq(queries: DataFrame, refs: DataFrame, index: ix.Index | None, config: SearchConfig) -> DataFrame:
    if index is None:
        raise ValueError("ivf_pq needs an index")
    if not config.rerank:
        return knn.vote(ix.search(queries, index, knn.K, config.nprobe, config.candidates), queries)
    return ix.gray_zone(queries, index, refs, knn.K, config.nprobe, config.candidates, config.rerank_nprobe, config.rerank_candidates, config.count_source)


def _hnsw(queries: DataFrame, refs: DataFrame, index: ix.Index | None, config: SearchConfig) -> DataFrame:
    raise NotImplementedError("graph search is not offered; lsh is the approximate search without an index")


def _lsh(queries: DataFrame, refs: DataFrame, index: ix.Index | None, config: SearchConfig) -> DataFrame:
    return knn.vote(lsh_knn(queries, refs), queries)


STRATEGIES = {"brute_force": _brute_force, "ivf_pq": _ivf_pq, "hnsw": _hnsw, "lsh": _lsh}


def lsh_knn(queries: DataFrame, refs: DataFrame, k: int = knn.K, width: float = 2.0, tables: int = 14, projections: int = 3, seed: int = 42) -> DataFrame:
    """Neighbours among references that share a bucket of random projections, by exact distances.

    A table's bucket is the cell of ``projections`` scaled projections.  Buckets are
    lists like those of an index, so big ones are cut, and each part passes on its k
    best for each query only.
    """
    first = refs.where("vector is not null").select(F.size("vector")).first()
    rng = np.random.default_rng(seed)
    shape = (first[0] if first else 1, tables * projections)
    sent = refs.sparkSession.sparkContext.broadcast((rng.standard_normal(shape) / width, rng.random(shape[1])))

    @F.pandas_udf("array<long>")
    def buckets(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        lines, shift = sent.value
        cells = np.floor(np.stack(v.to_numpy()).astype(float) @ lines + shift).astype(np.int64).reshape(len(v), tables, projections)
        own = np.arange(tables, dtype=np.int64)[None, :] + np.zeros((len(v), 1), np.int64)
        for p in range(projections):
            own = own * 1_000_003 + cells[:, :, p]
        return pd.Series(list(own), dtype=object)

    lists = refs.where("vector is not null").select(F.explode(buckets("vector")).alias("cluster"), "ref_id", "vector", "is_fraud")
    probes = queries.where("q is not null").select("q_id", "q", F.posexplode(buckets("q")).alias("probe", "cluster"))
    return knn.ranked(ix.scanned(probes, ix.Index(lists, None, None), k, coarse=False).drop("probe").dropDuplicates(["q_id", "ref_id"]), k)


def votes(queries: DataFrame, refs: DataFrame, config: SearchConfig, index: ix.Index | boxes.Boxes | None = None) -> DataFrame:
    """q_id and fraud_count by the strategy that the configuration names; brute_force takes boxes of the references as an index."""
    if config.strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {config.strategy!r}; there are {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[config.strategy](queries, refs, index, config)


def score_payloads(payloads: DataFrame, refs: DataFrame, config: SearchConfig | None = None, index: ix.Index | boxes.Boxes | None = None, id_col: str = "event_id", digits: int | None = None) -> DataFrame:
    """id_col, fraud_count, fraud_score, approved of each payload that has all its features."""
    whole, _ = features.rejects(features.features(payloads, digits=digits))
    queries = features.assembled(whole, "q").select(F.col(id_col).alias("q_id"), "q")
    found = votes(queries, refs, config or SearchConfig("brute_force"), index)
    return knn.decide(found.select("q_id", "fraud_count")).withColumnRenamed("q_id", id_col)


def explain(queries: DataFrame, neighbours: DataFrame) -> DataFrame:
    """q_id, part, place, name, value: the named places of each query's vector, and its neighbours with label and distance."""
    from vicinal.sources.constants import DIMENSIONS

    names = F.array(*map(F.lit, DIMENSIONS))
    places = queries.select("q_id", F.posexplode("q").alias("i", "value")).select("q_id", F.lit("vector").alias("part"), (F.col("i") + 1).alias("place"), F.try_element_at(names, F.col("i") + 1).alias("name"), F.col("value").cast("double"))
    near = neighbours.select("q_id", F.lit("neighbour").alias("part"), F.col("rk").alias("place"), F.concat(F.col("ref_id").cast("string"), F.when(F.col("is_fraud") == 1, ":fraud").otherwise(":legit")).alias("name"), F.col("d2").alias("value"))
    return places.unionByName(near)
