"""Exact and indexed search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.functions import distance
from vicinal.operators import engine, evaluation, knn
from vicinal.operators import index as ix


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.random((300, 8)), 2)
    x[100:110] = x[0]  # ties
    refs = spark.createDataFrame([(i, v.tolist(), int(i % 3 == 0)) for i, v in enumerate(x)], "ref_id long, vector array<double>, is_fraud int").repartition(4)
    return x, refs, refs.where("ref_id % 50 = 0").select(F.col("ref_id").alias("q_id"), F.col("vector").alias("q"))


def plain(x, q, k=5):
    d = ((x[q] - x) ** 2).sum(1)
    return sorted(range(len(x)), key=lambda i: (round(d[i], 9), i))[:k]


def found(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: r.rk):
        out.setdefault(r.q_id, []).append(r.ref_id)
    return out


def test_worked_example(spark):
    refs = spark.createDataFrame([(1, [0.01, 0.08, 0.05], 0), (2, [0.58, 0.92, 1.0], 1), (4, [1.0, 0.95, 1.0], 1)], "ref_id long, vector array<double>, is_fraud int")
    near = knn.exact_knn(spark.createDataFrame([(0, [1.0, 0.96, 0.96])], "q_id long, q array<double>"), refs, 3).orderBy("rk").collect()
    assert [r.ref_id for r in near] == [4, 2, 1] and near[0].d2 ** 0.5 == pytest.approx(0.0412, abs=1e-3)


def test_exact_with_ties(rows, monkeypatch):
    x, refs, queries = rows
    monkeypatch.setattr(knn, "QUERY_BLOCK", 100)  # several blocks of queries and of references
    monkeypatch.setattr(knn, "REF_BLOCK", 40)
    assert found(knn.exact_knn(queries, refs)) == {q: plain(x, q) for q in range(0, 300, 50)}
    assert knn.exact_knn(queries.limit(0), refs).count() == 0 and knn.exact_knn(queries, refs.limit(0)).count() == 0


def test_expressions_and_matrices_agree(spark):
    a, b = [0.1, 0.5, 0.9], [0.3, 0.2, 0.8]
    row = spark.createDataFrame([(a, b, [0.0, 0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(*(f(F.col("a"), F.col("b")) for f in (distance.l2_squared, distance.manhattan, distance.cosine)), distance.cosine(F.col("a"), F.col("z"))).first()
    for got, metric in zip(row[:3], distance.METRICS, strict=True):
        assert got == pytest.approx(distance.matrix(np.array([a]), np.array([b]), metric)[0, 0])
    assert row[3] is None
    distance.register(spark)
    assert spark.sql("SELECT l2_sq(array(0D, 1D), array(1D, 3D))").first()[0] == 5
    with pytest.raises(ValueError, match="metric"):
        distance.matrix(np.zeros((1, 2)), np.zeros((1, 2)), "other")


def test_vote_and_decision(spark):
    rows = [(q, k + 1, k, 0.0, int(k < q)) for q in range(6) for k in range(5)]
    out = knn.response(knn.decide(knn.vote(spark.createDataFrame(rows, "q_id long, rk int, ref_id long, d2 double, is_fraud int")))).orderBy("q_id").collect()
    assert [(r.fraud_score, r.approved) for r in out] == [(0.0, True), (0.2, True), (0.4, True), (0.6, False), (0.8, False), (1.0, False)]
    assert out[3].body == '{"approved":false,"fraud_score":0.6000}'


def test_index(spark, rows, tmp_path):
    x, refs, queries = rows
    index = ix.build(refs, ix.seeded_centres(refs, 8), ix.seeded_codebook(refs, 4, 16))
    assert index.lists.count() == 300 and index.lists.select("ref_id").distinct().count() == 300
    exact = {q: plain(x, q) for q in range(0, 300, 50)}
    assert found(ix.scan(ix.probe(queries, index.centres, 8), index, 5, coarse=False)) == exact
    # All lists and all rows: reranking gives the exact result, and so do both passes.
    path = str(tmp_path / "index")
    ix.write(index, path)
    again = ix.read(spark, path)
    assert evaluation.ready(spark, path) and not evaluation.ready(spark, path + "x")
    assert found(ix.rerank(queries, ix.scan(ix.probe(queries, again.centres, 8), again, 300), refs)) == exact
    wide = ix.gray_zone(queries, again, refs, 5, 8, 300, 8, 300)
    votes = {q: sum(i % 3 == 0 for i in n) for q, n in exact.items()}
    assert {r.q_id: r.fraud_count for r in wide.collect()} == votes
    assert all(r.widened == (votes[r.q_id] in (2, 3)) for r in wide.collect())
    recall = {(r.nprobe, r.candidates): r.recall for r in evaluation.sweep(queries, index, refs, nprobes=(1, 8), candidates=(10, 300)).collect()}
    assert recall[8, 300] == 1.0 and recall[1, 300] <= recall[8, 300]


def test_benchmark(rows):
    x, refs, queries = rows
    index = ix.build(refs, ix.seeded_centres(refs, 4), ix.seeded_codebook(refs, 4, 16))
    found = evaluation.benchmark(queries, index, refs, nprobes=(1, 4), candidates=(300,)).collect()
    assert [(r.nprobe, r.candidates) for r in found] == [(1, 300), (4, 300)] and found[1].recall == 1.0 >= found[0].recall
    assert all(r.avg_ms > 0 and r.qps == pytest.approx(1000 / r.avg_ms) for r in found)


def test_long_lists_are_cut(rows, monkeypatch):
    x, refs, queries = rows
    monkeypatch.setattr(ix, "LIST_BLOCK", 20)
    monkeypatch.setattr(ix, "PROBE_BLOCK", 2)
    index = ix.build(refs, ix.seeded_centres(refs, 2), ix.seeded_codebook(refs, 4, 16))
    assert found(ix.scan(ix.probe(queries, index.centres, 2), index, 5, coarse=False)) == {q: plain(x, q) for q in range(0, 300, 50)}


def test_refusals(spark, rows):
    x, refs, queries = rows
    index = ix.build(refs, ix.seeded_centres(refs, 2), ix.seeded_codebook(refs, 4, 4))
    with pytest.raises(ValueError, match="candidates"):
        ix.search(queries, index, candidates=3)
    with pytest.raises(ValueError, match="equal parts"):
        ix.seeded_codebook(refs, 3, 4)
    with pytest.raises(ValueError, match="unknown strategy"):
        engine.votes(queries, refs, engine.SearchConfig("other"))
    with pytest.raises(NotImplementedError):
        engine.votes(queries, refs, engine.SearchConfig("hnsw"))
    with pytest.raises(ValueError, match="needs an index"):
        engine.votes(queries, refs, engine.SearchConfig("ivf_pq"))
    with pytest.raises(ValueError, match="count source"):
        ix.gray_zone(queries, index, refs, count_source="x")


def test_configuration():
    got = engine.SearchConfig.from_environment(environment={"VICINAL_NPROBE": "7", "VICINAL_RERANK": "false", "VICINAL_STRATEGY": "brute_force"})
    assert (got.nprobe, got.rerank, got.strategy, got.candidates) == (7, False, "brute_force", 10)


def test_configuration_file():
    text = """# comment
app:
  vector-search:
    index: "brute_force" #"ivf_pq"
    clusters: 128
    rerank:
      enabled: false
      nprobe: 3
  fraud:
    debug: true
other:
  nprobe: 99
"""
    got = engine.SearchConfig.from_file(text)
    assert (got.strategy, got.clusters, got.rerank, got.rerank_nprobe, got.nprobe, got.debug) == ("brute_force", 128, False, 3, 16, True)
    assert engine.SearchConfig.from_environment(environment={"VICINAL_CLUSTERS": "7"}, start=got).clusters == 7 and got.clusters == 128


def test_empty_clusters_get_a_vector(rows):
    x, refs, _ = rows
    far = np.vstack([ix.seeded_centres(refs, 3), np.full((2, 8), 99.0)])
    once, again = ix.lloyd(refs, far), ix.lloyd(refs, far)
    assert np.array_equal(once, again) and all(any(np.array_equal(c, v) for v in x) for c in once[3:])
    same = refs.withColumn("vector", F.array(*[F.lit(1.0)] * 7, (F.col("ref_id") % 4).cast("double")))
    assert len(ix.train_centres(same, 4, rounds=3)) == 4 and len(ix.train_centres(same, 6, rounds=3)) == 4


def test_sample_is_cut_before_it_is_ordered(rows):
    from hashlib import md5

    _, refs, _ = rows
    want = sorted(range(300), key=lambda i: md5(f"42:{i}".encode()).hexdigest())[:17]
    assert [r.ref_id for r in ix.sampled(refs, 17).collect()] == want


def test_hashed_buckets_find_most_neighbours(rows, monkeypatch):
    x, refs, queries = rows
    monkeypatch.setattr(ix, "LIST_BLOCK", 50)
    near = found(engine.lsh_knn(queries, refs))
    exact = {q: plain(x, q) for q in range(0, 300, 50)}
    assert sum(len(set(near[q]) & set(exact[q])) for q in exact) >= 0.9 * 5 * len(exact)


def test_training(rows):
    x, refs, _ = rows
    centres = ix.train_centres(refs, 6, rounds=10)
    trained = evaluation.wcss(refs, centres).first()[0]
    assert trained < evaluation.wcss(refs, ix.seeded_centres(refs, 6)).first()[0]
    plain_wcss = sum(min(((v - c) ** 2).sum() for c in centres) for v in x)
    assert trained == pytest.approx(plain_wcss)
    once = ix.lloyd(refs, ix.seeded_centres(refs, 6))
    near = ix.nearest(x, ix.seeded_centres(refs, 6))
    assert np.allclose(once, [x[near == c].mean(0) for c in range(6)])
    assert len(ix.train_codebook(refs, 2, 8, rounds=3).centres) == 2
    a, b = (sorted(r[0] for r in ix.sampled(refs, 40).select("ref_id").collect()) for _ in range(2))
    assert a == b and len(a) == 40


@pytest.mark.parametrize("name", ["ivf_search_trained", "rerank_exact_trained"])
def test_trained_searches_find_the_neighbours(spark, sf_dir, name):
    from vicinal.plans.queries import QUERIES

    exact = {(r.q_id, r.ref_id) for r in QUERIES["knn_exact_embeddings"](spark, sf_dir).collect()}
    found = {(r.q_id, r.ref_id) for r in QUERIES[name](spark, sf_dir).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("leaf", [2048, 40])
def test_boxes_give_the_same_rows(spark, monkeypatch, leaf):
    """Copies, ties, places that are no number and queries far from all: boxes find what the plain search finds, at no pair more than once."""
    from vicinal.operators import boxes

    rng = np.random.default_rng(5)
    x = np.concatenate([np.round(rng.random((900, 4)), 1), np.repeat(np.round(rng.random((4, 4)), 2), 60, axis=0)])
    rows = [(3 * i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(1, None, 1), (2, [0.5, float("nan"), 0.5, 0.5], 1)]
    refs = spark.createDataFrame(rows, "ref_id long, vector array<double>, is_fraud int").repartition(3)
    q = refs.where("ref_id % 5 = 0").selectExpr("ref_id AS q_id", "vector AS q").union(spark.createDataFrame([(-1, [9.0, -9.0, 3.0, 0.0]), (-2, None)], "q_id long, q array<double>"))
    plain = sorted(knn.exact_knn(q, refs).collect())
    for name, value in (("LEAF", leaf), ("UNIT", 32), ("ASKED", 50), ("SAMPLE", 400)):
        monkeypatch.setattr(boxes, name, value)
    made, old = [], boxes.build
    monkeypatch.setattr(boxes, "build", lambda *a: made.append(old(*a)) or made[-1])
    monkeypatch.setattr(knn, "MOST_PAIRS", 0)
    assert sorted(knn.exact_knn(q, refs).collect()) == plain and len(plain) > 900
    # Copies beyond the fifth of a vector are nobody's neighbours, and small leaves leave most references unvisited.
    n = made[0].units.agg({"n": "sum"}).first()[0]
    assert len(made) == 1 and n < 1140 and (leaf > 40 or len(made[0].near(np.array([[0.5, 0.5, 0.5, 0.5]]), np.array([0.02]))[1]) < made[0].start[-1] / 2)


def test_boxes_without_references(spark):
    from vicinal.operators import boxes

    assert boxes.build(spark.createDataFrame([(1, None, 1)], "ref_id long, vector array<double>, is_fraud int")) is None


def by_boxes(spark, sf_dir, monkeypatch, name):
    """Rows of a query by the plain search and by boxes, and how many boxes were made."""
    from vicinal.operators import boxes
    from vicinal.plans.queries import QUERIES

    plain = sorted(QUERIES[name](spark, sf_dir).collect(), key=repr)
    made, old = [], boxes.build
    monkeypatch.setattr(boxes, "build", lambda *a, **b: made.append(old(*a, **b)) or made[-1])
    monkeypatch.setattr(boxes, "LEAF", 100)
    monkeypatch.setattr(knn, "MOST_PAIRS", 0)
    return plain, sorted(QUERIES[name](spark, sf_dir).collect(), key=repr), len(made)


def test_explained_by_boxes(spark, sf_dir, monkeypatch):
    plain, rows, made = by_boxes(spark, sf_dir, monkeypatch, "decision_explain")
    assert rows == plain and rows and made == 1


def test_decided_by_boxes(spark, sf_dir, monkeypatch):
    plain, rows, made = by_boxes(spark, sf_dir, monkeypatch, "fraud_decision_transactions")
    assert rows == plain and rows and made == 1


def test_candidates_follow_the_measured_recall(spark):
    x = np.random.default_rng(8).standard_normal((1500, 8))
    refs = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "ref_id long, vector array<double>, is_fraud int").repartition(3)
    index = ix.build(refs, ix.seeded_centres(refs, 4), ix.seeded_codebook(refs, 2, 8))
    assert evaluation.tuned(refs, index, 4, 10, 0.0, queries=60) == 10
    n = evaluation.tuned(refs, index, 4, 10, 0.9, queries=60)
    q = refs.where("ref_id % 20 = 0").select(F.col("ref_id").alias("q_id"), F.col("vector").alias("q"))
    share = lambda n: evaluation.recall(ix.rerank(q, ix.scan(ix.probe(q, index.centres, 4), index, n), refs), knn.exact_knn(q, refs)).first()["recall"]
    assert n > 10 and share(10) < 0.8 < share(n)
    assert evaluation.tuned(refs, index, 4, 10, 1.1, queries=10) == 1500


def test_every_transaction_is_decided(spark, sf_dir):
    from vicinal.plans.queries import QUERIES

    ids = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect())
    assert sorted(r.event_id for r in QUERIES["fraud_decision_transactions"](spark, sf_dir).collect()) == ids


@pytest.mark.parametrize(("leaf", "inner"), [(2048, 30), (40, 8)])
def test_votes_of_all_by_boxes(spark, monkeypatch, leaf, inner):
    """Copies beyond a unit, ties and places that are no number: every row is counted, as by the plain search."""
    from vicinal.operators import boxes

    rng = np.random.default_rng(6)
    x = np.concatenate([np.round(rng.random((700, 4)), 1), np.repeat(np.round(rng.random((4, 4)), 2), 60, axis=0), rng.random((60, 4)) ** 3])
    rows = [(3 * i, v.tolist(), i % 3 % 2) for i, v in enumerate(x)] + [(1, None, 1), (2, [0.5, float("nan"), 0.5, 0.5], 1), (4, [9.0, -9.0, 3.0, 0.0], 1)]
    refs = spark.createDataFrame(rows, "ref_id long, vector array<double>, is_fraud int").repartition(3)
    plain = sorted(knn.votes_of_all(refs).collect())
    assert len(plain) == len(rows)
    for name, value in (("LEAF", leaf), ("UNIT", 32), ("ASKED", 50), ("SAMPLE", 400), ("INNER", inner)):
        monkeypatch.setattr(boxes, name, value)
    monkeypatch.setattr(knn, "MOST_PAIRS", 0)
    assert sorted(knn.votes_of_all(refs).collect()) == plain


@pytest.mark.parametrize("block", [1 << 18, 70])
def test_reranked_in_blocks(rows, monkeypatch, block):
    """One look at all lists finds what probing, scanning and reranking one after another find, rows in one block or many."""
    _, refs, _ = rows
    q = refs.where("ref_id % 3 = 0").select(F.col("ref_id").alias("q_id"), F.col("vector").alias("q"))
    index = ix.build(refs, ix.seeded_centres(refs, 8), ix.seeded_codebook(refs, 4, 16))
    plain = sorted(ix.rerank(q, ix.scan(ix.probe(q, index.centres, 3), index, 12), refs).collect())
    monkeypatch.setattr(knn, "REF_BLOCK", block)
    monkeypatch.setattr(ix, "RERANK_BLOCK", 30)
    assert sorted(ix.reranked(q, index, 5, 3, 12).collect()) == plain and len(plain) == 500


def test_screening_loses_no_pair():
    """What a product of matrices leaves is compared place by place: ties, equal rows, rows that don't count, huge values and values that are no number."""
    rng = np.random.default_rng(3)
    r = np.concatenate([np.round(rng.random((200, 6)), 1), rng.random((50, 6)) * 1e-8 + 1e3, np.round(rng.random((20, 6)), 1)])
    q, out = np.concatenate([r[::7], rng.random((5, 6))]), rng.random((44, 270)) < 0.3
    for x in (r, np.where(rng.random(r.shape) < 0.01, np.nan, r), r * 1e160):
        for mask in (None, out):
            d = distance.matrix(q, x)
            d[out if mask is not None else np.zeros_like(out)] = np.nan
            i, j = distance.screened(q, x, 5, np.full(len(q), np.inf), mask)
            found = distance.paired(q[i], x[j])
            keep = knn.top(i, found, j, 5)
            assert np.array_equal(found, d[i, j])
            want = [(a, b) for a in range(len(q)) for b in np.lexsort((np.arange(270), d[a]))[:5] if not np.isnan(d[a, b])]
            assert [p for p in zip(i[keep], j[keep], strict=True) if not np.isnan(d[p])] == want
