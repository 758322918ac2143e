"""Scores and telemetry against worked values."""

from __future__ import annotations

import json

import pytest

from vicinal.operators import evaluation


def counts(spark, tp, tn, fp, fn, err):
    return evaluation.detection(spark.createDataFrame([(tp, tn, fp, fn, err)], "tp long, tn long, fp long, fn long, err long")).first()


def test_worked_scores(spark):
    r = counts(spark, 1735, 3210, 40, 15, 0)
    assert (r.weighted_errors, r.epsilon) == (85, 0.017)
    assert r.rate_component == pytest.approx(1769.55, abs=0.01) and r.absolute_penalty == pytest.approx(-580.35, abs=0.01)
    assert r.detection_score == pytest.approx(1189.20, abs=0.01)
    p = spark.createDataFrame([(x,) for x in (5.81, 0.0, 0.5, 2001.0, 1000.0)], "p double").select(evaluation.p99_score(evaluation.F.col("p"))).collect()
    assert [x[0] for x in p] == pytest.approx([2235.82, 0, 3000, -3000, 0], abs=0.02)


def test_cut_and_empty(spark):
    r = counts(spark, 10, 10, 10, 0, 0)
    assert r.cut and r.detection_score == -3000 and r.rate_component is None
    r = counts(spark, 0, 0, 0, 0, 0)
    assert r.epsilon == 0 and r.detection_score == 3000


def test_confusion_and_report(spark):
    log = spark.createDataFrame([(False, False, 200, 1.0), (True, True, 200, 2.0), (True, False, 200, 3.0), (False, True, 200, 4.0), (True, True, 500, 5.0), (True, True, None, 6.0)], "expected_approved boolean, approved boolean, status int, latency_ms double")
    assert tuple(evaluation.confusion(log).first()) == (1, 1, 1, 1, 2)
    found = json.loads(evaluation.report(log).first()[0])
    scoring = found["scoring"]
    assert scoring["breakdown"] == {"false_positive_detections": 1, "false_negative_detections": 1, "true_positive_detections": 1, "true_negative_detections": 1, "http_errors": 2}
    assert scoring["failure_rate"] == "66.67%" and found["p99"] == "5.95ms" and scoring["weighted_errors_E"] == 14
    assert scoring["detection_score"] == {"value": -3000, "rate_component": None, "absolute_penalty": None, "cut_triggered": True}
    assert scoring["p99_score"] == {"value": pytest.approx(2225.48, abs=0.01), "cut_triggered": False}
    assert found["expected"] == {"total": 6, "fraud_count": 2, "legit_count": 4, "fraud_rate": 33.33, "legit_rate": 66.67}
    assert json.loads(evaluation.report(log, '{"total": 9}').first()[0])["expected"] == {"total": 9}
    none = json.loads(evaluation.report(log.limit(0)).first()[0])["scoring"]
    assert none["p99_score"]["value"] == 0 and none["failure_rate"] == "0%" and none["final_score"] == 3000


def test_numbers_as_json(spark):
    from pyspark.sql import functions as F

    values = [0.0, -0.001, 100.0, 1.5, 2235.8237, -3000.0, 0.000123, None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(evaluation.number(F.col("x"), 2)).collect()
    assert [r[0] for r in rows] == ["0", "0", "100", "1.5", "2235.82", "-3000", "0", "null"]


@pytest.mark.parametrize("keep", [1, 7, 1 << 20])
def test_percentile_is_exact(spark, keep):
    import numpy as np

    rng = np.random.default_rng(4)
    for x in (rng.exponential(3, 900), np.repeat([1.0, 2.0, 50.0], [500, 399, 1]), np.array([7.5]), np.round(rng.random(300), 1)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(3)
        for share in (0.0, 0.5, 0.99, 1.0):
            assert evaluation.percentile(df, "v", share, keep, 16) == pytest.approx(np.quantile(x, share))
    assert evaluation.percentile(df.limit(0), "v", 0.5) is None


def test_telemetry(spark):
    ms = [0.5, 0.99, 1, 4.9, 5, 60, 499, 500, 9000]
    log = spark.createDataFrame([("search", int(x * 1e6)) for x in ms], "phase string, duration_ns long")
    assert {r.label: r.n for r in evaluation.histogram(log).collect()} == {"<1ms": 2, "1-5ms": 2, "5-10ms": 1, "50-100ms": 1, "100-500ms": 1, ">=500ms": 2}
    p = evaluation.bucket_percentiles(log).first()
    assert (p.p50_ms, p.p90_ms, p.p99_ms) == (10, 500, 500)
    assert evaluation.slow(log).count() == 4
    votes = spark.createDataFrame([(q, q % 6) for q in range(12)], "q_id long, fraud_count int")
    g = evaluation.gray_rate(votes).first()
    assert (g.total, g.gray) == (12, 4) and g.pct == pytest.approx(33.333333)
    assert evaluation.gray_rate(votes.limit(0)).first().pct == 0
    found = json.loads(evaluation.stats(log, votes).first()[0])
    assert found["total_requests"] == 0 and found["phases"] == {p: {"count": 0} for p in evaluation.PHASES}
    text = evaluation.stats(log.unionByName(spark.createDataFrame([("total", 1_234_500), ("total", 3)], log.schema)), votes).first()[0]
    found = json.loads(text)
    assert found["total_requests"] == 2 and list(found["phases"]) == list(evaluation.PHASES) and found["gray_zone"] == {"count": 4, "pct": 33.33}
    assert found["phases"]["search"]["buckets"] == {"<1ms": 2, "1-5ms": 2, "5-10ms": 1, "10-50ms": 0, "50-100ms": 1, "100-500ms": 1, ">=500ms": 2}
    assert '"total":{"count":2,"avg_ms":0.617,"max_ms":1.235,"p50_ms":1.0,"p90_ms":5.0,"p99_ms":5.0,' in text
    assert '"parse":{"count":0,"avg_ms":0.000,"max_ms":0.000,"p50_ms":0.0,' in text


def test_elbow(spark):
    pick = lambda rows: evaluation.elbow(spark.createDataFrame(rows, "k int, wcss double")).first()[0]
    assert pick([(1, 100.0), (2, 40.0), (3, 20.0), (4, 15.0), (5, 12.0)]) in (2, 3)
    assert pick([(1, 5.0), (2, 4.0)]) == 2 and pick([(1, 5.0), (2, 5.0), (3, 5.0)]) == 1


def test_sinks(spark, tmp_path):
    from vicinal.operators import knn
    from vicinal.sources import sinks

    votes = spark.createDataFrame([(1, 3)], "q_id long, fraud_count int")
    sinks.write_answers(knn.response(knn.decide(votes)), str(tmp_path / "a"))
    sinks.write_csv(votes, str(tmp_path / "b"))
    sinks.write_report(votes.selectExpr("'{}' AS report"), str(tmp_path / "c"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "a")).collect()] == ['{"approved":false,"fraud_score":0.6000}']
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).columns == ["q_id", "fraud_count"]
    assert spark.read.text(str(tmp_path / "c")).count() == 1


def test_readers_of_a_load_test(spark, tmp_path):
    from vicinal.sources import inputs

    path = tmp_path / "entries.json"
    path.write_text(json.dumps(indent=2, obj={"stats": {"total": 2}, "entries": [{"request": {"id": "a"}, "expected_approved": True}, {"request": {"id": "b"}, "expected_approved": False}]}))
    assert json.loads(inputs.read_expected(spark, str(path))) == {"total": 2}
    assert [(r.number, r.request.id, r.expected_approved) for r in inputs.numbered_entries(spark, str(path)).orderBy("number").collect()] == [(0, "a", True), (1, "b", False)]


def test_malformed_payloads_are_kept(spark, tmp_path):
    from vicinal.streaming import scoring

    (tmp_path / "in").mkdir()
    good = {"id": "tx", "event_id": 1, "transaction": {"amount": 10.0, "installments": 1, "requested_at": "2026-01-01T00:00:00Z"}, "customer": {"avg_amount": 5.0, "tx_count_24h": 1, "known_merchants": []}, "merchant": {"id": "m", "mcc": "5411", "avg_amount": 3.0}, "terminal": {"is_online": True, "card_present": False, "km_from_home": 1.0}}
    (tmp_path / "in" / "a.json").write_text(json.dumps(good) + "\n{broken\n" + json.dumps({"event_id": 2}) + "\n")
    refs = spark.createDataFrame([(k, [0.0] * 14, int(k < 3)) for k in range(5)], "ref_id long, vector array<double>, is_fraud int")
    stream = scoring.payload_stream(spark, str(tmp_path / "in"), "event_id bigint")
    scoring.score_stream(stream, refs, str(tmp_path / "out"), str(tmp_path / "state"), rejects=str(tmp_path / "bad")).awaitTermination()
    assert [(r.event_id, r.fraud_count, r.approved) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 3, False)]
    bad = sorted(r[0] for r in spark.read.text(str(tmp_path / "bad")).collect())
    assert len(bad) == 2 and bad[1] == "{broken" and json.loads(bad[0])["event_id"] == 2
    scoring.MOST_REFERENCES, most = 8, scoring.MOST_REFERENCES
    try:
        with pytest.raises(ValueError, match="score_stream"):
            scoring.decisions(stream, refs)
    finally:
        scoring.MOST_REFERENCES = most


def test_rate_of_a_load_test(spark):
    from vicinal.streaming import scoring

    entries = spark.createDataFrame([(0, "a", True)], "number long, request string, expected_approved boolean")
    assert scoring.load_stream(spark, entries).isStreaming and scoring.load_stream(spark, entries, most=1).columns == ["number", "timestamp", "request", "expected_approved"]


def test_a_load_test_is_not_cut(spark, tmp_path):
    from vicinal.streaming import scoring

    entries = spark.createDataFrame([(i, "a", True) for i in range(200)], "number long, request string, expected_approved boolean")
    writer = lambda at, size: scoring.load_stream(spark, entries, most=200, rows_per_batch=size).writeStream.format("parquet").option("path", str(tmp_path / at)).option("checkpointLocation", str(tmp_path / f"{at}-state"))
    with pytest.raises(TimeoutError):
        scoring.run_until(writer("short", 1), 200, 1, seconds=1)
    scoring.run_until(writer("whole", 50), 200, 50)
    assert spark.read.parquet(str(tmp_path / "whole")).count() == 200


def test_a_stream_deals_its_references_once(spark, tmp_path, monkeypatch):
    from vicinal.operators import boxes
    from vicinal.streaming import scoring

    payload = lambda i: {"id": f"tx-{i}", "event_id": i, "transaction": {"amount": 100.0 * i, "installments": 1, "requested_at": "2026-01-01T00:00:00Z"}, "customer": {"avg_amount": 5.0, "tx_count_24h": 1, "known_merchants": []}, "merchant": {"id": "m", "mcc": "5411", "avg_amount": 3.0}, "terminal": {"is_online": True, "card_present": False, "km_from_home": 1.0}}
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(payload(10 * i + j)) for j in range(10)))
    refs = spark.createDataFrame([(k, [k / 300] + [0.1] * 13, k // 7 % 2) for k in range(300)], "ref_id long, vector array<double>, is_fraud int")
    stream = scoring.payload_stream(spark, str(tmp_path / "in"), "event_id bigint")
    scoring.score_stream(stream, refs, str(tmp_path / "plain"), str(tmp_path / "state")).awaitTermination()
    made, old = [], boxes.build
    monkeypatch.setattr(boxes, "build", lambda *a, **b: made.append(old(*a, **b)) or made[-1])
    monkeypatch.setattr(boxes, "LEAF", 20)
    monkeypatch.setattr(scoring, "MOST_PLAIN", 10)
    one = spark.readStream.schema(stream.schema).option("columnNameOfCorruptRecord", scoring.MALFORMED).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    scoring.score_stream(one, refs, str(tmp_path / "boxes"), str(tmp_path / "state2")).awaitTermination()
    rows = lambda at: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / at)).drop("batch").collect())
    assert rows("boxes") == rows("plain") and len(rows("plain")) == 30 and len(made) == 1 and spark.read.parquet(str(tmp_path / "boxes")).select("batch").distinct().count() == 3


def test_more_references_than_a_task_holds(spark, sf_dir, monkeypatch):
    """Blocks of references, each held alone, give the decisions of all at once."""
    from vicinal.operators import boxes
    from vicinal.plans.queries import QUERIES
    from vicinal.streaming import scoring

    plain = sorted(QUERIES["stream_decisions_direct"](spark, sf_dir).collect())
    blocks, old = [], boxes.Boxes.blocks
    monkeypatch.setattr(boxes.Boxes, "blocks", lambda self, size: [blocks.append(x) or x for x in old(self, size)])
    for of, name, value in ((boxes, "LEAF", 50), (scoring, "MOST_REFERENCES", 8), (scoring, "BLOCK", 20_000), (scoring, "ASKED", 7)):
        monkeypatch.setattr(of, name, value)
    assert sorted(QUERIES["stream_decisions_direct"](spark, sf_dir).collect()) == plain and plain
    assert len(blocks) > 3 and [first for first, _, _ in blocks[1:]] == [last for _, last, _ in blocks[:-1]]
