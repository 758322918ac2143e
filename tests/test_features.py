"""Payloads and features against known vectors."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from vicinal.functions import features
from vicinal.sources import constants, inputs

PAYLOAD = {
    "id": "tx-1329056812",
    "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
    "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]},
    "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.2331036248},
    "last_transaction": None,
}


def changed(**more) -> dict:
    out = json.loads(json.dumps(PAYLOAD))
    for key, value in more.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key].update(value)
        else:
            out[key] = value
    return out


def vectors(spark, *payloads):
    rows = spark.createDataFrame([(k, json.dumps(p) if isinstance(p, dict) else p) for k, p in enumerate(payloads)], "n int, body string")
    found = features.features(inputs.parse_payloads(rows)).orderBy("n").collect()
    return [[r[d] for d in constants.DIMENSIONS] for r in found]


def test_known_vectors(spark):
    last = changed(
        id="tx-3576980410",
        transaction={"amount": 384.88, "installments": 3, "requested_at": "2026-03-11T20:23:35Z"},
        customer={"avg_amount": 769.76},
        merchant={"mcc": "5912"},
        last_transaction={"timestamp": "2026-03-11T14:58:35Z", "km_from_current": 18.8626479774},
    )
    most = changed(
        transaction={"amount": 50000, "installments": 15, "requested_at": "2026-03-09T00:00:00Z"},
        customer={"tx_count_24h": 25, "known_merchants": []},
        merchant={"mcc": "9999"},
        terminal={"is_online": True, "card_present": False, "km_from_home": 2000},
    )
    first, second, third = vectors(spark, PAYLOAD, last, most)
    assert first == pytest.approx([0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006], abs=2e-4)
    assert (second[5], second[6], second[12], second[2]) == pytest.approx((0.2257, 0.0189, 0.20, 0.05), abs=2e-4)
    assert [third[k] for k in (0, 1, 7, 8, 9, 11)] == [1] * 6 and [third[k] for k in (10, 3, 4)] == [0] * 3 and third[12] == 0.5


def test_missing_and_odd_values(spark):
    rows = vectors(
        spark,
        changed(customer={"known_merchants": None}), changed(customer={"known_merchants": ["MERC-016", "MERC-016"]}), changed(merchant={"mcc": "x1"}), changed(merchant={"mcc": "05411"}),
        changed(customer={"avg_amount": 0}), changed(transaction={"amount": None}), changed(terminal={"is_online": None}), changed(last_transaction={"timestamp": "2026-03-12T00:00:00Z", "km_from_current": -1}), "no json", changed(transaction={"installments": 2.9}),
    )
    assert [r[11] for r in rows[:2]] == [1, 0] and [r[12] for r in rows[2:4]] == [0.5, 0.15]
    assert rows[4][2] == 0 and rows[5][0] is None and rows[6][9] == 0 and rows[7][5:7] == [0, 0] and rows[8][0] is None
    assert rows[9][1] == pytest.approx(2 / 12)


def test_rejects(spark):
    rows = spark.createDataFrame([(0, json.dumps(PAYLOAD)), (1, json.dumps(changed(transaction={"amount": None}))), (2, None)], "n int, body string")
    whole, rest = features.rejects(features.features(inputs.parse_payloads(rows)))
    assert [r.n for r in whole.collect()] == [0] and {r.n for r in rest.collect()} == {1, 2}


def test_readers(spark, tmp_path):
    refs = [{"vector": [float(k)] * 14, "label": ("fraud", "legit", None)[k % 3]} for k in range(7)]
    with gzip.open(tmp_path / "refs.json.gz", "wt") as out:
        json.dump(refs, out)
    found = sorted((r.ref_id, r.vector[0], r.is_fraud) for r in inputs.read_references(spark, str(tmp_path / "refs.json.gz")).collect())
    assert found == [(k, float(k), int(k % 3 == 0)) for k in range(7)]
    (tmp_path / "norms.json").write_text(json.dumps(constants.NORMS, indent=1))
    assert constants.read_norms(spark, str(tmp_path / "norms.json")) == constants.NORMS
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError, match="max_amount"):
        constants.read_norms(spark, str(tmp_path / "bad.json"))
    (tmp_path / "mcc.json").write_text('{"5411": 0.15,\n "x": 1,\n "10000": 0.2}')
    assert [(r.mcc, r.risk) for r in constants.read_risks(spark, str(tmp_path / "mcc.json")).collect()] == [(5411, 0.15)]
    (tmp_path / "p.json").write_text(json.dumps([PAYLOAD, PAYLOAD]))
    assert inputs.read_payloads(spark, str(tmp_path / "p.json"), True).count() == 2
    (tmp_path / "test.json").write_text(json.dumps({"entries": [{"request": PAYLOAD, "expected_approved": True}], "stats": {}}))
    (entry,) = inputs.read_entries(spark, str(tmp_path / "test.json")).collect()
    assert entry.expected_approved and entry.request.merchant.mcc == "5411" and entry.request.customer.known_merchants == ["MERC-003", "MERC-016"]


def test_risks_start_no_python_worker(spark):
    found = constants.risk_table(spark)
    assert "RDD" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == sorted(constants.MCC_RISK.items())
    assert [tuple(r) for r in constants.risk_table(spark, {7: 0.25, 3: None}).collect()] == [(3, None), (7, 0.25)]


def test_number_of_properties(spark):
    texts = ['{"k": 0}', '{"k": 76}', '{"k": 123456789}', '{"k": 2147483647}', '{"k":5}', '{"k": -3}', '{"k": 007}', '{"k": "8"}', '{"a": 1, "k": 4}', '{"k": 9} ', '{"k": 9}\n', '{"k": 1', '{"k": null}', "{}", "", "x", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, props string")
    got = {r[0]: r[1] for r in rows.select("i", inputs.number_of(F.col("props"))).collect()}
    assert got == {r[0]: r[1] for r in rows.select("i", F.get_json_object("props", "$.k").cast("int")).collect()}
    assert [got[i] for i in range(5)] == [0, 76, 123456789, 2147483647, 5]
