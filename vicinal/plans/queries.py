"""Queries over the event and embedding tables, one for each operator, and their SQL where there is any.

Searches take as queries every row whose id is a multiple of 50, against all rows;
fraud_decision_transactions decides on every row.  Centres and codes of the seeded indexes are the vectors of the least ids, so
their results are the same in any engine.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal import storage
from vicinal.functions import distance, features
from vicinal.operators import engine, evaluation, knn
from vicinal.operators import index as ix
from vicinal.sources import inputs, sinks
from vicinal.sources.constants import DIMENSIONS, MCC_RISK, NORMS, read_norms, read_risks

EVERY = 50
CLUSTERS, PARTS, CODES = 16, 8, 32
NPROBE, FOUND = 4, 20
WIDE_NPROBE, WIDE_FOUND = 8, 40
#: Of the trained index, whose recall is 0.9 or more; the seeded one above is for results that SQL can give too.
TRAINED_PARTS, TRAINED_CODES, TRAINED_NPROBE, TRAINED_FOUND = 16, 32, 12, 100
TRAINED_WIDE_NPROBE, TRAINED_WIDE_FOUND = 16, 200
SWEEP_NPROBES, SWEEP_FOUND = (1, 2, 4, 8, 16), (10, 20, 50)
ELBOW_KS = (2, 4, 6, 8, 12, 16, 24, 32)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.embedding_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def asked(refs: DataFrame) -> DataFrame:
    return refs.where(F.col("ref_id") % EVERY == 0).select(F.col("ref_id").alias("q_id"), F.col("vector").alias("q"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all events, by way of payload texts, rounded to six places."""
    p = inputs.payloads_of_events(events(spark, sf_dir))
    body = F.to_json(F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction"), {"ignoreNullFields": "false"})
    return features.features(inputs.parse_payloads(p.select("event_id", "is_fraud", body.alias("body"))), digits=6)


# --- SQL that several queries begin with ---------------------------------------------------------

_CODES = ", ".join(f"'{c}'" for c in inputs._CODES)
_RISKS = ", ".join(f"({k}, {v}::DOUBLE)" for k, v in MCC_RISK.items())

SQL_TX = f"""
keyed AS (
    SELECT event_id, user_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events
), tx AS (
    SELECT *, coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS avg_amount,
        count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS tx_count,
        row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) > 1 AS known,
        lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_k,
        lag(sec) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_sec,
        CAST(event_type = 'error' AS INTEGER) AS is_fraud, list_extract([{_CODES}], k % 11 + 1) AS mcc
    FROM keyed
)"""

_HELD = "least(greatest({0}, 0.0::DOUBLE), 1.0::DOUBLE)"
_FEATURES_SQL = {
    "amount": _HELD.format(f"value / {NORMS['max_amount']}::DOUBLE"),
    "installments": _HELD.format(f"(1 + k % 12) / {NORMS['max_installments']}::DOUBLE"),
    "amount_vs_avg": "CASE WHEN avg_amount > 0 THEN " + _HELD.format(f"value / avg_amount / {NORMS['amount_vs_avg_ratio']}::DOUBLE") + " ELSE 0.0 END",
    "hour_of_day": "hour(ts) / 23.0::DOUBLE",
    "day_of_week": "(isodow(ts) - 1) / 6.0::DOUBLE",
    "minutes_since_last_tx": "CASE WHEN last_sec IS NULL THEN -1.0 ELSE " + _HELD.format(f"floor((sec - last_sec) / 60.0) / {NORMS['max_minutes']}::DOUBLE") + " END",
    "km_from_last_tx": "CASE WHEN last_sec IS NULL THEN -1.0 ELSE " + _HELD.format(f"((k * 13) % 1200) / {NORMS['max_km']}::DOUBLE") + " END",
    "km_from_home": _HELD.format(f"((k * 37) % 1500) / {NORMS['max_km']}::DOUBLE"),
    "tx_count_24h": _HELD.format(f"tx_count / {NORMS['max_tx_count_24h']}::DOUBLE"),
    "is_online": "CAST(event_type IN ('view', 'click') AS INTEGER)",
    "card_present": "CAST(event_type = 'purchase' AS INTEGER)",
    "unknown_merchant": "CAST(NOT (known OR coalesce(before_k = k, false)) AS INTEGER)",
    "mcc_risk": "coalesce(risk, 0.5)",
    "merchant_avg_amount": _HELD.format(f"10 * k / {NORMS['max_merchant_avg_amount']}::DOUBLE"),
}
SQL_FEATURES = SQL_TX + f""", risks(code, risk) AS (VALUES {_RISKS}), feats AS (
    SELECT event_id, is_fraud, {", ".join(f"CAST(round({v}, 6) AS DOUBLE) AS {k}" for k, v in _FEATURES_SQL.items())}
    FROM tx LEFT JOIN risks ON code = CAST(mcc AS INTEGER)
)"""


def _l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def _sql_knn(d: str, k: int = knn.K) -> str:
    return f"""dist AS (SELECT q_id, ref_id, is_fraud, {d} AS d2 FROM queries, refs),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, ref_id) AS rk FROM dist) WHERE rk <= {k})"""


SQL_EMB = f"""refs AS (SELECT vec_id AS ref_id, embedding AS vector, CAST(label >= 7 AS INTEGER) AS is_fraud FROM embeddings),
queries AS (SELECT ref_id AS q_id, vector AS q FROM refs WHERE ref_id % {EVERY} = 0)"""
SQL_EMB_NN = f"{SQL_EMB}, {_sql_knn(_l2('q', 'vector'))}"
SQL_TX_NN = SQL_FEATURES + f""", refs AS (SELECT event_id AS ref_id, is_fraud, [{", ".join(DIMENSIONS)}] AS vector FROM feats),
queries AS (SELECT ref_id AS q_id, vector AS q FROM refs WHERE ref_id % {EVERY} = 0), {_sql_knn(_l2('q', 'vector'))}"""
_VOTE = "votes AS (SELECT q_id, CAST(sum(is_fraud) AS INTEGER) AS fraud_count FROM nn GROUP BY q_id)"
_NN_OUT = "SELECT q_id, CAST(rk AS INTEGER) AS rk, ref_id, round(d2, 6) + 0.0::DOUBLE AS d2, is_fraud FROM nn"

SQL_CLUSTERS = f"""cents AS (SELECT CAST(row_number() OVER (ORDER BY ref_id) - 1 AS INTEGER) AS cluster, vector AS c FROM refs ORDER BY ref_id LIMIT {CLUSTERS}),
near AS (SELECT ref_id, is_fraud, vector, cluster, {_l2('vector', 'c')} AS dc FROM refs, cents),
lists AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY dc, cluster) AS r FROM near) WHERE r = 1),
asked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dq, cluster) AS probe FROM (SELECT q_id, q, cluster, {_l2('q', 'c')} AS dq FROM queries, cents))"""
_WIDTH = 64 // PARTS
_PART = f"list_slice({{0}}, m * {_WIDTH} + 1, (m + 1) * {_WIDTH})"
SQL_PQ = f"""ms AS (SELECT unnest(range({PARTS})) AS m),
book AS (SELECT m, CAST(row_number() OVER (PARTITION BY m ORDER BY ref_id) - 1 AS INTEGER) AS code, {_PART.format('vector')} AS c FROM (SELECT * FROM refs ORDER BY ref_id LIMIT {CODES}), ms),
encoded AS (SELECT ref_id, m, code FROM (SELECT ref_id, m, code, row_number() OVER (PARTITION BY ref_id, m ORDER BY dd, code) AS r
    FROM (SELECT ref_id, refs_m.m, code, {_l2('part', 'c')} AS dd FROM (SELECT ref_id, m, {_PART.format('vector')} AS part FROM refs, ms) AS refs_m JOIN book ON refs_m.m = book.m)) WHERE r = 1),
adc AS (SELECT q_id, q_m.m, code, {_l2('part', 'c')} AS dd FROM (SELECT q_id, m, {_PART.format('q')} AS part FROM queries, ms) AS q_m JOIN book ON q_m.m = book.m)"""


def _sql_scan(name: str, nprobe: int, found: int) -> str:
    """The best of the probed lists by quantized distance; summed in the order of parts."""
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, ref_id) AS rk FROM (
    SELECT asked.q_id, lists.ref_id, any_value(lists.is_fraud) AS is_fraud, list_sum(list(adc.dd ORDER BY adc.m)) AS d2
    FROM asked JOIN lists USING (cluster) JOIN encoded ON encoded.ref_id = lists.ref_id JOIN adc ON adc.q_id = asked.q_id AND adc.m = encoded.m AND adc.code = encoded.code
    WHERE probe <= {nprobe} GROUP BY asked.q_id, lists.ref_id)) WHERE rk <= {found})"""


def _sql_rerank(name: str, of: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT q_id, ref_id, is_fraud, d2, row_number() OVER (PARTITION BY q_id ORDER BY d2, ref_id) AS rk
    FROM (SELECT {of}.q_id, {of}.ref_id, refs.is_fraud, {_l2('q', 'vector')} AS d2 FROM {of} JOIN refs USING (ref_id) JOIN queries USING (q_id))) WHERE rk <= {knn.K})"""


SQL_INDEX = f"{SQL_EMB}, {SQL_CLUSTERS}, {SQL_PQ}"
SQL_LOG = """log AS (SELECT list_extract(['parse', 'embed', 'search', 'total'], CAST(event_id % 4 + 1 AS INTEGER)) AS phase, CAST(trunc(value * 1e6) AS BIGINT) AS duration_ns FROM events)"""
_BUCKET = "CASE " + " ".join(f"WHEN duration_ns / 1e6 < {b} THEN {i}" for i, b in enumerate(evaluation.BOUNDS)) + f" ELSE {len(evaluation.BOUNDS)} END"
_LABELS = ", ".join(f"'{b}'" for b in evaluation.BUCKETS)
SQL_HIST = f"{SQL_LOG}, hist AS (SELECT phase, CAST({_BUCKET} AS INTEGER) AS bucket, count(*) AS n FROM log GROUP BY ALL)"
SQL_EVAL = """elog AS (SELECT event_id AS id, event_type <> 'error' AS expected_approved, CASE WHEN event_id % 97 = 0 THEN event_type = 'error' ELSE event_type <> 'error' END AS approved,
    CASE WHEN event_id % 211 = 0 THEN 500 ELSE 200 END AS status, value AS latency_ms FROM events),
conf AS (SELECT count(*) FILTER (status = 200 AND NOT expected_approved AND NOT approved) AS tp, count(*) FILTER (status = 200 AND expected_approved AND approved) AS tn,
    count(*) FILTER (status = 200 AND expected_approved AND NOT approved) AS fp, count(*) FILTER (status = 200 AND NOT expected_approved AND approved) AS fn, count(*) FILTER (status <> 200) AS err FROM elog),
late AS (SELECT quantile_cont(latency_ms, 0.99) AS p99_ms FROM elog),
det AS (SELECT *, CASE WHEN cut THEN NULL ELSE 1000 * log10(1 / greatest(epsilon, 0.001)) END AS rate_component, CASE WHEN cut THEN NULL ELSE -300 * log10(1 + weighted_errors) END AS absolute_penalty
    FROM (SELECT *, weighted_errors / (tp + tn + fp + fn + err) AS epsilon, (fp + fn + err) / (tp + tn + fp + fn + err) > 0.15 AS cut, (fp + fn + err) / (tp + tn + fp + fn + err) AS failure FROM (SELECT *, fp + 3 * fn + 5 * err AS weighted_errors FROM conf)))"""
_P99_SCORE = "CASE WHEN p99_ms <= 0 THEN 0 WHEN p99_ms > 2000 THEN -3000 ELSE 1000 * log10(1000 / greatest(p99_ms, 1)) END"


# --- payloads and features -----------------------------------------------------------------------


@query(f"""WITH {SQL_TX} SELECT event_id, 'tx-' || event_id AS id, value AS amount, CAST(1 + k % 12 AS INTEGER) AS installments, sec AS requested_sec, avg_amount IS NOT NULL AS has_avg,
    CAST(tx_count AS INTEGER) AS tx_count_24h, format('MERC-{{:03d}}', k) AS merchant, CAST(mcc AS INTEGER) AS mcc, 10.0::DOUBLE * k AS merchant_avg, event_type IN ('view', 'click') AS is_online,
    event_type = 'purchase' AS card_present, last_sec, CASE WHEN last_sec IS NOT NULL THEN ((k * 13) % 1200)::DOUBLE END AS km_from_current FROM tx""")
def json_parse_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads written as JSON and read again, field by field."""
    p = inputs.payloads_of_events(events(spark, sf_dir))
    body = F.to_json(F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction"), {"ignoreNullFields": "false"})
    x = inputs.parse_payloads(p.select("event_id", body.alias("body")))
    second = lambda c: features.epoch(features.instant(F.col(c)))
    return x.select(
        "event_id", "id", F.col("transaction.amount").alias("amount"), F.col("transaction.installments").cast("int").alias("installments"), second("transaction.requested_at").alias("requested_sec"),
        F.col("customer.avg_amount").isNotNull().alias("has_avg"), F.col("customer.tx_count_24h").cast("int").alias("tx_count_24h"), F.col("merchant.id").alias("merchant"), features.mcc_number(F.col("merchant.mcc")).alias("mcc"),
        F.col("merchant.avg_amount").alias("merchant_avg"), F.col("terminal.is_online").alias("is_online"), F.col("terminal.card_present").alias("card_present"), second("last_transaction.timestamp").alias("last_sec"), F.col("last_transaction.km_from_current").alias("km_from_current"),
    )


@query("""WITH k AS (SELECT event_id, user_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events), l AS (SELECT *, lag(sec) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_sec FROM k)
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, sec, CAST(floor((sec - last_sec) / 60.0) AS BIGINT) AS minutes FROM l""")
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = events(spark, sf_dir).select("event_id", "ts", before.alias("last"))
    at = F.col("ts")
    return e.select("event_id", features.hour(at).alias("hour_of_day"), features.weekday(at).alias("day_of_week"), features.epoch(at).alias("sec"), F.when(F.col("last").isNotNull(), features.minutes_between(F.col("last"), at)).alias("minutes"))


@query(f"WITH {SQL_FEATURES} SELECT event_id, is_fraud, {', '.join(DIMENSIONS)} FROM feats")
def embed_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("event_id", "is_fraud", *DIMENSIONS)


@query(f"WITH {SQL_FEATURES} " + " UNION ALL ".join(f"SELECT {i} AS dim, '{d}' AS name, min({d}) AS least, max({d}) AS most, round(avg({d}), 6) AS mean FROM feats" for i, d in enumerate(DIMENSIONS)))
def embed_vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transactions(spark, sf_dir).select(F.posexplode(F.array(*DIMENSIONS)).alias("dim", "x"))
    name = F.element_at(F.array(*map(F.lit, DIMENSIONS)), F.col("dim") + 1)
    return rows.groupBy("dim").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.round(F.avg("x"), 6).alias("mean")).select("dim", name.alias("name"), "least", "most", "mean")


@query(f"WITH {SQL_TX}, risks(code, risk) AS (VALUES {_RISKS}) SELECT CAST(mcc AS INTEGER) AS mcc, coalesce(risk, 0.5) AS risk, count(*) AS n FROM tx LEFT JOIN risks ON code = CAST(mcc AS INTEGER) GROUP BY ALL")
def mcc_risk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = transactions(spark, sf_dir)
    return f.groupBy(features.mcc_number(F.col("merchant.mcc")).alias("mcc"), F.col("mcc_risk").alias("risk")).agg(F.count("*").alias("n"))


@query(f"WITH {SQL_FEATURES} SELECT event_id, unknown_merchant = 1 AS unknown FROM feats")
def unknown_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.payloads_of_events(events(spark, sf_dir))
    return p.select("event_id", features.is_unknown(F.col("merchant.id"), F.col("customer.known_merchants")).alias("unknown"))


# --- exact neighbours and decisions --------------------------------------------------------------


def _rounded(nn: DataFrame) -> DataFrame:
    return nn.withColumn("d2", F.round("d2", 6) + F.lit(0.0))  # no negative zeros


@query(f"WITH {SQL_EMB_NN} {_NN_OUT}")
def knn_exact_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    return _rounded(knn.exact_knn(asked(refs), refs))


_ABS = "list_sum(list_transform(list_zip(q, vector), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE)))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_COS = f"(1 - {_DOT.format('q', 'vector')} / (sqrt({_DOT.format('q', 'q')}) * sqrt({_DOT.format('vector', 'vector')})))"


@query(f"WITH {SQL_EMB}, {_sql_knn(_ABS)} {_NN_OUT}")
def knn_exact_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    return _rounded(knn.exact_knn(asked(refs), refs, metric="manhattan"))


@query(f"WITH {SQL_EMB}, {_sql_knn(f'round({_COS}, 9)')} {_NN_OUT}")
def knn_exact_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked on nine places: the sums of both engines differ in the last ones."""
    refs = references(spark, sf_dir)
    q = asked(refs)
    near = knn.exact_knn(q, refs, knn.K + 20, "cosine").withColumn("d2", F.round("d2", 9)).drop("rk")
    return _rounded(knn.ranked(near))


@query(f"WITH {SQL_EMB_NN}, {_VOTE} SELECT * FROM votes")
def fraud_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    return knn.vote(knn.exact_knn(asked(refs), refs))


_BODY = "'{\"approved\":' || (fraud_count / 5.0 < 0.6) || ',\"fraud_score\":' || format('{:.4f}', fraud_count / 5.0::DOUBLE) || '}'"


@query(f"WITH {SQL_EMB_NN}, {_VOTE} SELECT q_id, fraud_count, fraud_count / 5.0::DOUBLE AS fraud_score, fraud_count / 5.0::DOUBLE < 0.6::DOUBLE AS approved, {_BODY} AS body FROM votes")
def fraud_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    q = asked(refs)
    return knn.response(knn.decide(knn.vote(knn.exact_knn(q, refs), q)))


@query(f"WITH {SQL_EMB_NN}, {_VOTE} SELECT q_id, fraud_count IN (2, 3) AS gray FROM votes")
def gray_zone_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fraud_vote(spark, sf_dir).select("q_id", knn.is_gray(F.col("fraud_count")).alias("gray"))


def _transaction_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # Written once: queries and references are both read from it.
    refs = storage.cut(features.assembled(transactions(spark, sf_dir)).select(F.col("event_id").alias("ref_id"), "vector", "is_fraud"), "features")
    return asked(refs), refs


SQL_DECIDED = f"WITH {SQL_TX_NN}, {_VOTE} SELECT q_id AS event_id, fraud_count, fraud_count / 5.0::DOUBLE AS fraud_score, fraud_count / 5.0::DOUBLE < 0.6::DOUBLE AS approved FROM votes"


@query(SQL_DECIDED.replace(f" WHERE ref_id % {EVERY} = 0", ""))
def fraud_decision_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload text to features to neighbours to decision, for every transaction."""
    _, refs = _transaction_parts(spark, sf_dir)
    return knn.decide(knn.votes_of_all(refs)).withColumnRenamed("q_id", "event_id")


_NAMES = ", ".join(f"'{d}'" for d in DIMENSIONS)


@query(f"""WITH {SQL_TX_NN} SELECT q_id, 'vector' AS part, CAST(i AS INTEGER) AS place, list_extract([{_NAMES}], i) AS name, list_extract(q, i) AS value FROM queries, (SELECT unnest(range(1, 15)) AS i)
UNION ALL SELECT q_id, 'neighbour', CAST(rk AS INTEGER), ref_id || CASE WHEN is_fraud = 1 THEN ':fraud' ELSE ':legit' END, round(d2, 6) FROM nn""")
def decision_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, refs = _transaction_parts(spark, sf_dir)
    return engine.explain(q, _rounded(knn.exact_knn(q, refs)))


# --- clusters, codes and approximate search ------------------------------------------------------


@query(f"WITH {SQL_EMB}, {SQL_CLUSTERS} SELECT ref_id, cluster FROM lists")
def kmeans_assign_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    return ix.assign(refs, ix.seeded_centres(refs, CLUSTERS)).select("ref_id", "cluster")


@query(f"WITH {SQL_EMB}, {SQL_CLUSTERS} SELECT cluster, CAST(d - 1 AS INTEGER) AS dim, round(avg(list_extract(vector, d)::DOUBLE), 6) AS mean FROM lists, (SELECT unnest(range(1, 65)) AS d) GROUP BY ALL")
def kmeans_lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    s = ix.sums(refs, ix.seeded_centres(refs, CLUSTERS))
    return s.select("cluster", F.posexplode(F.transform("total", lambda x: F.round(x / F.col("n"), 6))).alias("dim", "mean"))


@query(f"WITH {SQL_EMB}, {SQL_CLUSTERS} SELECT round(sum(dc), 6) AS wcss FROM lists")
def wcss_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    return evaluation.wcss(refs, ix.seeded_centres(refs, CLUSTERS)).select(F.round("wcss", 6).alias("wcss"))


@query(f"WITH {SQL_EMB}, {SQL_CLUSTERS} SELECT cluster, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS fraud FROM lists GROUP BY cluster")
def ivf_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    return ix.assign(refs, ix.seeded_centres(refs, CLUSTERS)).groupBy("cluster").agg(F.count("*").alias("n"), F.sum("is_fraud").alias("fraud"))


@query(f"WITH {SQL_EMB}, {SQL_CLUSTERS} SELECT q_id, cluster, CAST(probe AS INTEGER) AS probe FROM asked WHERE probe <= {NPROBE}")
def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    return ix.probe(asked(refs), ix.seeded_centres(refs, CLUSTERS), NPROBE).select("q_id", "cluster", "probe")


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, ix.Index]:
    refs = references(spark, sf_dir)
    return asked(refs), refs, ix.build(refs, ix.seeded_centres(refs, CLUSTERS), ix.seeded_codebook(refs, PARTS, CODES))


def _sql_exact_lists(nprobe: int) -> str:
    return f"""WITH {SQL_EMB}, {SQL_CLUSTERS}, nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, ref_id) AS rk FROM (
    SELECT q_id, ref_id, is_fraud, {_l2('q', 'vector')} AS d2 FROM asked JOIN lists USING (cluster) WHERE probe <= {nprobe})) WHERE rk <= 5) {_NN_OUT}"""


@query(_sql_exact_lists(NPROBE))
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _, index = _index(spark, sf_dir)
    return _rounded(ix.scan(ix.probe(q, index.centres, NPROBE), index, knn.K, coarse=False))


@query(f"WITH {SQL_EMB_NN} {_NN_OUT}")
def ivf_full_probe_equals_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists probed: the same as the exact search."""
    q, _, index = _index(spark, sf_dir)
    return _rounded(ix.scan(ix.probe(q, index.centres, CLUSTERS), index, knn.K, coarse=False))


@query(f"WITH {SQL_EMB}, {SQL_PQ} SELECT ref_id, CAST(m AS INTEGER) AS m, CAST(code AS SMALLINT) AS code FROM encoded")
def pq_encode_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    return ix.encode(refs, ix.seeded_codebook(refs, PARTS, CODES)).select("ref_id", F.posexplode("code").alias("m", "code"))


@query(f"WITH {SQL_INDEX}, {_sql_scan('found', NPROBE, FOUND)} SELECT q_id, CAST(rk AS INTEGER) AS rk, ref_id, round(d2, 6) AS d2, is_fraud FROM found WHERE rk <= 5")
def pq_adc_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _, index = _index(spark, sf_dir)
    return _rounded(ix.search(q, index, knn.K, NPROBE, FOUND))


@query(f"WITH {SQL_INDEX}, {_sql_scan('found', NPROBE, FOUND)}, {_sql_rerank('nn', 'found')} {_NN_OUT}")
def rerank_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, refs, index = _index(spark, sf_dir)
    return _rounded(ix.rerank(q, ix.scan(ix.probe(q, index.centres, NPROBE), index, FOUND), refs))


def _sql_gray(first: str) -> str:
    return f"""WITH {SQL_INDEX}, {_sql_scan('found', NPROBE, FOUND)}, {_sql_scan('wide', WIDE_NPROBE, WIDE_FOUND)}, {_sql_rerank('exact', 'found')}, {_sql_rerank('again', 'wide')},
votes AS (SELECT q_id, CAST(sum(is_fraud) AS INTEGER) AS n FROM {first} WHERE rk <= 5 GROUP BY q_id), second AS (SELECT q_id, CAST(sum(is_fraud) AS INTEGER) AS n2 FROM again GROUP BY q_id)
SELECT q_id, CASE WHEN n IN (2, 3) THEN n2 ELSE n END AS fraud_count, n IN (2, 3) AS widened FROM votes JOIN second USING (q_id)"""


def _gray(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    q, refs, index = _index(spark, sf_dir)
    return ix.gray_zone(q, index, refs, knn.K, NPROBE, FOUND, WIDE_NPROBE, WIDE_FOUND, source)


@query(_sql_gray("exact"))
def gray_zone_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gray(spark, sf_dir, "exact")


@query(_sql_gray("found"))
def gray_zone_search_coarse_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gray(spark, sf_dir, "coarse")


_SWEEP_SQL = f"""WITH {SQL_INDEX}, exact AS (SELECT q_id, ref_id FROM (SELECT q_id, ref_id, row_number() OVER (PARTITION BY q_id ORDER BY {_l2('q', 'vector')}, ref_id) AS rk FROM queries, refs) WHERE rk <= 5),
ps(nprobe) AS (VALUES {', '.join(f'({n})' for n in SWEEP_NPROBES)}), cs(candidates) AS (VALUES {', '.join(f'({n})' for n in SWEEP_FOUND)}),
coarse AS (SELECT asked.q_id, lists.ref_id, min(probe) AS probe, list_sum(list(adc.dd ORDER BY adc.m)) AS d2
    FROM asked JOIN lists USING (cluster) JOIN encoded ON encoded.ref_id = lists.ref_id JOIN adc ON adc.q_id = asked.q_id AND adc.m = encoded.m AND adc.code = encoded.code GROUP BY asked.q_id, lists.ref_id),
found AS (SELECT *, row_number() OVER (PARTITION BY nprobe, q_id ORDER BY d2, ref_id) AS rk FROM coarse JOIN ps ON probe <= nprobe),
best AS (SELECT nprobe, candidates, q_id, ref_id, row_number() OVER (PARTITION BY nprobe, candidates, q_id ORDER BY {_l2('q', 'vector')}, ref_id) AS r
    FROM found JOIN cs ON rk <= candidates JOIN queries USING (q_id) JOIN refs USING (ref_id))
SELECT CAST(nprobe AS INTEGER) AS nprobe, CAST(candidates AS INTEGER) AS candidates, coalesce(hits, 0) / (5.0::DOUBLE * (SELECT count(*) FROM queries)) AS recall
FROM ps CROSS JOIN cs LEFT JOIN (SELECT nprobe, candidates, count(*) AS hits FROM best JOIN exact USING (q_id, ref_id) WHERE r <= 5 GROUP BY ALL) USING (nprobe, candidates)"""


@query(_SWEEP_SQL)
def recall_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, refs, index = _index(spark, sf_dir)
    return evaluation.sweep(q, index, refs, nprobes=SWEEP_NPROBES, candidates=SWEEP_FOUND)


_KS = ", ".join(f"({k})" for k in ELBOW_KS)


@query(f"""WITH {SQL_EMB}, ks(k) AS (VALUES {_KS}), cents AS (SELECT row_number() OVER (ORDER BY ref_id) AS i, vector AS c FROM refs ORDER BY ref_id LIMIT {max(ELBOW_KS)}),
near AS (SELECT ref_id, i, {_l2('vector', 'c')} AS d FROM refs, cents), curve AS (SELECT k, sum(d) AS wcss FROM (SELECT k, ref_id, min(d) AS d FROM near JOIN ks ON i <= k GROUP BY k, ref_id) GROUP BY k),
ends AS (SELECT min(k) AS a, max(k) AS z, max_by(wcss, k) AS wz, min_by(wcss, k) AS wa FROM curve)
SELECT CAST(k AS INTEGER) AS k FROM curve, ends ORDER BY round(abs((k - a) / (z - a)::DOUBLE - (wcss - wa) / (wz - wa)) / sqrt(2), 12) DESC, k LIMIT 1""")
def elbow_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bend of the curve of wcss over the vectors of the least ids as centres."""
    refs = references(spark, sf_dir)
    centres = ix.seeded_centres(refs, max(ELBOW_KS))
    curve = [(k, float(evaluation.wcss(refs, centres[:k]).first()[0])) for k in ELBOW_KS]
    return evaluation.elbow(spark.createDataFrame(curve, "k int, wcss double"))


# --- scores and telemetry ------------------------------------------------------------------------


@query(f"WITH {SQL_EVAL} SELECT * FROM conf")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(inputs.eval_log(events(spark, sf_dir)))


@query(f"WITH {SQL_EVAL} SELECT round(p99_ms, 6) AS p99_ms FROM late")
def p99_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.p99(inputs.eval_log(events(spark, sf_dir))).select(F.round("p99_ms", 6).alias("p99_ms"))


@query(f"WITH {SQL_EVAL} SELECT round({_P99_SCORE}, 6) AS p99_score FROM late")
def p99_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.p99(inputs.eval_log(events(spark, sf_dir))).select(F.round(evaluation.p99_score(F.col("p99_ms")), 6).alias("p99_score"))


@query(f"WITH {SQL_EVAL} SELECT weighted_errors, round(epsilon, 6) AS epsilon, cut, round(rate_component, 6) AS rate_component, round(absolute_penalty, 6) AS absolute_penalty, round(CASE WHEN cut THEN -3000 ELSE rate_component + absolute_penalty END, 6) AS detection_score FROM det")
def detection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evaluation.detection(evaluation.confusion(inputs.eval_log(events(spark, sf_dir))))
    return d.select("weighted_errors", "cut", *(F.round(c, 6).alias(c) for c in ("epsilon", "rate_component", "absolute_penalty", "detection_score")))


@query(f"""WITH {SQL_EVAL} SELECT tp, tn, fp, fn, err, round(p99_ms, 2) AS p99_ms, round({_P99_SCORE}, 2) AS p99_score, format('{{:.2f}}%', 100 * failure) AS failure_rate, weighted_errors, round(epsilon, 6) AS epsilon,
    round(rate_component, 2) AS rate_component, round(absolute_penalty, 2) AS absolute_penalty, round(CASE WHEN cut THEN -3000 ELSE rate_component + absolute_penalty END, 2) AS detection_score,
    round({_P99_SCORE} + CASE WHEN cut THEN -3000 ELSE rate_component + absolute_penalty END, 2) AS final_score FROM det, late""")
def contest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.contest(inputs.eval_log(events(spark, sf_dir)))


@query(f"WITH {SQL_HIST} SELECT phase, bucket, list_extract([{_LABELS}], bucket + 1) AS label, n FROM hist")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.histogram(inputs.request_log(events(spark, sf_dir)))


_UPPER = f"list_extract([{', '.join(map(str, (*evaluation.BOUNDS, evaluation.BOUNDS[-1])))}], bucket + 1)"


@query(f"""WITH {SQL_HIST}, cum AS (SELECT *, sum(n) OVER (PARTITION BY phase ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY phase) AS total FROM hist)
SELECT phase, {', '.join(f'min(CASE WHEN seen >= ceil(total * {s}::DOUBLE) THEN {_UPPER} END) AS p{round(100 * s)}_ms' for s in (0.5, 0.9, 0.99))} FROM cum GROUP BY phase""")
def latency_bucket_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bucket_percentiles(inputs.request_log(events(spark, sf_dir)))


@query(f"WITH {SQL_LOG} SELECT phase, count(*) AS count, round(avg(duration_ns) / 1e6, 6) AS avg_ms, round(max(duration_ns) / 1e6, 6) AS max_ms FROM log GROUP BY phase")
def latency_avg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.averages(inputs.request_log(events(spark, sf_dir)))


@query(f"WITH {SQL_LOG} SELECT phase, duration_ns FROM log WHERE phase = 'search' AND duration_ns > 50e6")
def slow_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.slow(inputs.request_log(events(spark, sf_dir)))


@query(f"WITH {SQL_EMB_NN}, {_VOTE} SELECT count(*) AS total, count(*) FILTER (fraud_count IN (2, 3)) AS gray, round(count(*) FILTER (fraud_count IN (2, 3)) * 100.0 / count(*), 6)::DOUBLE AS pct FROM votes")
def gray_zone_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gray_rate(fraud_vote(spark, sf_dir))


def _sql_thousandths(n: str) -> str:
    return f"(({n}) // 1000) || '.' || lpad(CAST(({n}) % 1000 AS VARCHAR), 3, '0')"


def _sql_phase(p: str) -> str:
    cells = " || ',' || ".join(f"""'"{label}":' || count(*) FILTER (bucket = {b})""" for b, label in enumerate(evaluation.BUCKETS))
    share = lambda s: f"CASE WHEN count(*) = 0 THEN '0.0' ELSE printf('%.1f', (SELECT min(upper) FROM cum WHERE cum.phase = '{p}' AND seen >= ceil(total * {s}::DOUBLE))::DOUBLE) END"
    average = _sql_thousandths("(2 * CAST(sum(duration_ns) AS BIGINT) + 1000 * count(*)) // (2000 * count(*))")
    return f"""(SELECT CASE WHEN (SELECT count(*) FROM log WHERE phase = 'total') = 0 THEN '{{"count":0}}' ELSE '{{"count":' || count(*) || ',"avg_ms":' || CASE WHEN count(*) = 0 THEN '0.000' ELSE {average} END || ',"max_ms":' || {_sql_thousandths("(coalesce(max(duration_ns), 0) + 500) // 1000")}
    || ',"p50_ms":' || {share(0.5)} || ',"p90_ms":' || {share(0.9)} || ',"p99_ms":' || {share(0.99)} || ',"buckets":{{' || {cells} || '}}}}' END FROM cells WHERE phase = '{p}')"""


@query(f"""WITH {SQL_EMB_NN}, {_VOTE}, {SQL_HIST}, cells AS (SELECT phase, duration_ns, CAST({_BUCKET} AS INTEGER) AS bucket FROM log),
cum AS (SELECT phase, {_UPPER} AS upper, sum(n) OVER (PARTITION BY phase ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY phase) AS total FROM hist),
gray AS (SELECT count(*) FILTER (fraud_count IN (2, 3)) AS gray, count(*) AS votes FROM votes)
SELECT '{{"total_requests":' || (SELECT count(*) FROM log WHERE phase = 'total') || ',"phases":{{' || {" || ',' || ".join(f"""'"{p}":' || {_sql_phase(p)}""" for p in evaluation.PHASES)}
    || '}},"gray_zone":{{"count":' || gray || ',"pct":' || printf('%.2f', round(gray * 100.0::DOUBLE / votes, 2)) || '}}}}' AS stats FROM gray""")
def stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stats(inputs.request_log(events(spark, sf_dir)), fraud_vote(spark, sf_dir))


def _sql_number(x: str, digits: int) -> str:
    return rf"coalesce(regexp_replace(regexp_replace(printf('%.{digits}f', round({x}, {digits})), '\.?0+$', ''), '^-0$', '0'), 'null')"


_SCORED = "CASE WHEN cut THEN -3000::DOUBLE ELSE rate_component + absolute_penalty END"


@query(f"""WITH {SQL_EVAL}, known AS (SELECT count(*) AS total, count(*) FILTER (NOT expected_approved) AS fraud, count(*) FILTER (expected_approved) AS legit FROM elog)
SELECT '{{"expected":{{"total":' || total || ',"fraud_count":' || fraud || ',"legit_count":' || legit || ',"fraud_rate":' || {_sql_number('100.0::DOUBLE * fraud / total', 2)} || ',"legit_rate":' || {_sql_number('100.0::DOUBLE * legit / total', 2)}
    || '}},"p99":"' || printf('%.2f', round(p99_ms, 2)) || 'ms","scoring":{{"breakdown":{{"false_positive_detections":' || fp || ',"false_negative_detections":' || fn || ',"true_positive_detections":' || tp || ',"true_negative_detections":' || tn
    || ',"http_errors":' || err || '}},"failure_rate":"' || {_sql_number('100 * failure', 2)} || '%","weighted_errors_E":' || weighted_errors || ',"error_rate_epsilon":' || {_sql_number('epsilon', 6)}
    || ',"p99_score":{{"value":' || {_sql_number(f'({_P99_SCORE})::DOUBLE', 2)} || ',"cut_triggered":' || (p99_ms > 2000) || '}},"detection_score":{{"value":' || {_sql_number(_SCORED, 2)} || ',"rate_component":' || {_sql_number('rate_component', 2)}
    || ',"absolute_penalty":' || {_sql_number('absolute_penalty', 2)} || ',"cut_triggered":' || cut || '}},"final_score":' || {_sql_number(f'({_P99_SCORE})::DOUBLE + {_SCORED}', 2)} || '}}}}' AS report FROM det, late, known""")
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.report(inputs.eval_log(events(spark, sf_dir)))


# --- trained models and streams ------------------------------------------------------------------


@query(f"WITH {SQL_EMB} SELECT ref_id FROM refs ORDER BY md5('42:' || ref_id), ref_id LIMIT 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 100 rows, the same at every run."""
    return ix.sampled(references(spark, sf_dir), 100).select("ref_id")


@query()
def kmeans_mllib(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    return ix.assign(refs, ix.train_centres(refs, 8, rounds=10)).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def kmeans_k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.k_sweep(references(spark, sf_dir), [4, 8], trials=1, rounds=5)


@query()
def pq_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared error of trained codes, by part."""
    refs = references(spark, sf_dir)
    book = ix.train_codebook(refs, 4, 16, rounds=5)
    rows = ix.encode(refs, book).select("vector", F.posexplode("code").alias("m", "code"))
    centres = spark.createDataFrame([(m, c, x.tolist()) for m, part in enumerate(book.centres) for c, x in enumerate(part)], "m int, code int, c array<double>")
    part = F.slice("vector", F.col("m") * 16 + 1, F.lit(16))
    return rows.join(F.broadcast(centres), ["m", "code"]).groupBy("m").agg(F.avg(distance.l2_squared(part, F.col("c"))).alias("error"))


@query()
def ivf_search_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    lists = ix.build(refs, ix.train_centres(refs, CLUSTERS), None)
    return _rounded(ix.scan(ix.probe(asked(refs), lists.centres, TRAINED_NPROBE), lists, knn.K, coarse=False))


#: Queries of the recall check, as many as the reference evaluation takes, and the least recall.
SAMPLED, LEAST_RECALL = 20_000, 0.9
#: Recall on a sample of other queries that the number of candidates is raised for: a sample of 500 may be off by some hundredths.
TUNED_RECALL = LEAST_RECALL + 0.03


def _candidates(refs: DataFrame, index: ix.Index) -> int:
    return evaluation.tuned(refs, index, TRAINED_NPROBE, TRAINED_FOUND, TUNED_RECALL)


def _trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, ix.Index]:
    refs = references(spark, sf_dir)
    return asked(refs), refs, ix.build_trained(refs, CLUSTERS, TRAINED_PARTS, TRAINED_CODES)


@query()
def rerank_exact_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, refs, index = _trained(spark, sf_dir)
    return _rounded(ix.rerank(q, ix.scan(ix.probe(q, index.centres, TRAINED_NPROBE), index, _candidates(refs, index)), refs))


@query()
def gray_zone_search_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, refs, index = _trained(spark, sf_dir)
    found = _candidates(refs, index)
    return ix.gray_zone(q, index, refs, knn.K, TRAINED_NPROBE, found, TRAINED_WIDE_NPROBE, max(TRAINED_WIDE_FOUND, 2 * found))


@query()
def lsh_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    return engine.lsh_knn(asked(refs), refs).select("q_id", "rk", "ref_id")


@query(f"WITH {SQL_EMB} SELECT m AS method, least({SAMPLED}, (SELECT count(*) FROM refs)) AS n_queries, true AS enough FROM (SELECT unnest(['ivf', 'ivf_pq', 'lsh']) AS m)")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the approximate searches find nine tenths of the true neighbours of a sample of the references; the index has every row."""
    refs = references(spark, sf_dir)
    q = storage.cut(ix.sampled(refs, SAMPLED).select(F.col("ref_id").alias("q_id"), F.col("vector").alias("q")), "sample")
    exact = storage.cut(knn.exact_knn(q, refs).select("q_id", "ref_id"), "exact")
    index = ix.build_trained(refs, CLUSTERS, TRAINED_PARTS, TRAINED_CODES)
    probes = ix.probe(q, index.centres, TRAINED_NPROBE)
    found = {"ivf": ix.scan(probes, index, knn.K, coarse=False), "ivf_pq": ix.reranked(q, index, knn.K, TRAINED_NPROBE, _candidates(refs, index)), "lsh": engine.lsh_knn(q, refs)}
    n = q.count()
    rows = [(m, n, evaluation.recall(near, exact).first()["recall"] >= LEAST_RECALL) for m, near in found.items()]
    return spark.createDataFrame(rows, "method string, n_queries long, enough boolean")


@query()
def search_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, time a query and queries a second of two settings of the quantized search on a trained index."""
    q, refs, index = _trained(spark, sf_dir)
    return evaluation.benchmark(q, index, refs, nprobes=(4, TRAINED_NPROBE), candidates=(TRAINED_FOUND,))


@query(SQL["fraud_decision"])
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by an index that was written and read again, with every list probed and every row a candidate."""
    q, refs, index = _index(spark, sf_dir)
    path = storage.place(spark, "index")
    ix.write(index, path)
    every = max(knn.K, index.lists.count())
    config = engine.SearchConfig("ivf_pq", nprobe=CLUSTERS, candidates=every, rerank_nprobe=CLUSTERS, rerank_candidates=every)
    found = engine.votes(q, refs, config, ix.read(spark, path))
    return knn.response(knn.decide(found.select("q_id", "fraud_count")))


@query("SELECT * FROM (VALUES ('clusters', true), ('codes', true)) AS t(what, better)")
def training_improves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether trained centres and codes lie nearer to the vectors than the vectors of the least ids."""
    refs = references(spark, sf_dir)
    total = lambda centres: evaluation.wcss(refs, centres).first()[0]
    sample = ix.sampled(refs.where("vector is not null"), 600_000)
    error = lambda book: ix.part_sums(sample, book)[2]
    clusters = total(ix.train_centres(refs, 8, rounds=10)) < total(ix.seeded_centres(refs, 8))
    codes = error(ix.train_codebook(refs, 4, 16, rounds=5)) < error(ix.seeded_codebook(refs, 4, 16))
    return spark.createDataFrame([("clusters", clusters), ("codes", codes)], "what string, better boolean")


@query("SELECT * FROM (VALUES ('before', false), ('after', true)) AS t(moment, ready)")
def index_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an index can be read, before and after it was written."""
    index, path = _index(spark, sf_dir)[2], storage.place(spark, "index")
    before = evaluation.ready(spark, path)
    ix.write(index, path)
    return spark.createDataFrame([("before", before), ("after", evaluation.ready(spark, path))], "moment string, ready boolean")


@query(_SWEEP_SQL)
def recall_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep as a CSV file, read again."""
    path = storage.place(spark, "sweep")
    sinks.write_csv(recall_sweep(spark, sf_dir), path)
    return spark.read.schema("nprobe int, candidates int, recall double").option("header", True).csv(path)


@query(f"WITH {SQL_EMB_NN}, {_VOTE} SELECT {_BODY} AS body FROM votes")
def answers_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers as a file of JSON lines, read again."""
    path = storage.place(spark, "answers")
    sinks.write_answers(fraud_decision(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "body")


_CONFIGURATION = """
app:
  vector-search:
    index: "ivf_pq" # or brute_force
    clusters: 4096
    nprobe: 16
    candidates: 10
    rerank:
      enabled: true
      nprobe: 32
      candidates: 20
  fraud:
    debug: false
"""


@query("SELECT * FROM (VALUES ('strategy', 'ivf_pq'), ('clusters', '4096'), ('nprobe', '8'), ('candidates', '10'), ('rerank', 'True'), ('rerank_nprobe', '32'), ('rerank_candidates', '20'), ('count_source', 'exact'), ('debug', 'False')) AS t(name, value)")
def configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search settings from a file, one of them replaced by a variable."""
    path = storage.place(spark, "configuration")
    spark.createDataFrame([(_CONFIGURATION,)], "value string").coalesce(1).write.text(path)
    text = spark.read.text(path, wholetext=True).first()[0]
    config = engine.SearchConfig.from_environment(environment={"VICINAL_NPROBE": "8"}, start=engine.SearchConfig.from_file(text))
    return spark.createDataFrame([(k, str(v)) for k, v in vars(config).items()], "name string, value string")


# --- readers, each of a file that is written first -----------------------------------------------


@query("SELECT vec_id AS ref_id, CAST(label >= 7 AS INTEGER) AS is_fraud, CAST(len(embedding) AS INTEGER) AS places, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def reference_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled references from one gzipped JSON array, numbered by their places in it, which are ids here."""
    path = storage.place(spark, "references")
    rows = references(spark, sf_dir).select("ref_id", F.to_json(F.struct("vector", F.when(F.col("is_fraud") == 1, "fraud").otherwise("legit").alias("label"))).alias("value"))
    # An array is one file, which one task has to write: its lines in order, between brackets.
    first, last = rows.agg(F.min("ref_id"), F.max("ref_id")).first()
    line = F.concat(F.when(F.col("ref_id") == first, "[").otherwise(""), F.col("value"), F.when(F.col("ref_id") == last, "]").otherwise(","))
    rows.select("ref_id", line.alias("value")).coalesce(1).sortWithinPartitions("ref_id").select("value").write.option("compression", "gzip").text(path)
    x = inputs.read_references(spark, path)
    total = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return x.select((F.col("ref_id") + F.lit(first)).alias("ref_id"), "is_fraud", F.size("vector").alias("places"), F.round(total, 4).alias("total"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in NORMS.items()) + ") AS t(name, value)")
def norms_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalization constants from a JSON file."""
    path = storage.place(spark, "norms")
    spark.createDataFrame([(json.dumps(NORMS),)], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame(list(read_norms(spark, path).items()), "name string, value double")


@query(f"SELECT CAST(code AS INTEGER) AS mcc, risk FROM (VALUES {_RISKS}) AS t(code, risk)")
def risks_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchant risks from a JSON file, without keys that are no code."""
    path = storage.place(spark, "risks")
    spark.createDataFrame([(json.dumps({**{str(k): v for k, v in MCC_RISK.items()}, "x": 0.1, "10000": 0.2}),)], "value string").coalesce(1).write.text(path)
    return read_risks(spark, path)


def _entries(spark: SparkSession, sf_dir: str) -> str:
    """A load-test file made of every 50th event."""
    p = inputs.payloads_of_events(events(spark, sf_dir)).where(F.col("event_id") % EVERY == 0)
    entry = F.struct(F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction").alias("request"), (F.col("is_fraud") == 0).alias("expected_approved"))
    path = storage.place(spark, "entries")
    # One JSON object by the format: the entries of a test, some thousand.
    whole = p.agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("event_id", entry.alias("e")))), lambda x: x["e"]).alias("entries"))).alias("value"))
    whole.coalesce(1).write.text(path)
    return path


SQL_ENTRIES = f"SELECT 'tx-' || event_id AS id, event_type <> 'error' AS expected_approved, value AS amount FROM events WHERE event_id % {EVERY} = 0"


@query(SQL_ENTRIES)
def load_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and expected answers of a load-test file."""
    return inputs.read_entries(spark, _entries(spark, sf_dir)).select(F.col("request.id").alias("id"), "expected_approved", F.col("request.transaction.amount").alias("amount"))


def _stream_input(spark: SparkSession, sf_dir: str) -> str:
    """A folder with references as a table (refs) and every 50th event as payload files (in)."""
    top = storage.place(spark, "stream")
    refs = features.assembled(transactions(spark, sf_dir)).select(F.col("event_id").alias("ref_id"), "vector", "is_fraud")
    refs.write.parquet(f"{top}/refs")
    p = inputs.payloads_of_events(events(spark, sf_dir)).where(F.col("event_id") % EVERY == 0)
    p.drop("is_fraud").repartition(4).write.option("ignoreNullFields", "false").json(f"{top}/in")
    return top


@query(SQL_DECIDED)
def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a stream of payload files; the same as of the batch."""
    from vicinal.streaming import scoring

    top = _stream_input(spark, sf_dir)
    stream = scoring.payload_stream(spark, f"{top}/in", "event_id bigint")
    scoring.score_stream(stream, spark.read.parquet(f"{top}/refs"), f"{top}/out", f"{top}/state", digits=6).awaitTermination()
    return spark.read.parquet(f"{top}/out").drop("batch")


@query(SQL_DECIDED)
def stream_decisions_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a stream without a step for each batch: every task has the references, or, where they are too many, one block of them at a time."""
    from vicinal.streaming import scoring

    top = _stream_input(spark, sf_dir)
    decided = scoring.decisions(scoring.payload_stream(spark, f"{top}/in", "event_id bigint"), spark.read.parquet(f"{top}/refs"), digits=6, blocks=True)
    decided.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(decided.schema).parquet(f"{top}/out")


@query(f"""WITH {SQL_LOG.replace("FROM events", "epoch(ts) AS sec FROM events").replace("AS duration_ns epoch", "AS duration_ns, epoch")}
SELECT CAST(floor(sec / 3600) * 3600 AS BIGINT) AS window_sec, phase, count(*) AS n, round(avg(duration_ns) / 1e6, 6) AS avg_ms, round(max(duration_ns) / 1e6, 6) AS max_ms FROM log GROUP BY ALL""")
def running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by hour and phase of a stream of the request log, as its watermark closes the hours; a last row of no phase, a day later, closes them all."""
    from vicinal.streaming import scoring

    top = storage.place(spark, "running")
    e = events(spark, sf_dir)
    log = inputs.request_log(e, "ts")
    log.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{top}/in/part=1")
    e.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).cast("timestamp").alias("ts")).select(F.lit(None).cast("string").alias("phase"), F.lit(0).cast("long").alias("duration_ns"), "ts").write.parquet(f"{top}/in/part=2")
    stream = spark.readStream.schema("phase string, duration_ns long, ts timestamp").parquet(f"{top}/in/*")
    rows = scoring.running_stats(stream, width="1 hour")
    rows.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    x = spark.read.schema(rows.schema).parquet(f"{top}/out").where("phase is not null")
    return x.select(F.unix_timestamp("window.start").alias("window_sec"), "phase", "n", F.round(F.col("avg_ns") / 1e6, 6).alias("avg_ms"), F.round(F.col("max_ns") / 1e6, 6).alias("max_ms"))


@query(SQL_ENTRIES)
def load_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests that a load test sends, at a rate that rises to so many a second, until each entry was sent once."""
    from vicinal.streaming import scoring

    top = storage.place(spark, "load")
    # One JSON object is read by one task, so it is read once and not by each batch.
    entries = storage.cut(inputs.numbered_entries(spark, _entries(spark, sf_dir)), "numbered")
    n = entries.count()
    sent = scoring.load_stream(spark, entries, most=n, rows_per_batch=1000)
    scoring.run_until(sent.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state"), n, 1000)
    x = spark.read.schema(sent.schema).parquet(f"{top}/out")
    return x.select(F.col("request.id").alias("id"), "expected_approved", F.col("request.transaction.amount").alias("amount"))
