"""Normalization constants, merchant-category risks and the shapes of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Normalization constants.
NORMS = {
    "max_amount": 10000.0,
    "max_installments": 12.0,
    "amount_vs_avg_ratio": 10.0,
    "max_minutes": 1440.0,
    "max_km": 1000.0,
    "max_tx_count_24h": 20.0,
    "max_merchant_avg_amount": 10000.0,
}

# Risk by merchant category code, and of any other code.
MCC_RISK = {4511: 0.35, 5311: 0.25, 5411: 0.15, 5812: 0.30, 5912: 0.20, 5944: 0.45, 5999: 0.50, 7801: 0.80, 7802: 0.75, 7995: 0.85}
DEFAULT_RISK = 0.5
MCC_LIMIT = 10000

# Names of the vector's places.
DIMENSIONS = (
    "amount", "installments", "amount_vs_avg", "hour_of_day", "day_of_week", "minutes_since_last_tx", "km_from_last_tx",
    "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_avg_amount",
)

TRANSACTION = """
id STRING,
transaction STRUCT<amount: DOUBLE, installments: DOUBLE, requested_at: STRING>,
customer STRUCT<avg_amount: DOUBLE, tx_count_24h: DOUBLE, known_merchants: ARRAY<STRING>>,
merchant STRUCT<id: STRING, mcc: STRING, avg_amount: DOUBLE>,
terminal STRUCT<is_online: BOOLEAN, card_present: BOOLEAN, km_from_home: DOUBLE>,
last_transaction STRUCT<timestamp: STRING, km_from_current: DOUBLE>
"""


def risk_table(spark: SparkSession, risks: dict[int, float] | None = None) -> DataFrame:
    """mcc, risk: one row for each of at most MCC_LIMIT codes.  They are literals of the plan, so no Python worker is started for them."""
    rows = [F.struct(F.lit(k).cast("int").alias("mcc"), F.lit(v).cast("double").alias("risk")) for k, v in sorted((risks or MCC_RISK).items())]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def read_norms(spark: SparkSession, path: str) -> dict[str, float]:
    """Constants from a JSON object with the keys of NORMS; a missing key is an error."""
    row = spark.read.schema(", ".join(f"{k} double" for k in NORMS)).option("multiLine", True).json(path).first()
    found = row.asDict() if row else {}
    if missing := [k for k in NORMS if found.get(k) is None]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return found


def read_risks(spark: SparkSession, path: str) -> DataFrame:
    """mcc, risk from a JSON object of code and risk; keys that are no code in [0, MCC_LIMIT) are left out."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,double>")).alias("key", "risk"))
    return rows.select(F.expr("try_cast(key as int)").alias("mcc"), "risk").where(f"mcc >= 0 and mcc < {MCC_LIMIT} and risk is not null")
