"""The 14 features of a transaction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.sources.constants import DEFAULT_RISK, DIMENSIONS, MCC_LIMIT, NORMS, risk_table


def clamp(x: Column) -> Column:
    """x held in [0, 1]; null stays null (least and greatest alone would make it 0)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def instant(text: Column) -> Column:
    """The moment of an ISO text in UTC; null if it is none."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def hour(at: Column) -> Column:
    return F.hour(at)


def weekday(at: Column) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(at)


def epoch(at: Column) -> Column:
    """Whole seconds since 1970."""
    return F.unix_timestamp(at)


def minutes_between(before: Column, at: Column) -> Column:
    """Whole minutes, not below 0."""
    return F.greatest(F.lit(0), F.floor((epoch(at) - epoch(before)) / 60))


def mcc_number(code: Column) -> Column:
    """A code as a number; null if it is none in [0, MCC_LIMIT)."""
    n = code.try_cast("int")
    return F.when((n >= 0) & (n < MCC_LIMIT), n)


def is_unknown(merchant: Column, known: Column) -> Column:
    """Whether a merchant isn't among the known ones; a null list knows none."""
    return ~F.coalesce(F.array_contains(known, merchant), F.lit(False))


def has_history(last: Column) -> Column:
    return last.isNotNull()


def features(payloads: DataFrame, norms: dict[str, float] | None = None, risks: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """payloads with a column for each feature.

    Without a last transaction both of its features are -1; missing booleans are
    false; a missing or unknown merchant category has the default risk; any other
    missing number makes its feature null (see ``rejects``).  The risk table has at
    most MCC_LIMIT rows, so it is sent to all executors.  digits: places that
    features are rounded to.
    """
    n = norms or NORMS
    p = payloads.join(F.broadcast(risks if risks is not None else risk_table(payloads.sparkSession)), mcc_number(F.col("merchant.mcc")) == F.col("mcc"), "left")
    at, last = instant(F.col("transaction.requested_at")), F.col("last_transaction")
    amount, average = F.col("transaction.amount"), F.col("customer.avg_amount")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    found = {
        "amount": clamp(amount / n["max_amount"]),
        "installments": clamp(F.col("transaction.installments").cast("int") / n["max_installments"]),
        "amount_vs_avg": F.when(average > 0, clamp(amount / average / n["amount_vs_avg_ratio"])).when(average.isNotNull(), 0.0),
        "hour_of_day": hour(at) / 23.0,
        "day_of_week": weekday(at) / 6.0,
        "minutes_since_last_tx": F.when(~has_history(last), -1.0).otherwise(clamp(minutes_between(instant(F.col("last_transaction.timestamp")), at) / n["max_minutes"])),
        "km_from_last_tx": F.when(~has_history(last), -1.0).otherwise(clamp(F.col("last_transaction.km_from_current") / n["max_km"])),
        "km_from_home": clamp(F.col("terminal.km_from_home") / n["max_km"]),
        "tx_count_24h": clamp(F.col("customer.tx_count_24h").cast("int") / n["max_tx_count_24h"]),
        "is_online": flag(F.col("terminal.is_online")),
        "card_present": flag(F.col("terminal.card_present")),
        "unknown_merchant": is_unknown(F.col("merchant.id"), F.col("customer.known_merchants")).cast("double"),
        "mcc_risk": F.coalesce("risk", F.lit(DEFAULT_RISK)),
        "merchant_avg_amount": clamp(F.col("merchant.avg_amount") / n["max_merchant_avg_amount"]),
    }
    if digits is not None:
        found = {k: F.round(v, digits) for k, v in found.items()}
    kept = [F.col(c) for c in payloads.columns if c not in DIMENSIONS]
    return p.select(*kept, *(found[d].alias(d) for d in DIMENSIONS))


def assembled(df: DataFrame, name: str = "vector", kind: str = "double") -> DataFrame:
    """df with its features as one array instead of 14 columns."""
    return df.withColumn(name, F.array(*(F.col(d).cast(kind) for d in DIMENSIONS))).drop(*DIMENSIONS)


def rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with all features, and rows that lack one."""
    whole = F.greatest(*(F.col(d).isNull().cast("int") for d in DIMENSIONS)) == 0
    return df.where(whole), df.where(~whole)
