"""Readers of payloads, labelled references and load-test entries, and the stand-ins made from the event and embedding tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.sources.constants import TRANSACTION


def read_payloads(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Transaction payloads: JSON lines, or one JSON array with multiline; malformed ones come as rows of nulls."""
    return spark.read.schema(TRANSACTION).option("multiLine", multiline).json(path)


def parse_payloads(df: DataFrame, body: str = "body") -> DataFrame:
    """The payload of each JSON text in a column, as columns beside the others; all null where the text is no JSON.

    Each text is parsed once: a plain selection of the fields would be folded into
    one parse for each of them.
    """
    schema = T._parse_datatype_string(TRANSACTION)
    return df.select(*(c for c in df.columns if c != body), F.inline(F.array(F.from_json(body, schema))))


def read_references(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """ref_id (place in the array), vector, is_fraud of a JSON array of vectors and labels, gzipped or not.

    One array can't be split, so one task reads it, and there the numbers that Spark
    gives to rows are their places; then the rows are dealt out.  A null or other
    label counts as legitimate.
    """
    rows = spark.read.schema("vector array<float>, label string").option("multiLine", True).json(path).coalesce(1)
    out = rows.select(F.monotonically_increasing_id().alias("ref_id"), "vector", F.coalesce((F.col("label") == "fraud").cast("int"), F.lit(0)).alias("is_fraud"))
    return out.repartition(partitions or spark.sparkContext.defaultParallelism)


def _entries_type() -> str:
    payload = ", ".join(x.strip().rstrip(",").replace(" ", ": ", 1) for x in TRANSACTION.strip().split("\n"))
    return f"entries array<struct<request: struct<{payload}>, expected_approved: boolean>>"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """request and expected_approved of a load-test file."""
    return numbered_entries(spark, path).drop("number")


def read_expected(spark: SparkSession, path: str) -> str | None:
    """What a load-test file says of itself, as JSON."""
    row = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.stats").alias("stats")).where("stats is not null").first()
    return row["stats"] if row else None


def numbered_entries(spark: SparkSession, path: str) -> DataFrame:
    """number (from 0), request and expected_approved of a load-test file."""
    x = spark.read.schema(_entries_type()).option("multiLine", True).json(path)
    return x.select(F.posexplode("entries").alias("number", "e")).select(F.col("number").cast("long").alias("number"), "e.*")


# Codes that stand for the remainders of a merchant number by 11.
_CODES = ("5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999", "9999")


def _merchant(k: Column) -> Column:
    return F.format_string("MERC-%03d", k)


def number_of(props: Column) -> Column:
    """k of the properties of an event.  The usual text, with nothing but a number, is told by a pattern, which takes a fraction of the time of the parser."""
    usual = props.rlike(r'\A\{"k": (0|[1-9][0-9]{0,8})\}\z')
    return F.when(usual, F.substr(props, F.lit(7), F.length(props) - 7).cast("int")).otherwise(F.get_json_object(props, "$.k").cast("int"))


def payloads_of_events(events: DataFrame) -> DataFrame:
    """event_id, is_fraud and payload columns: each event as a transaction of its user, with history from the user's earlier events.

    known_merchants holds the merchant of the event before, and the own one if the
    user has had it, which is all that a payload is asked about.
    """
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    day = Window.partitionBy("user_id").orderBy("sec").rangeBetween(-86400, -1)
    seen = Window.partitionBy("user_id", "k").orderBy("ts", "event_id")
    e = events.select("event_id", "user_id", "ts", "event_type", "value", number_of(F.col("props")).alias("k")).withColumn("sec", F.unix_timestamp("ts"))
    e = e.select(
        "*", F.coalesce(F.avg("value").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("avg_amount"),
        F.count("*").over(day).cast("double").alias("tx_count"), (F.row_number().over(seen) > 1).alias("known"), F.lag("k").over(by).alias("before"), F.lag("sec").over(by).alias("last_sec"),
    )
    iso = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    code = F.element_at(F.array(*map(F.lit, _CODES)), F.col("k") % 11 + 1)
    known = F.array_compact(F.array(F.when(F.col("before").isNotNull(), _merchant(F.col("before"))), F.when(F.col("known"), _merchant(F.col("k")))))
    return e.select(
        "event_id", (F.col("event_type") == "error").cast("int").alias("is_fraud"), F.concat(F.lit("tx-"), F.col("event_id").cast("string")).alias("id"),
        F.struct(F.col("value").alias("amount"), (1.0 + F.col("k") % 12).alias("installments"), iso("sec").alias("requested_at")).alias("transaction"),
        F.struct("avg_amount", F.col("tx_count").alias("tx_count_24h"), known.alias("known_merchants")).alias("customer"),
        F.struct(_merchant(F.col("k")).alias("id"), code.alias("mcc"), (10.0 * F.col("k")).alias("avg_amount")).alias("merchant"),
        F.struct(F.col("event_type").isin("view", "click").alias("is_online"), (F.col("event_type") == "purchase").alias("card_present"), ((F.col("k") * 37) % 1500).cast("double").alias("km_from_home")).alias("terminal"),
        F.when(F.col("last_sec").isNotNull(), F.struct(iso("last_sec").alias("timestamp"), ((F.col("k") * 13) % 1200).cast("double").alias("km_from_current"))).alias("last_transaction"),
    )


def embedding_rows(embeddings: DataFrame) -> DataFrame:
    """ref_id, vector, is_fraud of the embedding table: labels of 7 and more count as fraud."""
    return embeddings.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector"), (F.col("label") >= 7).cast("int").alias("is_fraud"))


def request_log(events: DataFrame, *more: str) -> DataFrame:
    """phase, duration_ns and columns of more: one row for each event."""
    phase = F.element_at(F.array(*map(F.lit, ("parse", "embed", "search", "total"))), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select(phase.alias("phase"), (F.col("value") * 1e6).cast("long").alias("duration_ns"), *more)


def eval_log(events: DataFrame) -> DataFrame:
    """id, expected_approved, approved, status and latency_ms: one row for each event."""
    expected = F.col("event_type") != "error"
    return events.select(
        F.col("event_id").alias("id"), expected.alias("expected_approved"), F.when(F.col("event_id") % 97 == 0, ~expected).otherwise(expected).alias("approved"),
        F.when(F.col("event_id") % 211 == 0, 500).otherwise(200).alias("status"), F.col("value").alias("latency_ms"),
    )
