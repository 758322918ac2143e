"""Scoring of payloads as they arrive, running statistics, and a source of load."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from vicinal import storage
from vicinal.functions import features
from vicinal.operators import boxes, engine, knn
from vicinal.operators import index as ix
from vicinal.sources.constants import TRANSACTION

#: Bytes of reference vectors that every task of a stream may hold.
MOST_REFERENCES = 256 << 20
#: Bytes of a block of references where there are more, and queries that a task compares at once, about.
BLOCK, ASKED = 32 << 20, 1 << 15
#: References up to which a stream by batches searches them all; more are first dealt into boxes, if their places are few.
MOST_PLAIN = 1 << 18
MALFORMED = "_malformed"


def payload_stream(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Payloads of JSON files that appear in a folder; extra: more columns.  A malformed line is a row whose column MALFORMED has it."""
    schema = ", ".join(filter(None, [TRANSACTION, extra, f"{MALFORMED} string"]))
    return spark.readStream.schema(schema).option("columnNameOfCorruptRecord", MALFORMED).json(path)


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Payloads with an id, and the lines that are malformed or have none."""
    if MALFORMED not in rows.columns:
        return rows.where("id is not null"), None
    good = F.col(MALFORMED).isNull() & F.col("id").isNotNull()
    line = F.coalesce(MALFORMED, F.to_json(F.struct(*(c for c in rows.columns if c != MALFORMED))))
    return rows.where(good).drop(MALFORMED), rows.where(~good).select(line.alias("line"))


def _boxes(refs: DataFrame, least: int) -> boxes.Boxes | None:
    """References in boxes, if there are more than ``least`` and their places are few."""
    known = refs.where("vector is not null")
    rows, places = known.agg(F.count("*"), F.max(F.size("vector"))).first()
    return boxes.build(known, knn.K, rows) if rows > least and places <= boxes.MOST_PLACES else None


def score_stream(stream: DataFrame, refs: DataFrame, out: str, checkpoint: str, config: engine.SearchConfig | None = None, index: ix.Index | boxes.Boxes | None = None, id_col: str = "event_id", digits: int | None = None, rejects: str | None = None) -> StreamingQuery:
    """Decisions of each batch as Parquet under ``out``, one folder a batch, so that a batch made again replaces itself.

    Lines that are malformed or have no id go to ``rejects``, if it is given, in the same way.
    Many references of few places are dealt into boxes once, before the first batch.
    """
    config = config or engine.SearchConfig("brute_force")
    if config.strategy == "brute_force" and index is None:
        index = _boxes(refs, MOST_PLAIN)

    def each(batch: DataFrame, number: int) -> None:
        good, bad = _split(batch)
        with storage.scope(refs.sparkSession):
            engine.score_payloads(good, refs, config, index, id_col, digits).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if rejects and bad is not None:
            bad.write.mode("overwrite").text(f"{rejects}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decisions(stream: DataFrame, refs: DataFrame, id_col: str = "event_id", k: int = knn.K, digits: int | None = None, blocks: bool = False) -> DataFrame:
    """id_col, fraud_count, fraud_score, approved of each payload with all its features, by exact search in the stream itself.

    Every task holds the references, at most MOST_REFERENCES bytes of vectors; more
    are for ``score_stream``, or, with ``blocks``, are dealt into boxes and sent in
    blocks, of which a task holds one at a time and only while it has rows near
    enough for some of its queries (so are more than MOST_PLAIN references of few
    places, as that is faster).  The result goes to any sink that appends.
    """
    known = refs.where("vector is not null").select("ref_id", "vector", "is_fraud")
    size, n, places = known.agg(F.sum(8 * F.size("vector").cast("long")), F.count("*"), F.max(F.size("vector"))).first()
    if (size or 0) > MOST_REFERENCES and not blocks:
        raise ValueError(f"{size} bytes of references are too many for each task: use score_stream, or blocks")
    blocks = blocks and n > 0 and (size > MOST_REFERENCES or n > MOST_PLAIN and places <= boxes.MOST_PLACES)
    counts, at_once = (_counts_in_blocks(known, k), ASKED) if blocks else (_counts(known, k), 1)
    whole, _ = features.rejects(features.features(_split(stream)[0], digits=digits))
    kind = stream.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= at_once:
                yield decided(held)
                held = []
        if any(b.num_rows for b in held):
            yield decided(held)

    def decided(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        found = counts(knn.to_matrix(rows.column(1).combine_chunks()).astype(float))
        return pa.RecordBatch.from_arrays([rows.column(0).combine_chunks(), pa.array(found, pa.int32())], [id_col, "fraud_count"])

    found = features.assembled(whole, "q").select(id_col, "q").mapInArrow(run, f"`{id_col}` {kind}, fraud_count int")
    return knn.decide(found, k)


def _counts(known: DataFrame, k: int) -> Callable[[np.ndarray], np.ndarray]:
    """What counts fraud among the k nearest of each query, where every task holds all references."""
    rows = known.toArrow()
    vectors = knn.to_matrix(rows.column(1).combine_chunks()).astype(float)
    sent = known.sparkSession.sparkContext.broadcast((rows.column(0).to_numpy(), vectors, rows.column(2).fill_null(0).to_numpy().astype("int64")))

    def counts(q: np.ndarray) -> np.ndarray:
        best = knn.Best(np.arange(len(q)), q, k, "l2")
        best.see(*sent.value)
        return np.bincount(best.found[0], weights=best.found[3], minlength=len(q)).astype(np.int64)

    return counts


def _counts_in_blocks(known: DataFrame, k: int) -> Callable[[np.ndarray], np.ndarray]:
    """The same, where a task holds one block of references at a time."""
    made, context = boxes.build(known, k), known.sparkSession.sparkContext
    shape = context.broadcast((made.tree, made.start, made.low, made.high))
    sent = [(first, last, context.broadcast(block)) for first, last, block in made.blocks(BLOCK)]

    def loaded(block: Broadcast) -> dict:
        out = block.value
        vars(block).pop("_value", None)  # else the worker keeps every block that it has loaded
        return out

    def counts(q: np.ndarray) -> np.ndarray:
        blocks = [(first, last, lambda block=block: loaded(block)) for first, last, block in sent]
        return boxes.counted(q, boxes.Boxes(None, *shape.value, k), blocks, k)

    return counts


def running_stats(log: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Counts, average and longest duration by window and phase of a stream of ts, phase, duration_ns."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "phase").agg(F.count("*").alias("n"), F.avg("duration_ns").alias("avg_ns"), F.max("duration_ns").alias("max_ns"))


def load_stream(spark: SparkSession, entries: DataFrame, rate: int = 900, ramp: str = "120s", most: int | None = None, rows_per_batch: int | None = None) -> DataFrame:
    """The entries of a load test (number, request, expected_approved) as a stream that sends one after the other, at a rate that rises to ``rate`` a second; behind the last one it sends nothing.

    rows_per_batch: so many in each batch instead, as fast as they are taken; entries
    stay where they are read, and a batch's numbers are sent to them.  most: entries
    there are, if known.
    """
    if rows_per_batch:
        ticks = F.broadcast(spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load())
    else:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", rate).option("rampUpTime", ramp).load()
    if most is not None:
        ticks = ticks.where(F.col("value") < most)
    return ticks.join(entries, F.col("value") == F.col("number")).select("number", "timestamp", "request", "expected_approved")


def run_until(writer: DataStreamWriter, rows: int, rows_per_batch: int, seconds: float | None = None) -> None:
    """Runs a stream of ``load_stream`` until its source has given so many rows, however long that takes; TimeoutError if seconds are given and too few."""
    query = writer.start()
    try:
        began = time.monotonic()
        while not query.exception():
            last = query.lastProgress
            if last is not None and (last.batchId + 1) * rows_per_batch >= rows:
                break
            if not query.isActive or seconds is not None and time.monotonic() - began > seconds:
                raise TimeoutError(f"the stream ended or its {seconds} seconds were over before {rows} rows were sent")
            query.awaitTermination(0.1)
    finally:
        query.stop()
    if (failed := query.exception()) is not None:
        raise failed
