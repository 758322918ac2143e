"""Recall of approximate searches, choice of the number of clusters, classification scores and telemetry."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal import storage
from vicinal.operators import index as ix
from vicinal.operators import knn

NPROBES = (1, 2, 4, 8, 16, 32)
CANDIDATES = (10, 15, 20, 30, 40, 50)

# Bounds of the latency histogram in milliseconds.
BOUNDS = (1, 5, 10, 50, 100, 500)
BUCKETS = ("<1ms", "1-5ms", "5-10ms", "10-50ms", "50-100ms", "100-500ms", ">=500ms")


def recall(approximate: DataFrame, exact: DataFrame, k: int = knn.K, by: tuple[str, ...] = ()) -> DataFrame:
    """The share of exact neighbours that were found; the denominator is k for each query."""
    n = exact.select("q_id").distinct().count()
    hits = approximate.join(exact.select("q_id", "ref_id").distinct(), ["q_id", "ref_id"], "left_semi")
    total = hits.groupBy(*by).agg(F.count("*").alias("hits")) if by else hits.agg(F.count("*").alias("hits"))
    return total.select(*by, (F.col("hits") / F.lit(float(max(1, k * n)))).alias("recall"))


def tuned(refs: DataFrame, index: ix.Index, nprobe: int, candidates: int, least: float, k: int = knn.K, queries: int = 500, seed: int = 43) -> int:
    """``candidates``, doubled until the reranked search finds the share ``least`` of the exact neighbours of a sample of the references, or until every row is one.

    More rows lie between a query and its neighbours the more there are, so a number
    of candidates that does for a small table loses neighbours in a large one.
    """
    q = storage.cut(ix.sampled(refs.where("vector is not null"), queries, seed).select(F.col("ref_id").alias("q_id"), F.col("vector").alias("q")), "tuning")
    truth = storage.cut(knn.exact_knn(q, refs, k).select("q_id", "ref_id"), "truth")
    rows = index.lists.count()
    while candidates < rows and recall(ix.reranked(q, index, k, nprobe, candidates), truth, k).first()["recall"] < least:
        candidates = min(2 * candidates, rows)
    storage.drop(q)
    storage.drop(truth)
    return candidates


def sweep(queries: DataFrame, index: ix.Index, refs: DataFrame, k: int = knn.K, nprobes: tuple[int, ...] = NPROBES, candidates: tuple[int, ...] = CANDIDATES) -> DataFrame:
    """nprobe, candidates, recall of the reranked search for every pair of settings.

    The lists are scanned once, for the most probes and candidates; what fewer of
    either would have found are the ranks among the hits of fewer probes.
    """
    for c in candidates:
        ix.check(k, c)
    spark = refs.sparkSession
    truth = storage.cut(knn.exact_knn(queries, refs, k).select("q_id", "ref_id"), "truth")
    hits = storage.cut(ix.scanned(ix.probe(queries, index.centres, max(nprobes)), index, max(candidates)), "hits")
    # Exact distances are computed once for each hit.
    x = hits.join(queries.select("q_id", "q"), "q_id").join(refs.select("ref_id", "vector"), "ref_id")
    x = x.select("q_id", "ref_id", "probe", "d2", ix.distance.l2_squared(F.col("q"), F.col("vector")).alias("exact"))
    probed = x.join(F.broadcast(spark.createDataFrame([(n,) for n in nprobes], "nprobe int")), F.col("probe") <= F.col("nprobe"))  # a handful of settings
    ranked = probed.withColumn("rk", F.row_number().over(Window.partitionBy("nprobe", "q_id").orderBy("d2", "ref_id"))).where(F.col("rk") <= max(candidates))
    own = ranked.join(F.broadcast(spark.createDataFrame([(c,) for c in candidates], "candidates int")), F.col("rk") <= F.col("candidates"))
    best = Window.partitionBy("nprobe", "candidates", "q_id").orderBy("exact", "ref_id")
    found = own.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    grid = spark.createDataFrame([(n, c) for n in nprobes for c in candidates], "nprobe int, candidates int")
    return grid.join(recall(found, truth, k, ("nprobe", "candidates")), ["nprobe", "candidates"], "left").select("nprobe", "candidates", F.coalesce("recall", F.lit(0.0)).alias("recall"))


def timed(make: Callable[[], tuple[DataFrame, int]], path: str) -> tuple[float, float]:
    """Average milliseconds a query and queries a second of a search, which is written to ``path``; ``make`` gives its DataFrame and the number of queries."""
    df, n = make()
    at = time.perf_counter()
    df.write.mode("overwrite").parquet(path)
    ms = 1000 * (time.perf_counter() - at) / max(1, n)
    return ms, 1000 / ms if ms else 0.0


def benchmark(queries: DataFrame, index: ix.Index, refs: DataFrame, k: int = knn.K, nprobes: tuple[int, ...] = NPROBES, candidates: tuple[int, ...] = CANDIDATES) -> DataFrame:
    """nprobe, candidates, recall, avg_ms, qps: each setting's search on its own, timed as a whole, as a sweep's CSV has it."""
    truth, n = storage.cut(knn.exact_knn(queries, refs, k).select("q_id", "ref_id"), "truth"), queries.count()
    rows = []
    for p in nprobes:
        for c in candidates:
            ix.check(k, c)
            at = storage.place(refs.sparkSession, "timed")

            def search(p: int = p, c: int = c) -> tuple[DataFrame, int]:
                return ix.rerank(queries, ix.scan(ix.probe(queries, index.centres, p), index, c), refs, k), n

            ms, qps = timed(search, at)
            found = refs.sparkSession.read.parquet(at)
            rows.append((p, c, float(recall(found, truth, k).first()["recall"]), ms, qps))
            storage.delete(refs.sparkSession, at)
    storage.drop(truth)
    return refs.sparkSession.createDataFrame(rows, "nprobe int, candidates int, recall double, avg_ms double, qps double")


def wcss(refs: DataFrame, centres: np.ndarray) -> DataFrame:
    """wcss: squared distances of all rows from their nearest centre."""
    return ix.sums(refs, centres).agg(F.sum("wcss").alias("wcss"))


def k_sweep(refs: DataFrame, ks: list[int], trials: int = 3, seed: int = 42, rounds: int = 25) -> DataFrame:
    """k and mean wcss over trials of trained centres."""
    rows = [(k, float(np.mean([wcss(refs, ix.train_centres(refs, k, seed + 31 * k + 17 * t, rounds)).first()[0] for t in range(trials)]))) for k in ks]
    return refs.sparkSession.createDataFrame(rows, "k int, wcss double")


def elbow(curve: DataFrame) -> DataFrame:
    """k: where the curve of wcss is farthest from the line between its ends, the least such k; fewer than three points: the greatest k.

    One row for each k tried, so a window over all rows is small.
    """
    every = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = curve.select("k", *(f(x).over(every).alias(f"{n}_{x}") for n, f in (("a", F.first), ("z", F.last)) for x in ("k", "wcss")), "wcss", F.count("*").over(every).alias("n"))
    x = (F.col("k") - F.col("a_k")) / F.nullif(F.col("z_k") - F.col("a_k"), F.lit(0)).cast("double")
    y = (F.col("wcss") - F.col("a_wcss")) / F.nullif(F.col("z_wcss") - F.col("a_wcss"), F.lit(0.0))
    far = F.coalesce(F.abs(x - y) / F.sqrt(F.lit(2.0)), F.lit(0.0))
    rank = F.when(F.col("n") < 3, F.col("k").cast("double")).otherwise(F.round(far, 12))
    return c.select("k", rank.alias("d")).orderBy(F.desc("d"), "k").limit(1).select("k")


def confusion(log: DataFrame) -> DataFrame:
    """tp, tn, fp, fn, err: fraud is positive and means denied; an answer other than 200 is an error and nothing else."""
    ok, fraud, denied = F.col("status") == 200, ~F.col("expected_approved"), ~F.col("approved")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return log.agg(count(ok & fraud & denied).alias("tp"), count(ok & ~fraud & ~denied).alias("tn"), count(ok & ~fraud & denied).alias("fp"), count(ok & fraud & ~denied).alias("fn"), F.count_if(F.coalesce(~ok, F.lit(True))).alias("err"))


def percentile(rows: DataFrame, column: str, share: float, keep: int = 1 << 20, bins: int = 4096) -> float | None:
    """The exact percentile, with linear interpolation between neighbours; nulls don't count, and None comes of no rows.

    Counts by ranges of values say which range has the ranks that are wanted, and
    that range is looked at more closely, until it has ``keep`` rows or one value;
    so tasks pass on ``bins`` counts, and the driver gets ``keep`` different values
    at most.
    """
    x = rows.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    place = share * (n - 1)
    ranks = [int(place), min(int(place) + 1, n - 1)]

    def ranked(rank: int) -> float:
        a, b, left, before = low, high, n, 0
        while left > keep and a < b:
            step = (b - a) / bins
            cell = F.least(F.floor((F.col("x") - F.lit(a)) / F.lit(step)), F.lit(bins - 1))
            counts = x.where(F.col("x").between(a, b)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("cell").collect()
            for c in counts:
                if before + c["n"] > rank:
                    break
                before += c["n"]
            if (c["a"], c["b"], c["n"]) == (a, b, left):
                break
            a, b, left = c["a"], c["b"], c["n"]
        for r in x.where(F.col("x").between(a, b)).groupBy("x").agg(F.count("*").alias("n")).orderBy("x").collect() if a < b else ():
            if before + r["n"] > rank:
                return r["x"]
            before += r["n"]
        return a

    first = ranked(ranks[0])
    return first if place == ranks[0] else first + (place - ranks[0]) * (ranked(ranks[1]) - first)


def p99(log: DataFrame) -> DataFrame:
    return log.sparkSession.createDataFrame([(percentile(log, "latency_ms", 0.99),)], "p99_ms double")


def p99_score(p: Column) -> Column:
    """0 for none, -3000 beyond two seconds, else 1000 for each power of ten below a second, down to a millisecond."""
    return F.when(p <= 0, 0.0).when(p > 2000, -3000.0).otherwise(1000.0 * F.log10(1000.0 / F.greatest(p, F.lit(1.0))))


def detection(counts: DataFrame) -> DataFrame:
    """Scores of a row of confusion counts: weighted errors, their rate, and the score with its two parts (null when cut)."""
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") + F.col("err")
    share = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
    x = counts.withColumn("weighted_errors", F.col("fp") + 3 * F.col("fn") + 5 * F.col("err")).withColumn("failure_rate", share(F.col("fp") + F.col("fn") + F.col("err"))).withColumn("n", n)
    x = x.withColumn("epsilon", F.when(F.col("n") > 0, F.col("weighted_errors") / F.col("n")).otherwise(F.lit(0.0))).withColumn("cut", F.col("failure_rate") > F.lit(0.15))
    x = x.withColumn("rate_component", F.when(~F.col("cut"), 1000.0 * F.log10(1.0 / F.greatest("epsilon", F.lit(0.001)))))
    x = x.withColumn("absolute_penalty", F.when(~F.col("cut"), -300.0 * F.log10(1.0 + F.col("weighted_errors"))))
    return x.withColumn("detection_score", F.when(F.col("cut"), -3000.0).otherwise(F.col("rate_component") + F.col("absolute_penalty")))


def contest(log: DataFrame) -> DataFrame:
    """One row: counts, p99, both scores and their sum, rounded as a report has them."""
    both = detection(confusion(log)).join(F.broadcast(p99(log).withColumn("p99_score", p99_score(F.col("p99_ms")))))  # one row each
    r = lambda c, d=2: F.round(c, d).alias(c)
    return both.select("tp", "tn", "fp", "fn", "err", r("p99_ms"), r("p99_score"), F.format_string("%.2f%%", 100 * F.col("failure_rate")).alias("failure_rate"), "weighted_errors", r("epsilon", 6), r("rate_component"), r("absolute_penalty"), r("detection_score"), F.round(F.col("p99_score") + F.col("detection_score"), 2).alias("final_score"))


def number(x: Column, digits: int) -> Column:
    """A number as JSON has it, rounded, without zeros at its end; null is null."""
    text = F.regexp_replace(F.format_string(f"%.{digits}f", F.round(x, digits)), r"\.?0+$", "")
    return F.when(x.isNotNull(), F.regexp_replace(text, r"^-0$", "0")).otherwise("null")


def _json(**parts: Column | str) -> Column:
    """A JSON object of texts that are JSON already."""
    out = [F.lit("{")]
    for k, (name, value) in enumerate(parts.items()):
        out += [F.lit("," * (k > 0) + f'"{name}":'), value.cast("string") if isinstance(value, Column) else F.lit(value)]
    return F.concat(*out, F.lit("}"))


def expected(log: DataFrame) -> DataFrame:
    """total, fraud_count, legit_count and their shares in percent, as a load-test file states them."""
    fraud = F.count_if(~F.col("expected_approved"))
    x = log.agg(F.count("*").alias("total"), fraud.alias("fraud_count"), F.count_if("expected_approved").alias("legit_count"))
    share = lambda c: F.when(F.col("total") > 0, F.round(100 * F.col(c) / F.col("total"), 2)).otherwise(0.0)
    return x.select("total", "fraud_count", "legit_count", share("fraud_count").alias("fraud_rate"), share("legit_count").alias("legit_rate"))


def report(log: DataFrame, stats: str | None = None) -> DataFrame:
    """The results of a load test as one JSON text.

    stats: what the test's file says of itself, as JSON; else it is counted.  Parts
    of a score that was cut are null, and all names are always there.
    """
    counts = detection(confusion(log)).withColumn("one", F.lit(1))
    late = p99(log).select(F.lit(1).alias("one"), F.coalesce("p99_ms", F.lit(0.0)).alias("p99_ms"))
    known = expected(log).select(F.lit(1).alias("one"), "total", "fraud_count", "legit_count", "fraud_rate", "legit_rate")
    x = counts.join(F.broadcast(late), "one").join(F.broadcast(known), "one").withColumn("p99_score", p99_score(F.col("p99_ms")))  # one row each
    c = F.col
    of_file = F.lit(stats) if stats else _json(total=c("total"), fraud_count=c("fraud_count"), legit_count=c("legit_count"), fraud_rate=number(c("fraud_rate"), 2), legit_rate=number(c("legit_rate"), 2))
    breakdown = _json(false_positive_detections=c("fp"), false_negative_detections=c("fn"), true_positive_detections=c("tp"), true_negative_detections=c("tn"), http_errors=c("err"))
    scoring = _json(
        breakdown=breakdown, failure_rate=F.concat(F.lit('"'), number(100 * c("failure_rate"), 2), F.lit('%"')), weighted_errors_E=c("weighted_errors"), error_rate_epsilon=number(c("epsilon"), 6),
        p99_score=_json(value=number(c("p99_score"), 2), cut_triggered=c("p99_ms") > 2000),
        detection_score=_json(value=number(c("detection_score"), 2), rate_component=number(c("rate_component"), 2), absolute_penalty=number(c("absolute_penalty"), 2), cut_triggered=c("cut")),
        final_score=number(c("p99_score") + c("detection_score"), 2),
    )
    late_text = F.concat(F.lit('"'), F.format_string("%.2f", F.round("p99_ms", 2)), F.lit('ms"'))
    return x.select(_json(expected=of_file, p99=late_text, scoring=scoring).alias("report"))


def bucket(ms: Column) -> Column:
    """The number of the bucket, from 0: half-open, the last one without end."""
    out = F.lit(len(BOUNDS))
    for k in reversed(range(len(BOUNDS))):
        out = F.when(ms < BOUNDS[k], k).otherwise(out)
    return out


def histogram(log: DataFrame) -> DataFrame:
    """phase, bucket (number), label, n: one row for each phase and bucket that has durations."""
    rows = log.select("phase", bucket(F.col("duration_ns") / 1e6).alias("bucket")).groupBy("phase", "bucket").agg(F.count("*").alias("n"))
    return rows.select("phase", "bucket", F.element_at(F.array(*map(F.lit, BUCKETS)), F.col("bucket") + 1).alias("label"), "n")


def bucket_percentiles(log: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """phase and p50_ms, p90_ms, p99_ms: the upper bound of the bucket that holds the rank; 500 for the last bucket."""
    by = Window.partitionBy("phase")
    c = histogram(log).withColumn("seen", F.sum("n").over(by.orderBy("bucket"))).withColumn("all", F.sum("n").over(by))
    upper = F.element_at(F.array(*map(F.lit, (*BOUNDS, BOUNDS[-1]))), F.col("bucket") + 1)
    return c.groupBy("phase").agg(*(F.min(F.when(F.col("seen") >= F.ceil(F.col("all") * F.lit(s)), upper)).alias(f"p{round(100 * s)}_ms") for s in shares))


def averages(log: DataFrame) -> DataFrame:
    """phase, count, avg_ms, max_ms."""
    return log.groupBy("phase").agg(F.count("*").alias("count"), F.round(F.avg("duration_ns") / 1e6, 6).alias("avg_ms"), F.round(F.max("duration_ns") / 1e6, 6).alias("max_ms"))


def gray_rate(votes: DataFrame) -> DataFrame:
    """total, gray and pct of votes in the gray zone; 0 without votes."""
    x = votes.agg(F.count("*").alias("total"), F.count_if(knn.is_gray(F.col("fraud_count"))).alias("gray"))
    return x.withColumn("pct", F.when(F.col("total") > 0, F.round(F.col("gray") * 100.0 / F.col("total"), 6)).otherwise(0.0))


#: The phases of a request, in the order of the statistics.
PHASES = ("parse", "embed", "search", "total")


def stats(log: DataFrame, votes: DataFrame) -> DataFrame:
    """The statistics as one JSON text: requests (those with a total), for each phase count, average, maximum, percentiles and all seven buckets, and the gray zone.

    One pass over the log; before the first request a phase has its count, 0, alone.
    Milliseconds are rounded to three places from whole nanoseconds, half up.
    """
    cells = []
    for p in PHASES:
        own = F.col("phase") == p
        cells += [F.count_if(own).alias(f"{p}_n"), F.coalesce(F.sum(F.when(own, F.col("duration_ns"))), F.lit(0)).alias(f"{p}_sum"), F.coalesce(F.max(F.when(own, F.col("duration_ns"))), F.lit(0)).alias(f"{p}_max")]
        cells += [F.count_if(own & (bucket(F.col("duration_ns") / 1e6) == b)).alias(f"{p}_{b}") for b in range(len(BUCKETS))]
    x = log.agg(*cells).withColumn("one", F.lit(1)).join(F.broadcast(gray_rate(votes).withColumn("one", F.lit(1))), "one")  # one row each

    def thousandths(n: str) -> Column:
        return F.concat(F.expr(f"({n}) div 1000").cast("string"), F.lit("."), F.lpad(F.expr(f"({n}) % 1000").cast("string"), 3, "0"))

    def upper(p: str, share: float) -> Column:
        out, rank = F.lit(0.0), F.ceil(F.lit(share) * F.col(f"{p}_n"))
        seen = [sum((F.col(f"{p}_{k}") for k in range(1, b + 1)), F.col(f"{p}_0")) for b in range(len(BUCKETS))]
        for b in reversed(range(len(BUCKETS))):
            out = F.when(seen[b] >= rank, F.lit(float((*BOUNDS, BOUNDS[-1])[b]))).otherwise(out)
        return F.when(F.col(f"{p}_n") > 0, out).otherwise(0.0)

    phases = {}
    for p in PHASES:
        n = F.col(f"{p}_n")
        average = F.when(n > 0, thousandths(f"(2 * {p}_sum + 1000 * {p}_n) div (2000 * greatest({p}_n, 1))")).otherwise("0.000")
        full = _json(count=n, avg_ms=average, max_ms=thousandths(f"({p}_max + 500) div 1000"), **{f"p{round(100 * s)}_ms": F.format_string("%.1f", upper(p, s)) for s in (0.5, 0.9, 0.99)}, buckets=_json(**{label: F.col(f"{p}_{b}") for b, label in enumerate(BUCKETS)}))
        phases[p] = F.when(F.col("total_n") > 0, full).otherwise('{"count":0}')
    gray = _json(count=F.col("gray"), pct=F.format_string("%.2f", F.round("pct", 2)))
    return x.select(_json(total_requests=F.col("total_n"), phases=_json(**phases), gray_zone=gray).alias("stats"))


def slow(log: DataFrame, least_ms: float = 50.0) -> DataFrame:
    """Searches that took longer."""
    return log.where((F.col("phase") == "search") & (F.col("duration_ns") > least_ms * 1e6))


def ready(spark: SparkSession, path: str) -> bool:
    """Whether an index can be read from there."""
    try:
        return len(ix.read(spark, path).centres) > 0
    except Exception:
        return False
