"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

The filter holds the listed URLs.  What it lets pass surely isn't listed and goes
on at once; what it holds back is joined with the list itself, which removes the
false positives.  So only a list's worth of rows is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm import bloom, shared

#: Verdict, host and path of a rule.
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end.

    A null url and one without ``://`` have neither (both empty).
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.`` before it and port, and path without index page, suffix and last slashes; null without a host."""
    host = F.regexp_replace(F.regexp_replace(host, r":[0-9]*\z", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?\z", ""), r"/+\z", "")
    return F.when(host != "", F.concat(host, path))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path joined) and its verdict; null without one.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Of equally long rules the first given wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """id_col, host, path, rule and verdict (allow or block) of every row of pages.

    Without a rule the verdict is block if the canonical URL is one of the
    canonical URLs of ``listed``, else allow.  Null and repeated rows on either
    side, an empty list and an empty table are all fine; a URL without a host is
    never listed; very long URLs are URLs like others; other columns are not read,
    whatever their names.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", name.alias("rule"), verdict.alias("ruled"), canonical(F.col("host"), F.col("path")).alias("canonical"))

    bad_host, bad_path = host_and_path(F.col("url"))
    bad = listed.select(F.col(f"`{listed_col}`").cast("string").alias("url")).select(bad_host.alias("host"), bad_path.alias("path"))
    bad = shared.cut(bad.select(canonical(F.col("host"), F.col("path")).alias("canonical")).where("canonical is not null").distinct(), "listed")
    sent = spark.sparkContext.broadcast(bloom.build(bad, F.xxhash64("canonical"), bad.count()))  # 16 MB at most

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = sent.value.contains(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(maybe)], names)

    names = ["id", "host", "path", "rule", "ruled", "canonical", "maybe"]
    schema = f"id {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, ruled string, canonical string, maybe boolean"
    # Written once, as both ways read it; pages themselves are read once.
    probed = shared.cut(rows.withColumn("hash", F.xxhash64("canonical")).mapInArrow(probe, schema), "probed")
    asked = F.coalesce(F.col("maybe") & F.col("ruled").isNull() & F.col("canonical").isNotNull(), F.lit(False))
    held = probed.where(asked).join(bad.withColumn("listed", F.lit(True)), "canonical", "left").withColumn("method", F.when(F.col("listed"), "block").otherwise("allow"))
    columns = [F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "method").alias("verdict")]
    return probed.where(~asked).withColumn("method", F.lit("allow")).select(*columns).unionByName(held.select(*columns))
