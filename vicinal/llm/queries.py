"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vicinal.llm import sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans and those that the field adds."""
    from vicinal.llm import pii

    return pii.find(_table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document by shingles of five words."""
    from vicinal.llm import ngram_join, shared

    return shared.gathered(ngram_join.join(_table(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines, and length and hash of what is left of every document."""
    from pyspark.sql import functions as F

    from vicinal.llm import line_dedup, shared

    found = line_dedup.remove(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return shared.gathered(found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document in directly addressable files, read back."""
    import public_tokenizers

    from vicinal.llm.dac import stored_ids

    return stored_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by tables of last tokens, and the bytes that they give back."""
    import public_tokenizers

    from vicinal.llm.prefix_bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with benchmark items, by suffix arrays, and its longest verbatim match and where that is."""
    from vicinal.llm import suffix_arrays

    found = suffix_arrays.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from toxic labels and unlabelled texts."""
    from vicinal.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans and literals assigned to sensitive names."""
    from vicinal.llm import secrets

    return secrets.find(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, divergences and verdict of every document."""
    from vicinal.llm import quality

    from pyspark.sql import functions as F

    found = quality.judge(_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("js_class", "js_word")})


#: Rules of the URL query: verdict, host, path.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Parts of the hosts that the list of the URL query holds URLs of.
LISTED_HOSTS = ("spam-farm.", "cheap-pills.", "casino-win.", "free-bets.", "ads-track.", "adult-x.")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages.

    The list holds, written in another way, the URLs of such pages of six families
    of hosts whose id isn't divisible by three, and for each one more of its host
    that no page has.
    """
    from pyspark.sql import functions as F

    from vicinal.llm import urls

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = urls.host_and_path(F.col("url"))
    bad = pages.where(F.greatest(*(F.locate(h, host) for h in LISTED_HOSTS)) > 0).where("page_id % 3 <> 0")
    listed = bad.select(F.explode(F.array(F.concat(F.lit("https://WWW."), urls.canonical(host, path), F.lit("/?from=list")), F.concat(F.lit("http://"), host, F.lit("/unseen/"), F.col("page_id").cast("string")))).alias("url"))
    return urls.judge(pages, listed, URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_ngram_join": op2_ngram_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_ids": op4_token_ids,
    "op5_byte_bpe": op5_byte_bpe,
    "op7_decontamination": op7_decontamination,
    "op6_quality": op6_quality,
    "op8_urls": op8_urls,
    "op9_toxicity": op9_toxicity,
    "op10_secrets": op10_secrets,
}

SQL: dict[str, str] = {
    "op2_ngram_join": sql.NGRAM_JOIN,
    "op3_line_dedup": sql.LINE_DEDUP,
    "op6_quality": sql.QUALITY,
    "op7_decontamination": sql.DECONTAMINATION,
    "op8_urls": sql.urls(URL_RULES, LISTED_HOSTS),
}
