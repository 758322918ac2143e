"""From raw documents to token ids: five stages, each over all that the one before kept.

Run ``run(spark, sf_dir)``; every stage's result is written to the session's
shared folder and read again, so a lost executor never costs more than a stage, and
what a stage wrote besides is deleted then, as is the table that it read.

A stage's result has a few partitions for each core, as every file costs its writer more
than the bytes in it (see ``storage.gathered``).

Each stage takes any columns, whatever their names, beside doc_id (an integer) and
text, and gives them back as they are; an empty table gives an empty one; equal rows
are treated alike, and a very long text as a whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import line_dedup, ngram_join, prefix_bpe, shared, suffix_arrays, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from these documents and their labels.

    A null or empty text has the score of the class prior, so it stays.
    """
    return shared.gathered(toxicity.calm(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are like one before them; one of which no word is left by that goes as a whole.

    n_chars, if there, is that of the text that is left.  A null or empty text
    stays, and so does one without words that lost no line; rows of one id, or of
    none, are told apart by their texts.
    """
    inner = [f"c{k}" for k in range(len(docs.columns))]
    doc_id, text = (inner[docs.columns.index(c)] for c in ("doc_id", "text"))
    found = line_dedup.remove(docs.toDF(*inner), id_col=doc_id, text_col=text)
    left = F.col(text).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    found = found.where((F.col("n_removed") == 0) | left)
    if "n_chars" in docs.columns:
        n = inner[docs.columns.index("n_chars")]
        found = found.withColumn(n, F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return shared.gathered(found.select(*inner).toDF(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the similarity join, the one with the least id; texts without words and rows without an id stay."""
    return shared.gathered(ngram_join.one_of_each(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item; a null text has no words and stays."""
    return shared.gathered(suffix_arrays.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, and of each document's token ids their number, hashes of them and of the bytes that they give back, and the ids; a null text has none."""
    return shared.gathered(prefix_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", to_token_ids),
]

#: SQL can neither train the classifier nor encode; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with shared.scope(spark) as kept:
            docs = shared.cut(stage(spark, before, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
        shared.drop(before)
    return docs
