"""Tables of our own in the shared folder."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from vicinal import storage


def written(df):
    """The table that ``cut`` makes of df, and the names of its files."""
    out = storage.cut(df, "files")
    return out, os.listdir("/" + out._vicinal_path.removeprefix("file:").lstrip("/"))


def test_few_files_without_checksums(spark):
    """Each local file, and each of checksums, has the executor start a process."""
    rows = spark.range(0, 5000, 1, 150).withColumn("x", F.col("id") % 7)
    out, names = written(rows)
    assert sum(n.startswith("part-") for n in names) <= 16 and not [n for n in names if n.endswith(".crc")]
    assert sorted(map(tuple, out.collect())) == [(k, k % 7) for k in range(5000)]


def test_many_shuffle_partitions_are_not_squeezed(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "240")
    try:
        assert storage.gathered(spark.range(0, 5000, 1, 150)).rdd.getNumPartitions() == 30
        assert storage.gathered(spark.range(0, 5000, 1, 20)).rdd.getNumPartitions() == 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
