"""The folder that driver and executors share, and tables that are written there to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only where none is (local runs and tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = found.get() if found.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vicinal-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def place(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: Files of a table for each core at most, and shuffle partitions that one file has on average where those are very many.
FILES, PARTITIONS = 4, 8
#: For tables of our own.  Where the shared folder is a local one, Hadoop starts a process (chmod) for each file, and one more
#: for the file of checksums, which is left out here; row groups are small, as a task holds one in memory.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.block.size": str(32 << 20)}


def gathered(df: DataFrame) -> DataFrame:
    """df, whose partitions a few tasks for each core go through one after another, so that it is written to few files.

    No task holds more than before.  Where executors come and go, the cores of now say nothing, and df stays as it is.
    """
    spark = df.sparkSession
    if (spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled") or "").lower() == "true":
        return df
    return df.coalesce(max(FILES * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS))


#: Paths of tables that are written inside ``scope``.
_made: list[list[str]] = []


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """df, computed once and written to the shared folder, so that a lost executor costs no recomputation of it."""
    path = place(df.sparkSession, kind)
    gathered(df).write.options(**PLAIN).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vicinal_path = path
    for paths in _made:
        paths.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Deletes a table that ``cut`` has written and that nothing needs any more; other tables stay."""
    if path := getattr(df, "_vicinal_path", None):
        delete(df.sparkSession, path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end what ``cut`` has written inside, but for the tables that are put into the list."""
    kept: list[DataFrame] = []
    paths: list[str] = []
    _made.append(paths)
    try:
        yield kept
    finally:
        _made[:] = [x for x in _made if x is not paths]
        for path in paths:
            if path not in {getattr(df, "_vicinal_path", None) for df in kept}:
                delete(spark, path)
