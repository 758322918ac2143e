"""The session that queries are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "vicinal", master: str | None = None, **more: str) -> SparkSession:
    """A session with UTC times, adaptive plans and Arrow; on a cluster the master comes from outside."""
    builder = SparkSession.builder.appName(name).config(map={**SETTINGS, **more})
    return (builder.master(master) if master else builder).getOrCreate()
