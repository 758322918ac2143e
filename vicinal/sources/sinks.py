"""Where results go: decisions and reports as JSON, sweeps as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_answers(responses: DataFrame, path: str) -> None:
    """The JSON bodies of decisions, one a line."""
    responses.select("body").write.mode("overwrite").text(path)


def write_csv(report: DataFrame, path: str) -> None:
    """A recall sweep, or another small report, as one CSV file with a header."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one JSON text."""
    report.coalesce(1).write.mode("overwrite").text(path)
