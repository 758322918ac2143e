"""What several text operators need: tables in the shared folder, bounded samples, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.storage import cut, delete, drop, folder, gathered, place, scope

__all__ = ["chosen", "cut", "delete", "drop", "folder", "gathered", "integer_id", "place", "sample", "scope"]


def sample(df: DataFrame, by: list[str], n: int, total: int | None = None) -> DataFrame:
    """n rows of df, the first ones by a hash of the columns ``by``: the same ones at every run, if these tell rows apart.

    Only rows whose hash is small enough to be among half as many again as wanted are
    ordered, so tasks pass on n rows in all, not n each.
    """
    total = df.count() if total is None else total
    span = 1 << 30
    place = F.pmod(F.xxhash64(*by), F.lit(span))
    few = df.where(place < int(span * min(1.0, (1.5 * n + 50) / max(1, total))))
    return few.orderBy(place, *by).limit(n)


def chosen(rows: DataFrame, n: int, size: int) -> list[tuple]:
    """(id, hash) of at most n rows of id, hash and size, the first by a hash of both, with at most ``size`` bytes in all; a row that would go beyond is left out."""
    out, held = [], 0
    for r in sorted(set(sample(rows, ["id", "hash"], n).collect()), key=lambda r: (r["hash"], r["id"])):  # n rows
        if held + r["size"] <= size:
            held += r["size"]
            out.append((r["id"], r["hash"]))
    return out


def integer_id(df: DataFrame, column: str) -> Column:
    """The column as long; one that isn't of an integer type is refused."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        raise TypeError(f"{column} is {df.schema[column].dataType.simpleString()}, not an integer")
    return F.col(f"`{column}`").cast("long")
