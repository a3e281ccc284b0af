"""Key lookups and indexed filters (P1, P2, P7), in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_by_id(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows for many requested ids at once, and the ids that were not found.

    One equi-join instead of a scan per id; found = semi join, missing = anti join.
    """
    req = ids.select(key).distinct()
    return df.join(req, key, "left_semi"), req.join(df.select(key), key, "left_anti")


def exists_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``(key, exists)`` for every requested id."""
    have = df.select(key).distinct().withColumn("_e", F.lit(True))
    return (ids.select(key).distinct().join(have, key, "left")
            .select(key, F.coalesce("_e", F.lit(False)).alias("exists")))


def filter_indexed(df: DataFrame, category: str | None = None, available: bool | None = None,
                   status: str | None = None, created_from=None, created_to=None,
                   ts: str = "created_at") -> DataFrame:
    """The predicates the reference's secondary indexes serve.

    Plain ``filter``s on columns: Catalyst pushes them into the parquet scan
    (row-group statistics skip data) when the column maps to a stored one;
    ``created_from`` is inclusive, ``created_to`` exclusive.
    """
    if category is not None:
        df = df.filter(F.col("category") == category)
    if available is not None:
        df = df.filter(F.col("is_available") == available)
    if status is not None:
        df = df.filter(F.col("status") == status)
    if created_from is not None:
        df = df.filter(F.col(ts) >= F.lit(created_from).cast("timestamp_ntz"))
    if created_to is not None:
        df = df.filter(F.col(ts) < F.lit(created_to).cast("timestamp_ntz"))
    return df
