"""A join that no hot key puts in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same(left: list[Column], right: list[Column]) -> Column:
    """All columns equal, NULL equal to NULL."""
    return reduce(Column.__and__, [a.eqNullSafe(b) for a, b in zip(left, right, strict=True)], F.lit(True))


def meet(rows: DataFrame, table: DataFrame, key: list[str], count: str, most: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each ``key`` (NULL is a key) and in ``count`` how many of ``rows`` it has.

    Keys with more than ``most`` rows, by default a quarter of a shuffle partition's share, meet by broadcast: there are at most four for each
    partition, whatever the tables' sizes. The others are shuffled, so that no partition holds a hot key. ``count`` does not come back; other columns have different names.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = most or (table.agg(F.sum(count)).first()[0] or 0) / (4 * parts)
    theirs = [c for c in table.columns if c not in key and c != count]
    table = table.select(*[F.col(c).alias(f"_meet_{c}") for c in key], count, *theirs)
    on = same([F.col(c) for c in key], [F.col(f"_meet_{c}") for c in key])
    heavy, light = F.broadcast(table.filter(F.col(count) > share)), table.filter(F.col(count) <= share)
    out = [*rows.columns, *theirs]
    return rows.join(heavy, on).select(*out).unionByName(rows.join(heavy.drop(count, *theirs), on, "left_anti").join(light, on).select(*out))
