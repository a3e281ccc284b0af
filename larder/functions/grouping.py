"""Groups whose tasks hold no more rows when the table grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a task, about.
ROWS = 1 << 19
#: Buckets of keys whose rows are counted to find hot ones.
BUCKETS = 1 << 16


def dealt_groups(df: DataFrame, key: list[str], *aggs: Column, rows: int = ROWS) -> DataFrame:
    """``df.groupBy(*key).agg(*aggs)`` in tasks of about ``rows`` rows, as many as the table needs.

    A plain ``groupBy`` has a fixed number of tasks, and each holds all its groups in memory. Here tables of more rows than
    those tasks should hold are dealt by key into more of them. Keys in a bucket of over ``rows`` rows (at most one bucket for each task)
    are grouped by ``groupBy`` and its partial groups instead, so that no task reads a hot key's rows.
    """
    spark = df.sparkSession
    parts = -(-df.count() // rows)
    if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return df.groupBy(*key).agg(*aggs)
    bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS))
    hot = [r[0] for r in df.groupBy(bucket.alias("b")).count().filter(F.col("count") > rows).collect()]
    dealt = (df.filter(~bucket.isin(hot)) if hot else df).repartition(parts, *key).groupBy(*key).agg(*aggs)
    return dealt.unionByName(df.filter(bucket.isin(hot)).groupBy(*key).agg(*aggs)) if hot else dealt
