"""Connected components of links between long ids, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import free_shuffles
from larder.session import materialize

#: Parts into which a node's links are dealt where they meet the node's smallest neighbour.
SALT = 8


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links(u, v)`` with ``m`` of ``least(u, m)``; a node's links spread over SALT join keys."""
    salted = links.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALT)))
    dealt = least.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return salted.join(dealt, ["u", "s"]).drop("s")


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(u, v)``; component is the smallest node reachable.

    Large-star and small-star rounds until nothing changes; each round's links are
    written to the shared checkpoint folder, so the plan stays small and lost
    executors cost a task, not the job. NULL ends are no links. No links: no rows.
    """
    spark = links.sparkSession
    edges = materialize(
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or mark[0] == 0:
            break
        before = tuple(mark)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(_with_least(both, least).where("v > u")
                            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(),
                            "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        free_shuffles(spark)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
