"""Ordered scans per key that do not put a hot key in one task.

A window ``partitionBy(key).orderBy(ts)`` sends every row of a key to one
task.  When one key may hold a third of the data, that task is the job.  So
``ordered`` cuts every key with more rows than a task should hold into ranges
of its order, the *buckets*, at splitters that are found once from counts and
a sample of those keys.  The bucket is then a plain expression of the row: no
row is stored, and one exchange by (key, bucket) serves the window.  What a
bucket must know of the ones before (or after) it comes from a summary of the
cut keys with one row per (key, bucket), and enters the window as one more
row at its edge; keys of one bucket need none.

Buckets are monotone in the key's order and windows compare NULLs as equal, so
results are exact, also for NULL keys, NULL times and ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.joins import same
from larder.session import discard, materialize

#: Number of a row's bucket: negative for keys that are not cut, from 0 on within a cut key.
BUCKET = "_bucket"
#: Sampled rows between two splitters of a key.
_SAMPLED = 32
#: Halvings that find a bucket among a key's splitters.
_HALVINGS = 32


def _splitters(df: DataFrame, keys: list[str], order: list[str], target: int, counts: DataFrame) -> DataFrame:
    """``(keys as _k..., _splits)`` of the keys with over ``target`` rows: boundaries of the order about ``target`` rows apart.

    The sample is by hash of the order's columns, the same in every run. There are at most rows / target such keys and as many boundaries.
    """
    heavy = counts.filter(F.col("_n") > target)
    each = max(1, target // _SAMPLED)
    met = df.join(F.broadcast(heavy), same([df[c] for c in keys], [heavy[f"_k{i}"] for i in range(len(keys))]))
    place = F.struct(*[df[c].alias(f"o{i}") for i, c in enumerate(order)])
    taken = met.filter(F.pmod(F.xxhash64(*[df[c] for c in order]), F.lit(each)) == 0)
    names = [f"_k{i}" for i in range(len(keys))]
    every = max(1, target // each)
    return (taken.groupBy(*names).agg(F.sort_array(F.collect_list(place)).alias("_s"))
            .select(*names, F.expr(f"filter(_s, (x, i) -> i > 0 and i % {every} = 0)").alias("_splits")))


def ordered(df: DataFrame, keys: list[str], order: list[str], target_rows: int | None = None) -> DataFrame:
    """``df`` with ``_bucket``, the range of its key's order that a row lies in.

    A bucket holds about ``target_rows`` rows, by default a shuffle partition's share of all.
    Rows equal in (keys, order) share a bucket.
    """
    spark = df.sparkSession
    counts = materialize(df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n")), "scan-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    target = target_rows or max(1, -(-total // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    splits = materialize(_splitters(df, keys, order, target, counts), "scan-splitters")
    discard(counts)
    if splits.isEmpty():
        return df.withColumn(BUCKET, F.lit(-1).cast("long"))
    met = df.join(F.broadcast(splits), same([df[c] for c in keys], [splits[f"_k{i}"] for i in range(len(keys))]), "left")
    place = F.struct(*[df[c].alias(f"o{i}") for i, c in enumerate(order)])

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
        up = F.struct((mid + 1).alias("a"), s["b"].alias("b"))
        down = F.struct(s["a"].alias("a"), mid.alias("b"))
        return F.when(s["a"] >= s["b"], s).when(F.get(F.col("_splits"), mid) <= place, up).otherwise(down)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(_HALVINGS)), F.struct(F.lit(0).alias("a"), F.size("_splits").alias("b")), halve)["a"]
    own = F.pmod(F.xxhash64(*[df[c] for c in keys]), F.lit(1 << 30)).cast("long")  # buckets of different keys differ in number, too
    bucket = F.when(F.col("_splits").isNull(), -1 - own).otherwise(F.shiftleft(own, 32) + found)
    return met.select(*[df[c] for c in df.columns], bucket.alias(BUCKET))


def ranges(df: DataFrame, order: list[str], target_rows: int) -> DataFrame:
    """``df`` stored in the shared folder with ``_bucket``, the number of its range of ``order``: about ``target_rows`` rows each."""
    parts = max(1, -(-df.count() // target_rows))
    ranged = df.repartitionByRange(parts, *[F.col(c) for c in order])
    return materialize(ranged.withColumn(BUCKET, F.spark_partition_id()), "ranges")


def _cut(df: DataFrame) -> DataFrame:
    """The rows of keys that have several buckets."""
    return df.filter(F.col(BUCKET) >= 0)


def _edge(df: DataFrame, carry: DataFrame, at: int) -> DataFrame:
    """``df`` with the rows of ``carry`` added; ``_edge`` is 1 for rows of ``df`` and ``at`` for the added ones."""
    return (df.withColumn("_edge", F.lit(1))
            .unionByName(carry.withColumn("_edge", F.lit(at)), allowMissingColumns=True))


def _inside(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_edge") == 1).drop("_edge")


def _rows_to_here(part: list[str], order: list[str]):
    return Window.partitionBy(*part).orderBy("_edge", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def _buckets(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(BUCKET)


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Inclusive running sums ``{out: value column}`` per key in ``order`` (NULL values add nothing)."""
    return _running(df, keys, order, values, F.sum)


def running_max(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Inclusive running maxima ``{out: value column}`` per key in ``order`` (NULL values count as none)."""
    return _running(df, keys, order, values, F.max)


def _running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], fold: Callable[[Column | str], Column]) -> DataFrame:
    part = keys + [BUCKET]
    given = df.withColumns({f"_v_{o}": F.col(v) for o, v in values.items()})
    ends = _cut(df).groupBy(*part).agg(*[fold(v).alias(f"_t_{o}") for o, v in values.items()])
    earlier = (ends.withColumn("_n", F.row_number().over(_buckets(keys)))
               .select(*part, "_n", *[fold(f"_t_{o}").over(_before(keys)).alias(f"_v_{o}") for o in values])
               .filter(F.col("_n") > 1).drop("_n"))
    w = _rows_to_here(part, order)
    both = _edge(given, earlier, 0)
    return _inside(both.withColumns({o: fold(f"_v_{o}").over(w) for o in values})).drop(*[f"_v_{o}" for o in values])


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``lag(value)`` per key in ``order``, NULL for the key's first row.

    Also sets ``_first`` (true on the key's first row), because a NULL
    previous value and "no previous row" must not be confused.
    """
    part = keys + [BUCKET]
    last = _cut(df).groupBy(*part).agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
    earlier = (last.withColumn("_n", F.row_number().over(_buckets(keys)))
               .select(*part, "_n", F.lag("_last").over(_buckets(keys)).alias(value)).filter(F.col("_n") > 1).drop("_n"))
    w = Window.partitionBy(*part).orderBy("_edge", *order)
    return _inside(_edge(df, earlier, 0).withColumn(out, F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1))


def next_value(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``lead(value)`` per key in ``order``, NULL for the key's last row."""
    part = keys + [BUCKET]
    first = _cut(df).groupBy(*part).agg(F.min_by(F.col(value), F.struct(*order)).alias("_next"))
    later = (first.withColumn("_n", F.lead(F.lit(1)).over(_buckets(keys)))
             .select(*part, "_n", F.lead("_next").over(_buckets(keys)).alias("_next")).filter(F.col("_n").isNotNull()).drop("_n"))
    w = Window.partitionBy(*part).orderBy("_edge", *order)
    return _inside(_edge(df.withColumn("_next", F.col(value)), later, 2).withColumn(out, F.lead("_next").over(w))).drop("_next")


def set_add_fold(df: DataFrame, keys: list[str], order: list[str], kind: str, value: str, init: Column, out: str) -> DataFrame:
    """Running state per key where a row either *sets* the state or *adds* to it.

    ``kind`` is 'set' or 'add' (anything else adds NULL, making the state
    NULL until the next set - as SQL arithmetic with an unknown CASE does).
    The state after each row is written to ``out``; ``init`` is the state
    before the key's first row.  The same fold runs over the buckets (each acts
    like one 'set' or 'add' row), and the state before a bucket enters it as a
    'set' row at its edge.
    """
    part = keys + [BUCKET]
    zero = F.lit(0).cast(df.schema[value].dataType)
    inner = _fold(_cut(df).withColumn("_edge", F.lit(1)), part, order, kind, value, zero, "_state")
    ends = inner.groupBy(*part).agg(F.max(F.coalesce(F.col(kind) == "set", F.lit(False))).alias("_sets"),
                                    F.max_by("_state", F.struct(*order)).alias("_end"))
    summary = ends.select(*part, F.when(F.col("_sets"), F.lit("set")).otherwise(F.lit("add")).alias("_k"), "_end", F.lit(1).alias("_edge"))
    after = _fold(summary, keys, [BUCKET], "_k", "_end", init, "_after")
    earlier = (after.withColumn("_n", F.row_number().over(_buckets(keys)))
               .select(*part, "_n", F.lit("set").alias(kind), F.lag("_after").over(_buckets(keys)).alias(value))
               .filter(F.col("_n") > 1).drop("_n"))
    return _inside(_fold(_edge(df, earlier, 0), part, order, kind, value, init, out))


def _fold(df: DataFrame, part: list[str], order: list[str], kind: str, value: str,
          init: Column, out: str) -> DataFrame:
    """The fold in one window per ``part``; a running count of 'set' rows numbers the segments."""
    w = _rows_to_here(part, order)
    is_set = F.coalesce(F.col(kind) == "set", F.lit(False))
    with_seg = df.withColumn("_seg", F.sum(F.when(is_set, 1).otherwise(0)).over(w))
    ws = _rows_to_here(part + ["_seg"], order)
    delta = F.when(is_set, F.lit(0)).when(F.col(kind) == "add", F.col(value))
    # a segment begins with its 'set' row, whose value may be NULL
    base = F.when(F.col("_seg") == 0, init).otherwise(F.first(F.col(value)).over(ws))
    # NULL delta (unknown kind) poisons the segment from that row on, like SQL
    poisoned = F.max(F.when(delta.isNull(), 1).otherwise(0)).over(ws) == 1
    total = base + F.sum(F.coalesce(delta, F.lit(0))).over(ws)
    return with_seg.withColumn(out, F.when(poisoned, F.lit(None)).otherwise(total)).drop("_seg")
