"""Sharding by histogram sort.

Rows are ordered by (key, row number); probes are candidate boundaries in that
order. Each round counts, exactly and in all partitions, the bytes and rows
below every probe, and puts new probes where a splitter still lies, until every
splitter is within tolerance of its share of the bytes or no rows are left
between its neighbours. Then the rows are exchanged once, to their shard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.session import materialize, ship_package

SHARDS = 24
#: A splitter may miss its share by this part of a shard's bytes.
TOLERANCE = 0.0005
#: New probes for each open splitter and round, and about so many at most in a round (three for each open splitter at least).
PROBES, ROUND_PROBES = 64, 1 << 16
#: Most ranges that tables are cut into, as the driver holds a splitter of each: on larger tables ranges grow, and Spark's sorts spill.
MAX_PARTS = 1 << 14
#: Rows and bytes at most in one sorted run of a shard.
RUN_BYTES, RUN_ROWS = 128 << 20, 1_000_000

#: NULL keys come first.
_NULL = -(1 << 63)


def slot_of(keys: np.ndarray, ties: np.ndarray, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """For each (key, tie) the number of boundaries (keys, ties), in order, that are not above it."""
    at = np.searchsorted(keys, key, side="left")
    own = np.searchsorted(keys, key, side="right") > at
    for k in np.unique(key[own]):  # keys that boundaries fall into: their ties decide
        rows, start, end = np.flatnonzero(key == k), *np.searchsorted(keys, [k, k + 1], side="left")
        at[rows] = start + np.searchsorted(ties[start:end], tie[rows], side="right")
    return at


def _counts(rows: DataFrame, probes: list[tuple[int, int]]) -> np.ndarray:
    """Rows and bytes of ``rows(key, tie, size)`` from each probe up to the next; the first is below all."""
    ship_package(rows.sparkSession)
    keys = np.array([p[0] for p in probes], dtype=np.int64)
    ties = np.array([p[1] for p in probes], dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(keys) + 1), dtype=np.int64)
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            tie = batch.column("tie").to_numpy(zero_copy_only=False)
            size = batch.column("size").to_numpy(zero_copy_only=False)
            at = slot_of(keys, ties, key, tie)
            total[0] += np.bincount(at, minlength=len(keys) + 1)
            np.add.at(total[1], at, size)
        slot = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[0, slot]), pa.array(total[1, slot])], names=["slot", "rows", "bytes"])

    found = rows.select("key", "tie", "size").mapInArrow(count, "slot long, rows long, bytes long").groupBy("slot").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).collect()
    out = np.zeros((2, len(keys) + 1), dtype=np.int64)
    for r in found:  # as many as probes, whatever the table's size
        out[:, r["slot"]] = r["rows"], r["bytes"]
    return out


class Splitter:
    """Boundary (key, tie) with the rows and bytes below it."""

    def __init__(self, key: int, tie: int, rows: int, size: int):
        self.at, self.rows, self.bytes = (key, tie), rows, size


def splitters(rows: DataFrame, parts: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> tuple[list[Splitter], int, int]:
    """The ``parts - 1`` boundaries that cut ``rows(key, tie, size)`` into ranges of near equal bytes, and all rows and bytes.

    ``(key, tie)`` is not NULL; rows that share one are not parted. Only counts come to the driver: ``probes`` for each boundary and round.
    """
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.min("key"), F.max("key"), F.min("tie"), F.max("tie")).first()
    n, size = ends[0], ends[1] or 0
    if not n:
        return [Splitter(0, 0, 0, 0)] * (parts - 1), 0, 0
    low_tie, high_tie = ends[4], ends[5] + 1
    first, last = Splitter(ends[2], low_tie, 0, 0), Splitter(ends[3] + 1, low_tie, n, size)
    goal = [size * (i + 1) / parts for i in range(parts - 1)]
    low, high = [first] * (parts - 1), [last] * (parts - 1)

    def closed(i: int) -> bool:
        near = min(goal[i] - low[i].bytes, high[i].bytes - goal[i])
        return near <= tolerance * size / parts or high[i].rows - low[i].rows <= 1

    def between(a: Splitter, b: Splitter, probes: int) -> list[tuple[int, int]]:
        """Probes strictly between: by key, or by tie where both bounds have neighbouring keys."""
        (k0, t0), (k1, t1) = a.at, b.at
        if k1 - k0 > 1 or (k1 - k0 == 1 and t1 > low_tie and t0 == low_tie):
            step = max(1, (k1 - k0) // (probes + 1))
            return [(k, low_tie) for k in range(k0 + step, k1 + 1, step) if (k, low_tie) < b.at][: probes + 1]
        top = t1 if k1 == k0 else high_tie
        step = max(1, (top - t0) // (probes + 1))
        return [(k0, t) for t in range(t0 + step, top, step)][: probes + 1] + ([(k1, low_tie)] if k1 > k0 and (k1, low_tie) < b.at else [])

    while still := [i for i in range(parts - 1) if not closed(i)]:
        each = max(3, min(probes, ROUND_PROBES // len(still)))
        todo = sorted({p for i in still for p in between(low[i], high[i], each)})
        if not todo:
            break
        count = np.cumsum(_counts(rows, todo), axis=1)[:, :-1]
        below = count[1].tolist()
        for i in still:
            start, end = bisect_right(todo, low[i].at), bisect_left(todo, high[i].at)
            at = bisect_right(below, goal[i], start, end)  # the first probe above the goal
            if at < end:
                high[i] = Splitter(*todo[at], int(count[0, at]), below[at])
            if at > start:
                low[i] = Splitter(*todo[at - 1], int(count[0, at - 1]), below[at - 1])
    return [a if goal[i] - a.bytes <= b.bytes - goal[i] else b for i, (a, b) in enumerate(zip(low, high, strict=True))], n, size


def part_of(bounds: list[Splitter], offsets: list[int]):
    """Function of the columns (key, tie): struct of the number of boundaries not above, and that part's offset."""
    keys, ties = (np.array([b.at[i] for b in bounds], dtype=np.int64) for i in (0, 1))
    offset = np.array(offsets, dtype=np.int64)

    @F.pandas_udf("part int, offset long")
    def part(key: pd.Series, tie: pd.Series) -> pd.DataFrame:
        at = slot_of(keys, ties, key.to_numpy(), tie.to_numpy())
        return pd.DataFrame({"part": at, "offset": offset[at]})

    return part


def numbered(df: DataFrame, key: Column, size: Column, tag: str) -> DataFrame:
    """``df`` written to the shared folder: its columns in the struct ``row``, ``key`` (NULL lowest), ``size`` and a row number ``tie``."""
    return materialize(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(key.cast("long"), F.lit(_NULL)).alias("key"),
                                 size.cast("long").alias("size"), F.monotonically_increasing_id().alias("tie")), tag)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
          tolerance: float = TOLERANCE, run_bytes: int = RUN_BYTES, run_rows: int = RUN_ROWS) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text, NULL none, plus 8), ``shard`` and ``slot`` before its other columns.

    Shards are ranges of the integer id (NULL first, equal ids by row number) of near
    equal bytes; ``slot`` is the row's place in its shard by that order, from 0 without gaps.
    A shard is sorted in runs of about ``run_bytes`` and ``run_rows`` at most (more where there
    would be over MAX_PARTS runs), whose boundaries are splitters too. Repeated rows get slots of their own; fewer rows than
    shards leave shards empty; no rows give no rows. Columns of ``docs`` named size, shard
    or slot give way to the operator's.
    """
    rows = numbered(docs, F.col(id_col), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 8, "histogram")
    keys = rows.select("key", "tie", "size")
    whole = keys.agg(F.count(F.lit(1)), F.sum("size")).first()
    runs = max(1, -(-(whole[1] or 0) // (shards * run_bytes)), -(-whole[0] // (shards * run_rows)))
    runs = min(runs, max(1, MAX_PARTS // shards))
    bounds, _, _ = splitters(keys, shards * runs, tolerance)
    below = [0] + [b.rows for b in bounds]
    offsets = [below[i] - below[i - i % runs] for i in range(shards * runs)]
    order = Window.partitionBy("run").orderBy("key", "tie")
    placed = (rows.withColumn("part", part_of(bounds, offsets)("key", "tie")).withColumns({"run": F.col("part.part"), "off": F.col("part.offset")})
              .drop("part").withColumn("at", F.row_number().over(order)))
    named = {"size": F.col("size"), "shard": F.floor(F.col("run") / runs).cast("int"), "slot": F.col("off") + F.col("at") - 1}
    return placed.select(*[c.alias(n) for n, c in named.items()], *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in named])
