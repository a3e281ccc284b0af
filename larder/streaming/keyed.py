"""Keyed state for streams: rows that come out of order are put in order, key by key.

``InOrder`` holds a key's rows back until the watermark reaches them and then
hands them to ``apply`` in the order (time, id), so what a stream gives does
not depend on the order in which rows came, as long as none comes after the
watermark has passed it. Those that do are given out as late and change
nothing.

Keys are dealt into KEY_BUCKETS state keys, as every state key costs calls to
the state store in each batch that touches it. State of a bucket, as Arrow
tables: the rows that wait (list state, a table a chunk, no more than a batch and
the watermark's delay span) and the last applied row of each of its keys (value
state). With ``idle`` a key's last row goes once the watermark is so far past it;
its next row then counts as a first one.

Times are microseconds, watermarks and timers milliseconds, both since 1970.
"""

from __future__ import annotations

import sys
from abc import abstractmethod
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from larder.functions.scalar import epoch_micros
from larder.session import ship_package

# Processors go to the workers whole: the one that Spark starts beside the driver does not see shipped files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Time of the row that ends a finite stream: the watermark passes every row.
END_OF_STREAM = "9999-01-01 00:00:00"
#: Keys are dealt into so many state keys; fixed, as a checkpoint holds them.
KEY_BUCKETS = 1024


def _place(row: tuple) -> tuple:
    """Where a row stands in its key's order: by time, then by id, NULL first."""
    return row[0], row[1] is not None, 0 if row[1] is None else row[1]


def _pack(rows: list[tuple], schema: pa.Schema) -> bytes:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as w:
        w.write_batch(pa.record_batch(columns, schema=schema))
    return out.getvalue().to_pybytes()


def _unpack(held: bytes) -> list[tuple]:
    columns = [c.to_pylist() for c in pa.ipc.open_stream(held).read_all().columns]
    return list(zip(*columns, strict=True))


class InOrder(StatefulProcessor):
    """Applies the rows ``(at, event_id, ...)`` of each key in order; ``row`` and ``state`` are the schemas of a row and of what ``apply`` keeps."""

    def __init__(self, row: str, state: str, columns: list[str], idle_ms: int | None = None):
        self.columns, self.idle_ms = columns, idle_ms
        kept = T.StructType.fromDDL(row)
        self.fields = kept.names
        own = T.StructType().add("own", "string")
        self.row_schema = to_arrow_schema(T.StructType(own.fields + kept.fields))
        # the place of the last applied row comes first
        self.last_schema = to_arrow_schema(T.StructType(own.fields + kept.fields[:2] + T.StructType.fromDDL(state).fields))

    @abstractmethod
    def apply(self, last: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        """The state after ``row`` and what it gives out (None: nothing). ``last``: the state before, None at a key's first row."""

    @abstractmethod
    def late(self, row: tuple) -> tuple:
        """What a late row gives out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "held binary")
        self.last = handle.getValueState("last", "held binary")

    def _out(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["own", *self.columns], dtype=object)

    def _wake(self, rows: list[tuple]) -> None:
        """A timer for the first of the rows: timers run when the watermark is past them."""
        self.handle.registerTimer(min(r[1] for r in rows) // 1000 - 1)

    def _apply_due(self, last: dict[str | None, tuple], watermark: int) -> list[tuple]:
        """Apply the waiting rows that the watermark has reached, keep the others, and set ``last``. Returns what comes out."""
        rows = [r for held in self.waiting.get() for r in _unpack(held[0])]
        due = sorted((r for r in rows if r[1] // 1000 <= watermark), key=lambda r: _place(r[1:]))
        if not due:
            self._wake(rows)
            return []
        left = [r for r in rows if r[1] // 1000 > watermark]
        if left:
            self.waiting.put([(_pack(left, self.row_schema),)])
            self._wake(left)
        else:
            self.waiting.clear()
        out = []
        for own, *values in due:
            r, held = tuple(values), last.get(own)
            place, state = (held[:2], held[2:]) if held else (None, None)
            if place is not None and _place(r) < _place(place):
                out.append((own, *self.late(r)))
                continue
            if self.idle_ms is not None and place is not None and r[0] // 1000 > place[0] // 1000 + self.idle_ms:
                state = None    # as if the timer had come between
            state, given = self.apply(state, r)
            last[own] = (*r[:2], *state)
            if given is not None:
                out.append((own, *given))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for chunk in rows:   # a bucket's rows come in chunks and wait in the state store, not in this process
            given, on_time = [], []
            named = chunk[["nulls", "own", *self.fields]].astype(object)
            for nulls, own, *values in named.where(named.notna(), None).itertuples(index=False, name=None):
                r = tuple(None if nulls >> i & 1 else v for i, v in enumerate(values)) if nulls else tuple(values)
                if r[0] is None or r[0] // 1000 < watermark:
                    given.append((own, *self.late(r)))
                else:
                    on_time.append((own, *r))
            if on_time:
                self.waiting.appendValue((_pack(on_time, self.row_schema),))
                self._wake(on_time)
            yield from self._out(given)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, waiting = timerValues.getCurrentWatermarkInMs(), self.waiting.exists()
        if not waiting and self.idle_ms is None:    # an earlier timer of this batch has taken them
            return
        last = {own: tuple(r) for own, *r in _unpack(self.last.get()[0])} if self.last.exists() else {}
        out = self._apply_due(last, watermark) if waiting else []
        if self.idle_ms is not None:    # rows that wait are later than the watermark
            last = {own: r for own, r in last.items() if r[0] // 1000 + self.idle_ms > watermark}
            if last:
                self.handle.registerTimer(min(r[0] for r in last.values()) // 1000 + self.idle_ms)
        if last:
            self.last.update((_pack([(own, *r) for own, r in last.items()], self.last_schema),))
        elif self.last.exists():
            self.last.clear()
        yield from self._out(out)

    def close(self) -> None:
        pass


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def in_order(rows: DataFrame, key: str, ts: str, seq: str, delay: str, processor: InOrder, out: str) -> DataFrame:
    """``processor`` over ``rows`` by ``key``: the key and the columns ``out``. ``delay`` is how far rows may come out of order.

    The watermark is taken on a column that is dropped again, so that Spark passes late rows on to the processor.
    The row that ends a finite stream only moves the watermark (its filter names the marked column, or Spark would filter first).
    Keys travel as text; whole numbers come with bits for their NULLs, as a table of pandas would make floats of them.
    """
    ship_package(rows.sparkSession)
    marked = rows.withColumn("_mark", F.timestamp_micros(F.col("at"))).withWatermark("_mark", delay)
    last = F.timestamp_micros(epoch_micros(F.lit(END_OF_STREAM).cast("timestamp_ntz")))
    taken = marked.filter(F.col("event_id").isNotNull() | F.col("_mark").isNull() | (F.col("_mark") < last)).drop("_mark")
    kind = rows.schema[key].dataType.simpleString()
    whole = {c: i for i, c in enumerate(processor.fields) if rows.schema[c].dataType.simpleString() in _WHOLE}
    nulls = sum([F.when(F.col(c).isNull(), 1 << i).otherwise(0) for c, i in whole.items()], F.lit(0)).cast("long")
    plain = [F.coalesce(c, F.lit(0).cast(rows.schema[c].dataType)).alias(c) if c in whole else F.col(c) for c in processor.fields]
    own = F.hex(key) if kind == "binary" else F.col(key).cast("string")
    dealt = taken.select(F.pmod(F.xxhash64(own), F.lit(KEY_BUCKETS)).cast("int").alias("bucket"), own.alias("own"), nulls.alias("nulls"), *plain)
    got = dealt.groupBy("bucket").transformWithStateInPandas(processor, f"own string, {out}", "append", "eventTime")
    back = F.unhex("own") if kind == "binary" else F.col("own").cast(kind)
    return got.select(back.alias(key), *processor.columns)


def micros(ts: str) -> Column:
    return epoch_micros(ts).alias("at")


def from_micros(c: str) -> Column:
    return F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast({c} / 1000000bd as decimal(18,6)))")


def end_stream(schema: T.StructType, folder: str, ts: str, spark) -> None:
    """Add a file to the folder of a finite stream whose one row, far in the future and NULL but for the time, lets the watermark pass all others."""
    row = [None if f.name != ts else END_OF_STREAM for f in schema.fields]
    kinds = T.StructType([T.StructField(f.name, T.StringType() if f.name == ts else f.dataType) for f in schema.fields])
    spark.createDataFrame([tuple(row)], kinds).withColumn(ts, F.col(ts).cast(schema[ts].dataType)).coalesce(1).write.mode("append").parquet(folder)
