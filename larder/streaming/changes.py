"""Structured Streaming forms of the change-tracking operators (ST1-ST4).

The reference's triggers process one row at a time; here the same rules run
on micro-batches with keyed state:

* ST1 status history and ST2 stock balance: ``transformWithStateInPandas``
  keyed by buckets of orders / ingredients (``streaming.keyed``).  Rows wait in list state
  until the watermark reaches them and are applied in (ts, event_id) order by
  event-time timers; an event behind the watermark is emitted with ``late =
  true`` instead of being folded in (an adjustment does not commute, so
  applying it out of order would be wrong).
* ST3 price history: ``foreachBatch`` merges each batch into the open intervals
  and publishes a version named after the batch id - a re-run of a published
  batch does nothing, one of a half-written batch writes it again; late
  observations are published on their own.
* ST4 popularity: lines and order statuses are two streams; the flips of orders
  (that close, or open again) join the lines, and a sink publishes the
  changed keys only. With static orders, a streaming
  aggregate in ``complete`` mode.

Every query has its own checkpoint location in the shared folder.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Decimal, localcontext

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from larder.functions.scalar import history_id
from larder.operators import history
from larder.session import ship_package
from larder.sources import files
from larder.streaming import keyed

cloudpickle.register_pickle_by_value(sys.modules[__name__])    # as in ``keyed``

# ---- sources -------------------------------------------------------------------


#: Files of one micro-batch: bounds what a first run over a stored table holds in state functions.
MAX_FILES = 1_000


def read_table_stream(spark: SparkSession, directory: str, glob: str, max_files: int = MAX_FILES) -> DataFrame:
    """Parquet files of ``directory`` matching ``glob`` as a stream (schema from the files)."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(directory).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return r.option("maxFilesPerTrigger", max_files).parquet(directory)


#: List states, value states and timers need this store.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


# ---- ST1 --------------------------------------------------------------------------
class _StatusChanges(keyed.InOrder):
    def apply(self, last, row):
        at, event, status = row
        # IS DISTINCT FROM: a first row is a change, also of NULL
        return (status,), ((status, at, event, False) if last is None or last[0] != status else None)

    def late(self, row):
        at, event, status = row
        return status, at, event, True


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _millis(span: str | None) -> int | None:
    return None if span is None else int(pd.Timedelta(span).total_seconds() * 1000)


def status_history_stream(changes: DataFrame, delay: str = "0 seconds", idle: str | None = None) -> DataFrame:
    """ST1: streaming W3.  Input (event_id, order_id, status, ts); output W3's columns + ``late``.

    Ids are of any type with an order. Rows that come at most ``delay`` out of order are put in order; a row behind the
    watermark is late (as is one without a time). ``idle``: forget an order so long after its last change.
    """
    event = _kind(changes, "event_id")
    s = changes.select("order_id", keyed.micros("ts"), "event_id", "status")
    processor = _StatusChanges(f"at bigint, event_id {event}, status string", "status string", ["status", "at", "event_id", "late"], _millis(idle))
    out = keyed.in_order(s, "order_id", "ts", "event_id", delay, processor,
                         f"status string, at bigint, event_id {event}, late boolean")
    return (out.withColumn("created_at", keyed.from_micros("at"))
            .select(history_id("order_id", "created_at", "event_id").alias("id"), "order_id", "status", "created_at", "late"))


# ---- ST2 --------------------------------------------------------------------------
class _Balances(keyed.InOrder):
    def __init__(self, opening: str, *how):
        super().__init__(*how)
        self.opening = Decimal(opening)

    def apply(self, last, row):
        _, event, kind, amount = row
        balance = self.opening if last is None else None if last[0] is None else Decimal(last[0])
        amount = None if amount is None else Decimal(amount)
        if kind == "adjustment":
            balance = amount
        elif balance is None or amount is None or kind not in ("increment", "decrement"):
            balance = None      # an unknown type makes the balance unknown until the next adjustment
        else:
            with localcontext() as exact:
                exact.prec = 60
                balance = balance + amount if kind == "increment" else balance - amount
        text = None if balance is None else format(balance, "f")
        return (text,), (event, kind, text, False)

    def late(self, row):
        _, event, kind, _ = row
        return event, kind, None, True


def stock_balance_stream(tx: DataFrame, opening: str = "0.00", delay: str = "0 seconds", idle: str | None = None) -> DataFrame:
    """ST2: streaming W2, with ids, ``delay`` and ``idle`` as in ``status_history_stream``; a forgotten ingredient starts from ``opening``.

    Quantities travel as decimal text, so the state is exact at any scale.
    """
    event, dtype = _kind(tx, "event_id"), tx.schema["quantity"].dataType
    s = tx.select("inventory_id", keyed.micros("ts"), "event_id", "transaction_type", F.col("quantity").cast("string").alias("amount"))
    processor = _Balances(opening, f"at bigint, event_id {event}, transaction_type string, amount string", "balance string",
                          ["event_id", "transaction_type", "balance", "late"], _millis(idle))
    out = keyed.in_order(s, "inventory_id", "ts", "event_id", delay, processor,
                         f"event_id {event}, transaction_type string, balance string, late boolean")
    return out.select("event_id", "inventory_id", "transaction_type",
                      F.col("balance").cast(f"decimal(38,{getattr(dtype, 'scale', 6)})").alias("balance"), "late")


# ---- ST3 --------------------------------------------------------------------------
def price_history_sink(root: str, late_root: str | None = None):
    """ST3 ``foreachBatch`` function: merge a batch of (menu_item_id, ts, price) into the history.

    The open interval of every item is re-fed as a seed observation, so the
    batch's first observation is compared against the current price.  Closed
    intervals are never written again: a version is the folders of the ones
    before, for closed intervals, and one with the open intervals.
    Observations not after the item's open interval start are late: they are
    published under ``late_root`` (if given) and change nothing.  Publishes
    version ``<batch_id>``; a published batch id is skipped, and what a crash
    left of one is written again, so a replay gives the same history.
    """
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = f"{batch_id:012d}"
        if files.is_published(spark, root, version):
            return
        obs = batch.select("menu_item_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "price")
        opened = read_open(spark, root)
        if opened is not None:
            seeds = opened.select("menu_item_id", F.col("effective_from").alias("ts"), "price")
            known = seeds.select("menu_item_id", F.col("ts").alias("_open"))
            met = obs.join(known, "menu_item_id", "left")
            fresh = F.col("_open").isNull() | (F.col("ts") > F.col("_open"))
            if late_root is not None and not files.is_published(spark, late_root, version):
                files.write_snapshot(met.filter(~fresh).drop("_open"), late_root, version=version)
            obs = seeds.unionByName(met.filter(fresh).drop("_open"))
        elif late_root is not None and not files.is_published(spark, late_root, version):
            files.write_snapshot(obs.limit(0), late_root, version=version)
        merged = history.price_history(obs).withColumn("open", F.col("effective_to").isNull())
        files.add_folders(merged, root, version, "open")
    return fn


def read_open(spark: SparkSession, root: str) -> DataFrame | None:
    """The open intervals of the latest version, None if nothing is published."""
    paths = files.current_version(spark, root)
    return spark.read.parquet(f"{paths[0][-1]}/open=true").drop("open") if paths else None


def read_price_history(spark: SparkSession, root: str) -> DataFrame:
    """The closed intervals of all versions, and the open ones of the latest."""
    paths, _ = files.current_version(spark, root)
    every = [f"{p}/open=false" for p in files.published_folders(spark, root)] + [f"{paths[-1]}/open=true"]
    return spark.read.parquet(*every)


def read_all_versions(spark: SparkSession, root: str) -> DataFrame:
    """Rows of every published version (late observations)."""
    return spark.read.parquet(*files.published_folders(spark, root))


# ---- ST4 --------------------------------------------------------------------------
def popular_items_stream(items: DataFrame, orders: DataFrame) -> DataFrame:
    """ST4: running A3 - stream of order lines joined to the (static) closed orders, summed per product."""
    closed = orders.filter(F.col("status") == "closed").select("order_id")
    return items.join(closed, "order_id", "left_semi").groupBy("product_id").agg(F.sum("quantity").alias("quantity"))


def snapshot_sink(root: str):
    """``foreachBatch`` function publishing each complete-mode result as version ``<batch_id>``."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        if files.is_published(batch.sparkSession, root, f"{batch_id:012d}"):
            return
        files.write_snapshot(batch, root, version=f"{batch_id:012d}")
    return fn


#: Orders are dealt into so many state keys; fixed, as a checkpoint holds them.
ORDER_BUCKETS = 4096


class _Flips(StatefulProcessor):
    """The latest status of every order of a bucket; gives out the orders that a batch closes (1) or opens again (-1)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.orders = handle.getValueState("orders", "held binary")    # an Arrow table of own, at, closed

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pa.concat_tables([pa.Table.from_pandas(chunk[["own", "at", "closed"]], _ORDERS, preserve_index=False) for chunk in rows])
        held = pa.ipc.open_stream(self.orders.get()[0]).read_all() if self.orders.exists() else _ORDERS.empty_table()
        every = pa.concat_tables([held, new]).to_pandas()
        # the latest holds, of equal times the one that came last
        last = every.sort_values("at", kind="stable").drop_duplicates("own", keep="last")
        was = held.to_pandas().set_index("own")["closed"].astype(bool).reindex(last["own"], fill_value=False).to_numpy()
        sign = last["closed"].to_numpy().astype(int) - was.astype(int)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _ORDERS) as w:
            w.write_table(pa.Table.from_pandas(last, _ORDERS, preserve_index=False))
        self.orders.update((out.getvalue().to_pybytes(),))
        if sign.any():
            yield pd.DataFrame({"own": last["own"].to_numpy()[sign != 0], "sign": sign[sign != 0]})

    def close(self) -> None:
        pass


_ORDERS = pa.schema([("own", pa.string()), ("at", pa.int64()), ("closed", pa.bool_())])


def popular_changes_stream(items: DataFrame, statuses: DataFrame) -> DataFrame:
    """ST4 over orders that change: streams of lines (order_id, product_id, quantity) and of statuses (order_id, status, ts).

    Gives ``product_id, quantity, lines``: what the totals of A3 gain, or lose where a closed order is opened again. Lines
    and statuses may come in any order; of an order's statuses the one with the latest time holds.

    Statuses become flips of orders (1 closes, -1 opens again), in state of many orders a key. A join of the two streams
    brings every line to every flip of its order once, whichever comes first; an order's flips sum up to 1 while it is closed, else to 0.
    """
    ship_package(items.sparkSession)
    own = F.coalesce(F.concat(F.lit("="), F.col("order_id").cast("string")), F.lit("")).alias("own")    # NULL is an order, too
    heads = statuses.select(own, keyed.micros("ts"), F.col("status").eqNullSafe("closed").alias("closed")).filter("at is not null")
    flips = (heads.withColumn("bucket", F.pmod(F.xxhash64("own"), F.lit(ORDER_BUCKETS)).cast("int")).groupBy("bucket")
             .transformWithStateInPandas(_Flips(), "own string, sign bigint", "append", "none"))
    lines = items.select(own, "product_id", F.coalesce(F.col("quantity").cast("long"), F.lit(0).cast("long")).alias("quantity"))
    return lines.join(flips, "own").select("product_id", (F.col("quantity") * F.col("sign")).alias("quantity"), F.col("sign").alias("lines"))


def totals_sink(root: str, key: str = "product_id", compact: int = 100):
    """``foreachBatch`` function that publishes a batch's changed totals as version ``<batch_id>``; only changed keys are written.

    Every ``compact`` versions the totals so far are written out, so that readers add up fewer folders than that.
    """
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, f"{batch_id:012d}"
        if not files.is_published(spark, root, version):
            sums = [F.sum(c).alias(c) for c in batch.columns if c != key]
            files.write_snapshot(batch.groupBy(key).agg(*sums), root, version=version)
        if batch_id % compact == compact - 1 and not files.is_published(spark, f"{root}/totals", version):
            files.write_snapshot(read_totals(spark, root, key), f"{root}/totals", version=version)
    return fn


def read_totals(spark: SparkSession, root: str, key: str = "product_id") -> DataFrame:
    """The sums of all published changes by ``key``; keys without ``lines`` left have none."""
    base = files.published_folders(spark, f"{root}/totals")
    since = base[-1].rsplit("v=", 1)[1] if base else ""
    every = spark.read.parquet(*base[-1:], *files.published_folders(spark, root, after=since))
    return every.groupBy(key).agg(*[F.sum(c).alias(c) for c in every.columns if c != key]).filter(F.col("lines") > 0)


def run_to_end(df: DataFrame, sink, checkpoint: str, mode: str = "append", path: str | None = None) -> None:
    """Run a streaming DataFrame over everything available, then stop.

    ``sink`` is a ``foreachBatch`` function or the string ``"parquet"`` (then
    ``path`` is the output folder).
    """
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)     # a query takes its settings when it starts
    try:
        q = w.format("parquet").option("path", path).start() if sink == "parquet" else w.foreachBatch(sink).start()
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)
    _run(q)
