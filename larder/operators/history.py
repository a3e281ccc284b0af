"""Change tracking: stock ledger, status history, price history.

These are the batch forms of the reference's change triggers.  Every ordered
scan runs through ``larder.functions.scan``: windows per (key, bucket) plus a
small per-bucket summary, so a key holding a third of all rows is spread over
many tasks.  Orderings are total: (ts, tie-breaker id), NULL first.
``target_rows`` sets how many rows a bucket holds; by default a shuffle
partition's share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import scan
from larder.functions.joins import meet
from larder.functions.scan import BUCKET
from larder.functions.scalar import distinct_from, epoch_micros, history_id, to_int_column
from larder.session import materialize

# ---- W2 / W2b ---------------------------------------------------------------
def stock_ledger(tx: DataFrame, opening: Column | None = None, key: str = "inventory_id",
                 ts: str = "ts", seq: str = "event_id", target_rows: int | None = None) -> DataFrame:
    """Running balance after every transaction.

    ``increment`` adds, ``decrement`` subtracts, ``adjustment`` replaces the
    balance; an unknown type makes the balance NULL until the next
    adjustment (the SQL CASE yields NULL).  ``opening`` is the balance
    before a key's first transaction (default 0).
    """
    opening = opening if opening is not None else F.lit(0)
    t = F.col("transaction_type")
    kind = F.when(t == "adjustment", F.lit("set")).when(t.isin("increment", "decrement"), F.lit("add"))
    val = F.when(t == "decrement", -F.col("quantity")).otherwise(F.col("quantity"))
    df = scan.ordered(tx.withColumn("_kind", kind).withColumn("_val", val), [key], [ts, seq], target_rows)
    dtype = df.schema["_val"].dataType
    out = scan.set_add_fold(df, [key], [ts, seq], "_kind", "_val", opening.cast(dtype), "balance")
    return out.drop("_kind", "_val", BUCKET)


def stock_balance(tx: DataFrame, opening: Column | None = None, key: str = "inventory_id",
                  ts: str = "ts", seq: str = "event_id", target_rows: int | None = None) -> DataFrame:
    """Only the final balance per key: no window, no sort of the rows.

    One aggregate finds each key's last adjustment, a second sums up what
    came after it; both combine before their exchange. Between them a hot key
    meets its adjustment by broadcast (``meet``; keys of over ``target_rows`` rows).
    """
    opening = opening if opening is not None else F.lit(0)
    t = F.col("transaction_type")
    dtype = tx.schema["quantity"].dataType
    is_set, known = F.coalesce(t == "adjustment", F.lit(False)), t.isin("increment", "decrement")
    val = F.when(known, F.when(t == "decrement", -F.col("quantity")).otherwise(F.col("quantity")))
    row = F.struct(F.col(ts).alias("t"), F.col(seq).alias("s"))
    last = materialize(tx.groupBy(key).agg(
        F.max(F.when(is_set, F.struct(row.alias("at"), F.col("quantity").alias("base")))).alias("_last"), F.count(F.lit(1)).alias("_n")), "balance")
    met = meet(tx.select(key, is_set.alias("_set"), val.alias("_val"), row.alias("_row")), last, [key], "_n", target_rows)
    later = ~F.col("_set") & (F.col("_last").isNull() | (F.col("_row") > F.col("_last.at")))
    ends = met.groupBy(key).agg(
        F.first("_last").alias("_last"), F.sum(F.when(later, F.col("_val"))).alias("_after"),
        F.max(later & F.col("_val").isNull()).alias("_bad"))
    base = F.when(F.col("_last").isNull(), opening.cast("decimal(38,6)")).otherwise(F.col("_last.base").cast("decimal(38,6)"))
    end = base + F.coalesce("_after", F.lit(0)).cast("decimal(38,6)")
    return ends.select(key, F.when(F.col("_bad"), F.lit(None)).otherwise(end).cast(f"decimal(38,{getattr(dtype, 'scale', 6)})").alias("balance"))


def stock_balance_int(tx: DataFrame, opening: Column | None = None, key: str = "inventory_id") -> DataFrame:
    """W2b stored into the schema's INT quantity column: round half away from zero.

    The balance itself stays exact (decimal) and is rounded once when
    stored.  The database function would round at every update; that
    per-step rounding is not reproduced (SURVEY 2.14 #11: decimal stock).
    """
    return stock_balance(tx, opening, key).select(key, to_int_column("balance").alias("quantity"))


# ---- W3 ---------------------------------------------------------------------
def status_history(changes: DataFrame, key: str = "order_id", ts: str = "ts", seq: str = "event_id",
                   target_rows: int | None = None) -> DataFrame:
    """A history row on a key's first row and whenever status IS DISTINCT FROM the previous.

    The first row is found by position, not by a NULL previous status, so a
    NULL status after a real one is still a change.
    Columns: id, order_id, status, created_at.
    """
    df = scan.ordered(changes.select(key, ts, seq, "status"), [key], [ts, seq], target_rows)
    prev = scan.previous_value(df, [key], [ts, seq], "status", "_prev")
    hit = prev.filter(F.col("_first") | distinct_from("status", "_prev"))
    return hit.select(history_id(key, ts, seq).alias("id"), key, "status", F.col(ts).alias("created_at"))


# ---- W4 / W4b ----------------------------------------------------------------
def price_history(prices: DataFrame, key: str = "menu_item_id", ts: str = "ts",
                  target_rows: int | None = None) -> DataFrame:
    """Slowly changing dimension (type 2) from a stream of price observations.

    A new interval opens on a key's first row and on every real change
    (IS DISTINCT FROM); each interval ends where the next one starts, the
    open one has ``effective_to`` NULL.  ``ts`` must be unique per key.
    Columns: id, menu_item_id, price, effective_from, effective_to.
    """
    df = scan.ordered(prices.select(key, ts, "price"), [key], [ts], target_rows)
    prev = scan.previous_value(df, [key], [ts], "price", "_prev")
    opened = prev.filter(F.col("_first") | distinct_from("price", "_prev")).drop("_prev", "_first")
    closed = scan.next_value(opened, [key], [ts], ts, "effective_to")
    return closed.select(history_id(key, ts, F.lit(0)).alias("id"), key, "price",
                         F.col(ts).alias("effective_from"), "effective_to")


def price_history_merge(history: DataFrame, snapshot: DataFrame, at: Column,
                        key: str = "menu_item_id") -> DataFrame:
    """Apply a new price snapshot ``(key, price)`` at time ``at``.

    Open rows whose price changed are closed at ``at`` and a new open row
    starts; keys without an open row get one; unchanged and absent keys keep
    their rows.  Closed rows pass through untouched.
    """
    is_open = F.col("effective_to").isNull()
    closed = history.filter(~is_open)
    opened = history.filter(is_open)
    snap = snapshot.select(key, F.col("price").alias("_np"), F.lit(True).alias("_in"))
    j = opened.join(snap, key, "full")
    changed = F.col("id").isNotNull() & F.col("_in").isNotNull() & distinct_from("price", "_np")
    new_row = F.col("_in").isNotNull() & (F.col("id").isNull() | distinct_from("price", "_np"))
    kept = (j.filter(F.col("id").isNotNull())
            .select("id", key, "price", "effective_from",
                    F.when(changed, at).otherwise(F.col("effective_to")).alias("effective_to")))
    fresh = (j.filter(new_row)
             .select(history_id(key, at, F.lit(0)).alias("id"), key, F.col("_np").alias("price"),
                     at.alias("effective_from"), F.lit(None).cast(history.schema["effective_to"].dataType)
                     .alias("effective_to")))
    return closed.unionByName(kept).unionByName(fresh)


# ---- W5 ---------------------------------------------------------------------
#: Most levels of time cells, and the base cells that the events' span has at least.
_LEVELS, _LEAST_CELLS = 24, 64
_FOREVER = (1 << 62)


def _cover(first: Column, end: Column, levels: int) -> Column:
    """The dyadic cells (level, number) that make up the base cells from ``first`` to before ``end``: two a level at most."""
    kind = "array<struct<v:int,c:bigint>>"

    def step(s: Column, v: Column) -> Column:
        open_ = s["l"] < s["r"]
        left, right = open_ & (s["l"] % 2 == 1), open_ & (s["r"] % 2 == 1)

        def one(ok: Column, c: Column) -> Column:
            return F.when(ok, F.array(F.struct(v.cast("int").alias("v"), c.alias("c")))).otherwise(F.array().cast(kind))

        return F.struct(F.shiftright(s["l"] + left.cast("long"), 1).alias("l"), F.shiftright(s["r"] - right.cast("long"), 1).alias("r"),
                        F.concat(s["c"], one(left, s["l"]), one(right, s["r"] - 1)).alias("c"))

    start = F.struct(first.cast("long").alias("l"), end.cast("long").alias("r"), F.array().cast(kind).alias("c"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step)["c"]


def _cell_width(intervals: DataFrame, span: int, rows: int, target_rows: int | None) -> int:
    """Power of two of microseconds: the base cell. A short interval's length, or so that a cell of evenly spread events has ``target_rows``."""
    if target_rows:
        width = span * target_rows // max(rows, 1)
    else:
        length = F.least(F.col("_e"), F.lit(_FOREVER)) - F.col("_f")
        width = intervals.filter(F.col("_e") < _FOREVER).agg(F.percentile_approx(length, 0.1)).first()[0] or span
    width = max(min(width, span // _LEAST_CELLS), span >> _LEVELS, 1)
    return width.bit_length() - 1


def interval_matches(points: DataFrame, intervals: DataFrame, key: str, at: str, target_rows: int | None = None) -> DataFrame:
    """Pairs of ``points(key, at)`` and ``intervals(key, _f, _e, ...)`` with ``_f <= at < _e``; times in microseconds, keys compared with NULL equal.

    Every interval is cut into the dyadic cells of time that make it up (at most two of each level, so the
    logarithm of its length), every point lies in one cell of each level in use, and the two meet by
    (key, level, cell). The cells at an interval's ends may reach over them, so the times are compared as well. No key meets whole: a hot one
    spreads over its cells, and a point meets only intervals that hold it or end inside its base cell.
    """
    ends = points.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    low, high = ends[0] or 0, ends[1] or 0
    near = intervals.filter((F.col("_f") < F.col("_e")) & (F.col("_e") > low) & (F.col("_f") <= high))
    shift = _cell_width(near, high - low + 1, ends[2], target_rows)
    top = (high - low) >> shift

    def cell(t: Column) -> Column:
        return F.shiftright(t - low, shift)

    first = F.greatest(cell(F.col("_f")), F.lit(0).cast("long"))
    end = F.least(cell(F.col("_e") - 1), F.lit(top).cast("long")) + 1
    cells = near.withColumn("_c", F.explode(_cover(first, end, max(top, 1).bit_length())))
    cells = cells.select(*[F.col(c).alias("_ik") if c == key else F.col(c) for c in near.columns], F.col("_c.v").alias("_iv"), F.col("_c.c").alias("_ic"))
    used = sorted(r[0] for r in cells.select("_iv").distinct().collect())   # levels: a few dozen at most
    if not used:
        used = [0]
    own = F.array(*[F.struct(F.lit(v).alias("v"), F.shiftright(cell(F.col(at)), v).alias("c")) for v in used])
    asked = points.withColumn("_c", F.explode(own)).select(*points.columns, F.col("_c.v").alias("_v"), F.col("_c.c").alias("_cc"))
    met = asked.join(cells, F.col(key).eqNullSafe(F.col("_ik")) & (F.col("_v") == F.col("_iv")) & (F.col("_cc") == F.col("_ic")))
    return met.filter((F.col("_f") <= F.col(at)) & (F.col(at) < F.col("_e"))).drop("_v", "_cc", "_iv", "_ic", "_ik")


def last_started(points: DataFrame, spans: DataFrame, target_rows: int | None = None) -> DataFrame:
    """``_k, _t, _p, _earlier`` for the ``points(_k, _t)`` that an interval of ``spans(_k, _f, _e, _p)`` may hold.

    One ordered scan over both gives each point the interval that started last up to it, which counts if it holds the
    point. If it has ended but one that started earlier has not, ``_earlier`` is true and ``_p`` NULL.
    """
    span = F.struct("_f", "_e", "_p").alias("_b")
    # at one time intervals come first: they hold their start
    starts = spans.filter(F.col("_f") < F.col("_e")).select("_k", F.col("_f").alias("_t"), F.lit(0).alias("_s"), span, F.col("_e").alias("_u"))
    both = starts.unionByName(points.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    df = scan.ordered(materialize(both, "as-of"), ["_k"], ["_t", "_s"], target_rows)
    run = scan.running_max(df, ["_k"], ["_t", "_s"], {"_last": "_b", "_until": "_u"}).filter((F.col("_s") == 1) & (F.col("_until") > F.col("_t")))
    earlier = F.col("_last._e") <= F.col("_t")
    return run.select("_k", "_t", F.when(~earlier, F.col("_last._p")).alias("_p"), earlier.alias("_earlier"))


def price_as_of(events: DataFrame, intervals: DataFrame, at: str = "created_at",
                key: str = "product_id", hist_key: str = "menu_item_id",
                target_rows: int | None = None) -> DataFrame:
    """The price in force at each event's time (half-open [from, to) intervals).

    Intervals may overlap and leave gaps: of those that hold the time, the one that
    started last counts; of these the one that ends last (open ends after all), then the higher price.
    Events in no interval, or without a time, get NULL. An interval without a
    start is never in force. NULL keys match NULL keys; equal (key, time) pairs are
    looked up once. ``intervals`` is meant to be the stored history table (as in the schema), not a plan that derives it.

    The interval that started last is found by a scan; only times at which it has ended and an earlier one has not
    are looked up in all intervals (``interval_matches``).
    """
    time = epoch_micros(at)
    points = events.select(F.col(key).alias("_k"), time.alias("_t")).where("_t is not null").distinct()
    spans = materialize(intervals.select(F.col(hist_key).alias("_k"), epoch_micros("effective_from").alias("_f"),
                                         F.coalesce(epoch_micros("effective_to"), F.lit(_FOREVER)).alias("_e"), F.col("price").alias("_p")), "as-of")
    found = materialize(last_started(points, spans, target_rows), "as-of")
    best, open_ = found.filter("not _earlier").select("_k", "_t", "_p"), found.filter("_earlier").select("_k", "_t")
    if not open_.isEmpty():
        met = interval_matches(open_, spans, "_k", "_t", target_rows)
        best = best.unionByName(met.groupBy("_k", "_t").agg(F.max(F.struct("_f", "_e", "_p")).alias("_b")).select("_k", "_t", F.col("_b._p").alias("_p")))
    joined = events.join(best, events[key].eqNullSafe(best["_k"]) & (epoch_micros(events[at]) == best["_t"]), "left")
    return joined.select(*[events[c] for c in events.columns], best["_p"].alias("price"))


# ---- W6 ---------------------------------------------------------------------
def status_change_snapshot(old: DataFrame, new: DataFrame, key: str = "order_id",
                           col: str = "status") -> DataFrame:
    """Rows of ``new`` that are inserts or whose ``col`` IS DISTINCT FROM ``old``.

    Columns: key, old_<col>, <col>, change ('insert' | 'update').
    Deletions emit nothing (the trigger fires on INSERT and UPDATE only).
    """
    o = old.select(key, F.col(col).alias(f"old_{col}"), F.lit(True).alias("_o"))
    j = new.select(key, col).join(o, key, "left")
    hit = F.col("_o").isNull() | distinct_from(col, f"old_{col}")
    return (j.filter(hit)
            .select(key, f"old_{col}", col,
                    F.when(F.col("_o").isNull(), F.lit("insert")).otherwise(F.lit("update")).alias("change")))
