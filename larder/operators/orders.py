"""Order lifecycle in batch form.

Each call takes the current snapshots and a batch of requests and returns the
new snapshots plus ``rejects(order_id, reason)``.  Requests are decided
atomically per order; admission against stock is in arrival order
(``larder.plans.admission``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.scalar import blank, non_positive
from larder.operators import merge, nested, stock as stock_ops
from larder.plans.admission import admit_in_order
from larder.session import materialize


def _reject(df: DataFrame, reason: str) -> DataFrame:
    return df.select("order_id", F.lit(reason).alias("reason"))


def _kept(df: DataFrame, *tag: str) -> DataFrame:
    """``df`` stored, so that the steps after it do not plan and run it again, all in one stage; columns without a type stay NULL."""
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    stored = materialize(df.drop(*void), *tag)
    return stored.select(*[F.lit(None).alias(c) if c in void else F.col(c) for c in df.columns])


def invalid_requests(orders: DataFrame, items: DataFrame) -> DataFrame:
    """V2 on relational requests: closed status, empty customer, any bad item -> order ids."""
    head = orders.filter((F.col("status") == "closed") | blank("customer_name")).select("order_id")
    bad_item = items.filter(blank("product_id") | non_positive("quantity")).select("order_id")
    return head.unionByName(bad_item).distinct()


def unknown_references(items: DataFrame, menu: DataFrame, bom: DataFrame, stock: DataFrame) -> DataFrame:
    """Orders naming a product off the menu or an ingredient not in stock -> (order_id, reason).

    One reason per order: its first problem in item, then ingredient order
    (``pos``; items without positions count as one place).
    """
    at = F.col("pos") if "pos" in items.columns else F.lit(0)
    known = menu.select("product_id")
    unknown_item = (items.join(known, "product_id", "left_anti")
                    .select("order_id", at.alias("pos"), F.lit(0).alias("ingredient_pos"), F.lit("unknown_item").alias("reason")))
    d = stock_ops.ingredient_demand(items.join(known, "product_id", "left_semi"), bom)
    unknown_ingr = (d.join(stock.select("ingredient_id"), "ingredient_id", "left_anti")
                    .select("order_id", at.alias("pos"), "ingredient_pos", F.lit("unknown_ingredient").alias("reason")))
    first = (unknown_item.unionByName(unknown_ingr).groupBy("order_id")
             .agg(F.min(F.struct("pos", "ingredient_pos", "reason")).alias("p")))
    return first.select("order_id", F.col("p.reason").alias("reason"))


def place_orders(orders: DataFrame, items: DataFrame, menu: DataFrame, bom: DataFrame, stock: DataFrame,
                 arrival: tuple[str, str] = ("created_at", "order_id"), after: Column | None = None) -> dict:
    """M4: validate, check references, admit against stock in arrival order, deduct.

    orders: (order_id, customer_name, status, created_at)   one row per request
    items:  (order_id, pos, product_id, quantity)
    Accepted orders get status ``open``, their arrival as ``created_at`` and,
    with ``after`` (the largest id in use), dense new ids in arrival order as
    ``new_id`` (``order_id`` stays the request's key).  Rejected ones appear
    only in ``rejects`` (atomic per order - nothing of a rejected order is
    saved): every copy of a repeated request (``duplicate_in_batch``),
    ``invalid`` (V2, or no arrival), unknown references, ``not_enough``.
    Returns dict(accepted, rejects, stock, rounds).
    """
    single, repeated = merge.one_change_per_key(orders, "order_id")
    single = _kept(single, "place", "single")
    single_items = _kept(items.join(single.select("order_id"), "order_id", "left_semi"), "place", "items")
    late = single.filter(F.col(arrival[0]).isNull()).select("order_id")
    invalid = _kept(invalid_requests(single, single_items).unionByName(late).distinct(), "place", "invalid")
    valid_orders = single.join(invalid, "order_id", "left_anti")
    valid_items = single_items.join(valid_orders.select("order_id"), "order_id", "left_semi")
    unknown = _kept(unknown_references(valid_items, menu, bom, stock), "place", "unknown")
    cand = valid_orders.join(unknown.select("order_id"), "order_id", "left_anti")
    cand_items = valid_items.join(unknown.select("order_id"), "order_id", "left_anti")
    demand = stock_ops.ingredient_demand(cand_items, bom)
    arr = cand.select("order_id", F.col(arrival[0]).alias("arrival_ts"), F.col(arrival[1]).alias("arrival_seq"))
    decisions, left, rounds = admit_in_order(demand, arr, stock)
    accepted = (cand.join(decisions.filter("accepted").select("order_id"), "order_id", "left_semi")
                .withColumns({"status": F.lit("open"), "created_at": F.col(arrival[0])}))
    if after is not None:
        accepted = assign_ids(accepted, list(dict.fromkeys(arrival)), after)
    rejects = (repeated.unionByName(_reject(invalid, "invalid")).unionByName(unknown)
               .unionByName(_reject(decisions.filter(~F.col("accepted")), "not_enough")))
    return {"accepted": accepted, "rejects": rejects, "stock": left, "rounds": rounds}


def _found(ids: DataFrame, orders: DataFrame) -> DataFrame:
    """Distinct requested ids with ``_here`` (true if the order exists) and its status, which may be NULL."""
    known = orders.select("order_id", "status", F.lit(True).alias("_here"))
    return (ids.select("order_id").distinct().join(known, "order_id", "left")
            .withColumn("_here", F.coalesce("_here", F.lit(False))))


def _closed() -> Column:
    return F.coalesce(F.col("status") == "closed", F.lit(False))


def _not_there_or_closed(found: DataFrame) -> DataFrame:
    return found.filter(~F.col("_here") | _closed()).select(
        "order_id", F.when(~F.col("_here"), F.lit("not_found")).otherwise(F.lit("already_closed")).alias("reason"))


def close_orders(orders: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M7: any order that is not closed -> closed.  Unknown ids: ``not_found``; already closed: ``already_closed``."""
    found = _found(ids, orders)
    hit = found.filter(F.col("_here")).select("order_id", F.lit(True).alias("_hit"))
    snap = (orders.join(hit, "order_id", "left")
            .withColumn("status", F.when(F.col("_hit"), F.lit("closed")).otherwise(F.col("status")))
            .drop("_hit"))
    return snap, _not_there_or_closed(found)


def cancel_orders(orders: DataFrame, items: DataFrame, menu: DataFrame, bom: DataFrame, stock: DataFrame,
                  ids: DataFrame) -> dict:
    """M5: remove orders that are not closed and give their ingredients back.

    Rejected: unknown (``not_found``), closed (``already_closed``), or naming
    a product / ingredient that no longer exists (the give-back would fail).
    Returns dict(orders, items, stock, rejects).
    """
    found = _kept(_found(ids, orders), "cancel", "found")
    ok = found.filter(F.col("_here") & ~_closed()).select("order_id")
    ok_items = _kept(items.join(ok, "order_id", "left_semi"), "cancel", "items")
    r2 = _kept(unknown_references(ok_items, menu, bom, stock), "cancel", "unknown")
    done = ok.join(r2.select("order_id"), "order_id", "left_anti")
    back = stock_ops.ingredient_usage(stock_ops.ingredient_demand(ok_items.join(r2.select("order_id"), "order_id", "left_anti"), bom))
    new_stock = (stock.join(back, "ingredient_id", "left")
                 .withColumn("quantity", F.col("quantity") + F.coalesce(F.col("usage"), F.lit(0))).drop("usage"))
    return {"orders": orders.join(done, "order_id", "left_anti"),
            "items": items.join(done, "order_id", "left_anti"),
            "stock": new_stock,
            "rejects": _not_there_or_closed(found).unionByName(r2)}


def amend_orders(orders: DataFrame, items: DataFrame, requests: DataFrame, new_items: DataFrame,
                 menu: DataFrame, bom: DataFrame, stock: DataFrame,
                 arrival: tuple[str, str] = ("requested_at", "order_id")) -> dict:
    """M6: append items to open orders; only the *new* items are checked and deducted.

    requests:  (order_id, customer_name, status, requested_at)  the amendment documents
    new_items: (order_id, pos, product_id, quantity)            their items, 1-based pos
    Rejected: ``duplicate_in_batch``, ``not_found``, ``not_open`` (any status
    but ``open``), ``invalid`` (V2 on the request, or no arrival), unknown
    references, ``not_enough`` (admission of the new demand in arrival
    order).  Accepted items are appended after the order's existing lines
    (U1).  Returns dict(items, stock, accepted, rejects, rounds).
    """
    requests = _kept(requests, "amend", "requests")
    single, repeated = merge.one_change_per_key(requests, "order_id")
    current = orders.select("order_id", F.col("status").alias("_cur"), F.lit(True).alias("_here"))
    req = _kept(single.join(current, "order_id", "left").withColumn("_here", F.coalesce("_here", F.lit(False))), "amend", "found")
    is_open = F.coalesce(F.col("_cur") == "open", F.lit(False))
    refused = req.filter(~is_open).select(
        "order_id", F.when(~F.col("_here"), F.lit("not_found")).otherwise(F.lit("not_open")).alias("reason"))
    live = req.filter(is_open).drop("_cur", "_here")
    live_items = new_items.join(live.select("order_id"), "order_id", "left_semi")
    placed = place_orders(live, live_items, menu, bom, stock, arrival=arrival)
    acc = placed["accepted"].select("order_id")
    appended = nested.append_items(items, new_items.join(acc, "order_id", "left_semi"))
    return {"items": appended, "stock": placed["stock"], "accepted": acc,
            "rejects": repeated.unionByName(refused).unionByName(placed["rejects"]), "rounds": placed["rounds"]}


def assign_ids(df: DataFrame, order: list[str], after: Column, out: str = "new_id") -> DataFrame:
    """Dense ids ``after + 1, after + 2, ...`` in ``order`` (a total order), without a global window.

    Rows are range-partitioned and sorted on ``order``; the position inside a
    partition comes from ``monotonically_increasing_id`` (partition index in
    the upper bits, row number in the lower 33); per-partition row counts -
    one row per partition, a size bounded by the partition count - give each
    partition its offset.  The ranged data is written to the shared folder
    first so counts and ids see the same partitions.  ``after`` is usually a
    scalar subquery such as ``existing.select(max(id)).scalar()``; NULL (nothing
    exists yet) counts as 0.
    """
    from larder.session import materialize
    from pyspark.sql import Window

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_p", F.shiftright("_mid", 33)).withColumn(
        "_i", F.col("_mid") - F.shiftleft(F.col("_p"), 33))
    ranged = materialize(ranged, "assign_ids")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_p")
            .withColumn(out, F.coalesce(after, F.lit(0)) + F.col("_off") + F.col("_i") + 1)
            .drop("_mid", "_p", "_i", "_off"))
