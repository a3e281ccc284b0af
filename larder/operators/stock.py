"""Bill of materials, demand and stock checks.

Shapes:
  items(order_id, pos, product_id, quantity)
  bom(menu_item_id, inventory_id, quantity, pos)    - ingredients of a menu item
  stock(ingredient_id, quantity, ...)
Demand of a line for an ingredient = bom.quantity * item.quantity (decimal).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _bom_side(bom: DataFrame) -> DataFrame:
    return bom.select(F.col("menu_item_id").alias("product_id"),
                      F.col("inventory_id").alias("ingredient_id"),
                      F.col("quantity").alias("unit_qty"),
                      F.col("pos").alias("ingredient_pos"))


def ingredient_demand(items: DataFrame, bom: DataFrame) -> DataFrame:
    """One row per (order line, ingredient) with ``demand``.

    Shuffle join on product id; a hot product is split by AQE's skew-join
    handling.  Columns: order_id, [pos,] product_id, ingredient_pos,
    ingredient_id, demand.
    """
    keep = [c for c in ("order_id", "pos", "product_id") if c in items.columns]
    return (items.join(_bom_side(bom), "product_id")
            .select(*keep, "ingredient_pos", "ingredient_id",
                    (F.col("unit_qty") * F.col("quantity")).alias("demand")))


def missing_ingredients(bom: DataFrame, stock: DataFrame) -> DataFrame:
    """BOM rows whose ingredient is absent from the stock."""
    return bom.join(stock.select(F.col("ingredient_id").alias("inventory_id")), "inventory_id", "left_anti")


def line_shortages(demand: DataFrame, stock: DataFrame) -> DataFrame:
    """Lines whose demand alone exceeds the whole stock (equality is allowed)."""
    s = stock.select("ingredient_id", F.col("quantity").alias("stock"))
    return demand.join(s, "ingredient_id").filter(F.col("demand") > F.col("stock"))


def order_check(items: DataFrame, menu: DataFrame, bom: DataFrame, stock: DataFrame) -> DataFrame:
    """The *first* problem of each order, in item then ingredient order.

    Problems: ``unknown_item`` (product not on the menu, ingredient position
    0), ``unknown_ingredient``, ``not_enough`` (line demand above stock).
    One row per order that has a problem; the earliest is picked with a
    ``min`` over a (pos, ingredient_pos, ...) struct - a plain aggregate, so
    it combines map-side and a huge order does not sit in one task.
    """
    m = menu.select("product_id")
    unknown_item = (items.join(m, "product_id", "left_anti")
                    .select("order_id", "pos", F.lit(0).alias("ingredient_pos"),
                            F.lit("unknown_item").alias("reason"), "product_id",
                            F.lit(None).cast("long").alias("ingredient_id")))
    d = ingredient_demand(items.join(m, "product_id", "left_semi"), bom)
    s = stock.select("ingredient_id", F.col("quantity").alias("_stock"), F.lit(True).alias("_known"))
    reason = (F.when(F.col("_known").isNull(), F.lit("unknown_ingredient"))
              .when(F.col("demand") > F.col("_stock"), F.lit("not_enough")))
    ingr = (d.join(s, "ingredient_id", "left")
            .select("order_id", "pos", "ingredient_pos", reason.alias("reason"), "product_id", "ingredient_id")
            .filter(F.col("reason").isNotNull()))
    first = (unknown_item.unionByName(ingr)
             .groupBy("order_id")
             .agg(F.min(F.struct("pos", "ingredient_pos", "reason", "product_id", "ingredient_id")).alias("_p")))
    return first.select("order_id", "_p.*")


def order_cumulative_shortage(demand: DataFrame, stock: DataFrame) -> DataFrame:
    """Lines of one order draw the same stock one after another.

    Running demand per (order, ingredient) in (pos, ingredient_pos) order;
    a line is short when the running total exceeds the stock snapshot;
    ``is_first`` marks the order's first short line, where the reference stops.
    The window is partitioned by (order, ingredient): its size is bounded by
    one order document, not by the data.
    """
    w = (Window.partitionBy("order_id", "ingredient_id").orderBy("pos", "ingredient_pos")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = stock.select("ingredient_id", F.col("quantity").alias("stock"))
    return (demand.join(s, "ingredient_id")
            .withColumn("cum_demand", F.sum("demand").over(w))
            .filter(F.col("cum_demand") > F.col("stock"))
            .withColumn("is_first", F.row_number().over(Window.partitionBy("order_id").orderBy("pos", "ingredient_pos")) == 1))


def ingredient_usage(demand: DataFrame) -> DataFrame:
    """A4: total demand per ingredient (partial + final aggregate)."""
    return demand.groupBy("ingredient_id").agg(F.sum("demand").alias("usage"))


def apply_usage(stock: DataFrame, usage: DataFrame, subtract: bool = True,
                atomic: bool = False) -> DataFrame:
    """M8: stock -/+ usage per ingredient.

    Full outer join of stock and usage on the ingredient.  ``reason`` is
    ``unknown_ingredient`` for usage without stock, ``not_enough`` when a
    subtraction would go below zero, else NULL.  Rejected ingredients keep
    their quantity.  With ``atomic=True`` any reject leaves *every* quantity
    unchanged (one scalar subquery decides; no single-partition window).
    Columns: ingredient_id, quantity_before, usage, quantity, reason.
    """
    u = usage.select("ingredient_id", F.col("usage"), F.lit(True).alias("_u"))
    s = stock.select("ingredient_id", F.col("quantity").alias("quantity_before"), F.lit(True).alias("_s"))
    j = s.join(u, "ingredient_id", "full")
    use = F.coalesce(F.col("usage"), F.lit(0))
    after = (F.col("quantity_before") - use) if subtract else (F.col("quantity_before") + use)
    reason = (F.when(F.col("_s").isNull(), F.lit("unknown_ingredient"))
              .when(F.lit(subtract) & (after < 0), F.lit("not_enough")))
    out = j.select("ingredient_id", "quantity_before", use.alias("usage"), after.alias("_after"),
                   reason.alias("reason"))
    if atomic:
        n_bad = out.filter(F.col("reason").isNotNull()).select(F.count(F.lit(1))).scalar()
        ok = n_bad == 0
    else:
        ok = F.col("reason").isNull()
    return out.select("ingredient_id", "quantity_before", "usage",
                      F.when(ok & F.col("reason").isNull(), F.col("_after"))
                      .otherwise(F.col("quantity_before")).alias("quantity"),
                      "reason")
