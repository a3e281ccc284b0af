"""Sales and popularity reports.

Inputs use the reference's shapes:
  orders(order_id, status, ...)      items(order_id, product_id, quantity[, pos])
  menu(product_id, price, ...)

Money is decimal; sums stay decimal (exact, associative, so partial
aggregation on 1000 executors gives the same answer as one) and are cast to
double only at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sales_orders(orders: DataFrame) -> DataFrame:
    """P3, sales rule: every order whose status is not ``open`` (NULL counts as not open)."""
    return orders.filter(~F.col("status").eqNullSafe("open"))


def closed_orders(orders: DataFrame) -> DataFrame:
    """P3, popularity rule: only ``closed`` orders (a different rule from sales)."""
    return orders.filter(F.col("status") == "closed")


def priced_items(items: DataFrame, menu: DataFrame) -> DataFrame:
    """Order lines joined to the menu price; ``line_total = quantity * price``.

    Plain equi-join: Catalyst plans a shuffle (sort-merge) join, and AQE turns
    it into a broadcast join at runtime when the menu side is measured small.
    """
    m = menu.select("product_id", "price")
    return (items.join(m, "product_id")
            .withColumn("line_total", F.col("quantity") * F.col("price")))


def missing_menu_items(items: DataFrame, menu: DataFrame) -> DataFrame:
    """Order lines whose product is not on the menu (a report, not an error)."""
    return items.join(menu.select("product_id"), "product_id", "left_anti")


def total_sales(orders: DataFrame, items: DataFrame, menu: DataFrame, strict: bool = False) -> DataFrame:
    """A1: sum(quantity * price) over lines of non-open orders; 0 when nothing matches.

    One row, column ``total_sales``.  Lines whose product is missing from the
    menu are left out here and reported by ``missing_menu_items``; with
    ``strict=True`` such a line fails the report instead (as the reference
    does), naming one offending order.  The check is one small job.
    """
    sold = items.join(sales_orders(orders).select("order_id"), "order_id", "left_semi")
    if strict:
        bad = missing_menu_items(sold, menu).select("order_id").limit(1).collect()
        if bad:
            raise ValueError(f"menu item not found: order {bad[0]['order_id']}")
    lines = priced_items(sold, menu)
    return lines.agg(
        F.coalesce(F.sum("line_total"), F.lit(0).cast("decimal(38,2)")).cast("double").alias("total_sales"))


def total_sales_as_written(orders: DataFrame, items: DataFrame, menu: DataFrame) -> DataFrame:
    """A2: the literal nested-loop result: per order (sum of prices) x (sum of quantities), summed.

    Equal to ``total_sales`` only for one-line orders.  Two-level aggregate:
    per order, then global; both levels partial-aggregate before shuffling.
    """
    lines = priced_items(items.join(sales_orders(orders).select("order_id"), "order_id", "left_semi"), menu)
    per_order = lines.groupBy("order_id").agg(
        F.sum("price").alias("sum_price"), F.sum("quantity").alias("sum_qty"))
    return per_order.agg(
        F.coalesce(F.sum(F.col("sum_price") * F.col("sum_qty")), F.lit(0).cast("decimal(38,2)"))
        .cast("double").alias("total_sales"))


def popular_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """A3: total quantity per product over closed orders.

    No menu join: products missing from the menu still count.  Hot products
    are fine: the sum is partially aggregated on the map side.
    """
    lines = items.join(closed_orders(orders).select("order_id"), "order_id", "left_semi")
    return lines.groupBy("product_id").agg(F.sum("quantity").alias("quantity"))


def popular_top_n(popular: DataFrame, n: int | None = None) -> DataFrame:
    """Quantity descending, ties broken by product id ascending, optional top ``n``.

    With ``n`` Spark plans TakeOrderedAndProject (per-partition top-n, then a
    merge of n rows per partition), never a full sort.
    """
    ordered = popular.orderBy(F.col("quantity").desc(), F.col("product_id").asc())
    return ordered.limit(n) if n is not None else ordered


def order_total_check(orders: DataFrame, items: DataFrame) -> DataFrame:
    """A5: stated ``total_amount`` against sum(quantity * unit_price) of the order's lines.

    ``unit_price`` is the line's own, as agreed when it was ordered, not the
    menu's present one.  Orders without priced lines get ``items_total = 0``.
    """
    per_order = items.groupBy("order_id").agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("items_total"))
    zero = F.lit(0).cast("decimal(38,2)")
    return (orders.select("order_id", "total_amount")
            .join(per_order, "order_id", "left")
            .select("order_id",
                    F.col("total_amount").cast("double").alias("total_amount"),
                    F.coalesce("items_total", zero).cast("double").alias("items_total"),
                    (F.col("total_amount") - F.coalesce("items_total", zero)).cast("double").alias("difference")))
