"""Nested documents <-> relational rows.

Orders and menu items are documents with an array column in the reference.
``nest_*`` builds them from line rows (one ``groupBy`` on the document key);
``explode_*`` is the inverse.  A document is one row by definition, so the
array is bounded by the size of one document, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.scalar import utc_text


def _none(df: DataFrame, col: str) -> Column:
    """The empty array of the column's type."""
    return F.array().cast(df.schema[col].dataType)


def nest_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Order rows + item rows (with ``pos``) -> order documents.

    Orders without lines get an empty ``items`` array (valid in the reference).
    ``created_at`` is rendered in the reference's UTC text form.
    """
    packed = (items.groupBy("order_id")
              .agg(F.sort_array(F.collect_list(F.struct("pos", "product_id", "quantity"))).alias("_l")))
    item = lambda x: F.struct(x["product_id"].alias("product_id"), x["quantity"].alias("quantity"))
    cols = [c for c in ("order_id", "customer_name") if c in orders.columns]
    return (orders.join(packed, "order_id", "left")
            .select(*cols,
                    F.transform(F.coalesce("_l", _none(packed, "_l")), item).alias("items"),
                    "status",
                    utc_text("created_at").alias("created_at")))


def nest_menu(menu: DataFrame, bom: DataFrame) -> DataFrame:
    """Menu rows + bill-of-materials rows -> menu documents (ingredients in ``pos`` order)."""
    packed = (bom.groupBy(F.col("menu_item_id").alias("product_id"))
              .agg(F.sort_array(F.collect_list(F.struct("pos", "inventory_id", "quantity"))).alias("_l")))
    ingr = lambda x: F.struct(x["inventory_id"].alias("ingredient_id"), x["quantity"].alias("quantity"))
    return (menu.join(packed, "product_id", "left")
            .select("product_id", "name", "description", "price",
                    F.transform(F.coalesce("_l", _none(packed, "_l")), ingr).alias("ingredients")))


def explode_items(order_docs: DataFrame) -> DataFrame:
    """One row per item with its 1-based position; empty arrays give no rows."""
    return (order_docs.select("order_id", F.posexplode("items").alias("p", "it"))
            .select("order_id", (F.col("p") + 1).alias("pos"),
                    F.col("it.product_id").alias("product_id"), F.col("it.quantity").alias("quantity")))


def explode_ingredients(menu_docs: DataFrame) -> DataFrame:
    """P5: one row per menu ingredient with its 1-based position."""
    return (menu_docs.select("product_id", F.posexplode("ingredients").alias("p", "g"))
            .select("product_id", (F.col("p") + 1).alias("pos"),
                    F.col("g.ingredient_id").alias("ingredient_id"), F.col("g.quantity").alias("quantity")))


def append_items(items: DataFrame, new_items: DataFrame) -> DataFrame:
    """U1 (rows): new lines get positions after the order's last existing line.

    ``new_items(order_id, pos, product_id, quantity)`` carries its own 1-based
    order; it is shifted by the existing maximum position (an aggregate joined
    back on the order key, no window over the base).
    """
    last = items.groupBy("order_id").agg(F.max("pos").alias("_last"))
    shifted = (new_items.join(last, "order_id", "left")
               .withColumn("pos", F.col("pos") + F.coalesce("_last", F.lit(0)))
               .drop("_last"))
    return items.unionByName(shifted.select(*items.columns))
