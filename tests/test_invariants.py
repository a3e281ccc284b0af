"""Invariants of SURVEY 5.4 on the fixture tables (sf0.001)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder.fixtures import CHANGE_EVERY, Views, unmatched
from larder.operators import history, merge, orders, sales, stock


def _batch(v):
    changed = v.menu.filter(F.col("product_id") % CHANGE_EVERY == 0).withColumn("price", F.col("price") + 1)
    return changed.unionByName(changed.withColumn("product_id", unmatched("product_id")))


def test_merge_counts_and_partition_of_batch(spark, sf):
    v = Views(spark, sf)
    b = _batch(v)
    snap, acc, rej = merge.merge_insert(v.menu, b, "product_id", F.col("price") > 0)
    n_base, n_acc, n_rej, n_b = v.menu.count(), acc.count(), rej.count(), b.count()
    assert snap.count() == n_base + n_acc
    assert n_acc + n_rej == n_b                                   # every batch row: accepted or rejected
    assert acc.join(rej, "product_id", "left_semi").count() == 0  # never both
    snap, rej = merge.merge_delete(v.menu, b.select("product_id"), "product_id")
    deleted = v.menu.join(b.select("product_id"), "product_id", "left_semi").count()
    assert snap.count() == n_base - deleted and rej.count() == n_b - deleted


def test_latest_change_wins_with_order_col(spark):
    base = spark.createDataFrame([(1, "a")], "id long, name string")
    batch = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "id long, name string, seq int")
    snap, rej = merge.merge_replace(base, batch, "id", order_col="seq")
    assert [r.name for r in snap.collect()] == ["y"] and rej.count() == 0
    snap, rej = merge.merge_replace(base, batch.drop("seq"), "id")
    assert [r.name for r in snap.collect()] == ["a"] and rej.count() == 2


def test_one_open_price_row_per_item(spark, sf):
    v = Views(spark, sf)
    h = history.price_history(v.price)
    assert h.filter(F.col("effective_to").isNull()).groupBy("menu_item_id").count().filter("count > 1").count() == 0
    merged = history.price_history_merge(h, v.menu.select(F.col("product_id").alias("menu_item_id"), "price"),
                                         F.lit("2002-01-01").cast("timestamp_ntz"))
    opens = merged.filter(F.col("effective_to").isNull()).groupBy("menu_item_id").count()
    assert opens.filter("count > 1").count() == 0
    assert opens.count() == v.menu.count()                       # every menu item has exactly one open price
    # intervals of an item never overlap: each ends where the next begins
    assert merged.filter(F.col("effective_to") <= F.col("effective_from")).count() == 0


def test_admission_partitions_input_and_conserves_stock(spark, sf):
    v = Views(spark, sf)
    req = v.orders_named.withColumn("status", F.lit(None).cast("string"))
    res = orders.place_orders(req, v.items, v.menu_holes, v.bom, v.stock_low)
    acc, rej = res["accepted"].select("order_id"), res["rejects"].select("order_id")
    assert acc.count() + rej.count() == req.count()
    assert acc.join(rej, "order_id", "left_semi").count() == 0
    used = stock.ingredient_usage(stock.ingredient_demand(v.items.join(acc, "order_id", "left_semi"), v.bom))
    check = (v.stock_low.join(used, "ingredient_id", "left").join(
        res["stock"].select("ingredient_id", F.col("quantity").alias("after")), "ingredient_id"))
    bad = check.filter(F.col("quantity") - F.coalesce("usage", F.lit(0)) != F.col("after"))
    assert bad.count() == 0
    assert res["stock"].filter(F.col("quantity") < 0).count() == 0
    assert {r.reason for r in res["rejects"].collect()} == {"unknown_item", "not_enough"}


def test_strict_total_sales_raises_on_missing_product(spark, sf):
    v = Views(spark, sf)
    assert sales.total_sales(v.orders, v.items_plain, v.menu, strict=True).first().total_sales > 0
    with pytest.raises(ValueError, match="menu item not found"):
        sales.total_sales(v.orders, v.items_plain, v.menu_holes, strict=True)
    assert sales.total_sales(v.orders, v.items_plain, v.menu_holes).first().total_sales > Decimal(0)
