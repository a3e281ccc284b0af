"""Sources and sinks: missing/empty inputs, the reference's JSON-array file, snapshot versions."""

import json
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.schemas import INVENTORY, inventory
from larder.session import scratch_path
from larder.sources import files


def test_missing_and_empty_json_give_empty_frames(spark):
    d = tempfile.mkdtemp(prefix="larder-test-json-")
    assert files.scan_menu_json(spark, os.path.join(d, "nope.json")).count() == 0
    empty = os.path.join(d, "empty.json")
    open(empty, "w").close()
    assert files.scan_orders_json(spark, empty, multiline=True).count() == 0


def test_reference_json_array_file(spark):
    d = tempfile.mkdtemp(prefix="larder-test-json-")
    menu = [{"product_id": "latte", "name": "latte", "description": "milk", "price": 3.5,
             "ingredients": [{"ingredient_id": "milk", "quantity": 0.2}, {"ingredient_id": "salt", "quantity": 0.004}]},
            {"product_id": "tea", "name": "tea", "description": "leaf", "price": 2.0}]
    path = os.path.join(d, "menu.json")
    with open(path, "w") as f:
        json.dump(menu, f, indent=2)
    got = {r.product_id: (r.price, r.ingredients) for r in files.scan_menu_json(spark, path, multiline=True).collect()}
    assert got["latte"][0] == Decimal("3.50") and [tuple(g) for g in got["latte"][1]] == [("milk", Decimal("0.200000")), ("salt", Decimal("0.004000"))]
    assert got["tea"][1] is None          # absent list -> NULL; validators treat it as empty


def test_broken_json_fails(spark):
    """A truncated file and a wrong type are errors, not NULL rows."""
    d = tempfile.mkdtemp(prefix="larder-test-json-")
    for name, data in (("cut.json", '[{"product_id": "latte", "name"'), ("kind.json", '[{"product_id": "a", "price": "much"}]')):
        path = os.path.join(d, name)
        with open(path, "w") as f:
            f.write(data)
        with pytest.raises(Exception, match="(?i)malformed|parse"):
            files.scan_menu_json(spark, path, multiline=True).collect()


def test_version_written_but_not_published_is_written_again(spark, monkeypatch):
    root = scratch_path(spark, "test", "crash")
    df = spark.createDataFrame([(1,)], "x int")
    with monkeypatch.context() as m:
        m.setattr(files, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            files.write_snapshot(df, root, version="7")
    assert files.current_version(spark, root) is None
    files.write_snapshot(df, root, version="7")
    assert files.read_snapshot(spark, root).count() == 1
    with pytest.raises(FileExistsError):
        files.write_snapshot(df, root, version="7")


def test_snapshot_versions_and_append(spark):
    root = scratch_path(spark, "test", "snap")
    base = spark.createDataFrame([(1, "a", Decimal("1"), "kg")], inventory(T.LongType()))
    files.write_snapshot(base, root)
    files.write_snapshot(base.withColumn("quantity", F.col("quantity") + 1), root)
    assert [r.quantity for r in files.read_snapshot(spark, root).collect()] == [Decimal("2.00")]
    rows = spark.createDataFrame([(1, "dup", Decimal("5"), "kg"), (2, "b", Decimal("3"), "l"),
                                  (3, "bad", Decimal("0"), "l")], inventory(T.LongType()))
    acc, rej = files.append_rows(rows, root)
    assert sorted(r.ingredient_id for r in files.read_snapshot(spark, root).collect()) == [1, 2]
    assert {r.ingredient_id: r.reason for r in rej.collect()} == {1: "exists", 3: "invalid"}
    files.append_rows(rows.withColumns({"ingredient_id": F.col("ingredient_id") + 10}), root)
    assert sorted(r.ingredient_id for r in files.read_snapshot(spark, root).collect()) == [1, 2, 11, 12]
    # nothing published yet -> empty with the given schema
    assert files.read_snapshot(spark, scratch_path(spark, "test", "none"), INVENTORY).count() == 0


def test_report_json_names(spark):
    df = spark.createDataFrame([(Decimal("12.50"),)], "total_sales decimal(38,2)")
    got = files.report_json(df, {"total_sales": "total_sales: "}).first().json
    assert got == '{"total_sales: ":12.50}'


def test_reference_orders_file_through_admission(spark):
    """Nested orders in the reference's JSON-array file -> rows -> validation -> admission."""
    from larder.operators import nested, orders

    d = tempfile.mkdtemp(prefix="larder-test-json-")
    docs = [
        {"order_id": "r1", "customer_name": "ann", "items": [{"product_id": "latte", "quantity": 2}],
         "status": "", "created_at": "2024-01-01T09:00:00Z"},
        {"order_id": "r2", "customer_name": "", "items": [{"product_id": "latte", "quantity": 1}],
         "status": "", "created_at": "2024-01-01T09:01:00Z"},
        {"order_id": "r3", "customer_name": "bob", "items": [{"product_id": "latte", "quantity": 3}],
         "status": "", "created_at": "2024-01-01T09:02:00Z"},
        {"order_id": "r4", "customer_name": "cy", "items": [], "status": "", "created_at": "2024-01-01T09:03:00Z"},
    ]
    path = os.path.join(d, "orders.json")
    with open(path, "w") as f:
        json.dump(docs, f, indent=2)
    od = files.scan_orders_json(spark, path, multiline=True)
    items = nested.explode_items(od)
    heads = od.select("order_id", "customer_name", "status",
                      F.to_timestamp("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").cast("timestamp_ntz").alias("created_at"))
    menu = spark.createDataFrame([("latte", "x", "d", Decimal("1"))],
                                 "product_id string, name string, description string, price decimal(18,2)")
    bom = spark.createDataFrame([("latte", "milk", Decimal("2"), 1)], "menu_item_id string, inventory_id string, quantity decimal(10,2), pos int")
    stock = spark.createDataFrame([("milk", Decimal("8"))], "ingredient_id string, quantity decimal(18,2)")
    res = orders.place_orders(heads, items, menu, bom, stock)
    # order 1 takes 4 of 8; order 2 has no customer; order 3 needs 6 > 4; order 4 has no items (valid)
    assert sorted(r.order_id for r in res["accepted"].collect()) == ["r1", "r4"]
    assert {r.order_id: r.reason for r in res["rejects"].collect()} == {"r2": "invalid", "r3": "not_enough"}
    assert [r.quantity for r in res["stock"].collect()] == [Decimal("4.00")]
