"""

Every query reads the driver's parquet tables through ``larder.fixtures.Views``
(whole tables) and calls the operators in ``larder``.  ``oracle_sql`` holds an
independent DuckDB statement per key over the same tables; column names match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.fixtures import CHANGE_EVERY, Views, cte, unmatched
from larder.functions.scalar import blank, non_positive
from larder.operators import history, lookup, merge, nested, orders, quality, sales, stock, text
from larder.schemas import ORDER_STATUS_ENUM, TRANSACTION_TYPE_ENUM
from larder.session import materialize, scratch_path
from larder.sources import files
from larder.streaming import changes as streams

SF_SMOKE = "/root/testdata/sf0.001"


# ---------------------------------------------------------------------------
# sales and popularity
def q_popular_items(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    return sales.popular_top_n(sales.popular_items(v.orders, v.items_plain))


def q_popular_top_n(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    return sales.popular_top_n(sales.popular_items(v.orders, v.items_plain), 10)


def q_total_sales(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    return sales.total_sales(v.orders, v.items_plain, v.menu)


def q_total_sales_as_written(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    return sales.total_sales_as_written(v.orders, v.items_plain, v.menu)


def q_priced_items(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    return (sales.priced_items(v.items, v.menu)
            .select("order_id", "pos", "product_id", "quantity",
                    F.col("price").cast("double").alias("price"),
                    F.col("line_total").cast("double").alias("line_total")))


def q_missing_menu_items(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    return sales.missing_menu_items(v.items, v.menu_holes).select("order_id", "pos", "product_id", "quantity")


def q_filter_status(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    s = sales.sales_orders(v.orders).select("order_id", F.lit("sales").alias("rule"))
    c = sales.closed_orders(v.orders).select("order_id", F.lit("popularity").alias("rule"))
    return s.unionByName(c)


def q_order_total_check(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    return sales.order_total_check(v.orders, v.items_priced)


_SALES_SQL = {
    "popular_items": cte("v_orders", "v_items") + """
        select i.product_id, sum(i.quantity) as quantity
        from v_items i join v_orders o on o.order_id = i.order_id
        where o.status = 'closed' group by i.product_id""",
    "popular_top_n": cte("v_orders", "v_items") + """
        select i.product_id, sum(i.quantity) as quantity
        from v_items i join v_orders o on o.order_id = i.order_id
        where o.status = 'closed' group by i.product_id
        order by quantity desc, product_id asc limit 10""",
    "total_sales": cte("v_orders", "v_items", "v_menu") + """
        select cast(coalesce(sum(i.quantity * m.price), 0) as double) as total_sales
        from v_items i join v_orders o on o.order_id = i.order_id
        join v_menu m on m.product_id = i.product_id
        where o.status is distinct from 'open'""",
    "total_sales_as_written": cte("v_orders", "v_items", "v_menu") + """
        select cast(coalesce(sum(sp * sq), 0) as double) as total_sales from (
          select i.order_id, sum(m.price) as sp, sum(i.quantity) as sq
          from v_items i join v_orders o on o.order_id = i.order_id
          join v_menu m on m.product_id = i.product_id
          where o.status is distinct from 'open' group by i.order_id) t""",
    "priced_items": cte("v_items", "v_menu") + """
        select i.order_id, i.pos, i.product_id, i.quantity, cast(m.price as double) as price,
               cast(i.quantity * m.price as double) as line_total
        from v_items i join v_menu m on m.product_id = i.product_id""",
    "missing_menu_items": cte("v_items", "v_menu_holes") + """
        select i.order_id, i.pos, i.product_id, i.quantity from v_items i
        where not exists (select 1 from v_menu_holes m where m.product_id = i.product_id)""",
    "filter_status": cte("v_orders") + """
        select order_id, 'sales' as rule from v_orders where status is distinct from 'open'
        union all
        select order_id, 'popularity' as rule from v_orders where status = 'closed'""",
    "order_total_check": cte("v_orders", "v_items_priced") + """
        select o.order_id, cast(o.total_amount as double) as total_amount,
               cast(coalesce(t.items_total, 0) as double) as items_total,
               cast(o.total_amount - coalesce(t.items_total, 0) as double) as difference
        from v_orders o left join (
          select i.order_id, sum(i.quantity * i.unit_price) as items_total
          from v_items_priced i group by i.order_id) t
        on t.order_id = o.order_id""",
}


# ---------------------------------------------------------------------------
# nested documents
def q_nest_orders(spark, d):
    v = Views(spark, d)
    docs = nested.nest_orders(v.orders_named, v.items)
    return docs.select("order_id", "customer_name", "status", "created_at",
                       F.to_json("items").alias("items_json"), F.size("items").alias("n_items"))


def q_nest_menu(spark, d):
    v = Views(spark, d)
    docs = nested.nest_menu(v.menu, v.bom)
    return docs.select("product_id", "name", "description", F.col("price").cast("double").alias("price"),
                       F.to_json("ingredients").alias("ingredients_json"))


def q_explode_items(spark, d):
    v = Views(spark, d)
    return nested.explode_items(nested.nest_orders(v.orders_named, v.items))


def q_explode_ingredients(spark, d):
    v = Views(spark, d)
    out = nested.explode_ingredients(nested.nest_menu(v.menu, v.bom))
    return out.withColumn("quantity", F.col("quantity").cast("double"))


def q_append_items(spark, d):
    """Every line of each processing order is ordered once more, after the existing lines."""
    v = Views(spark, d)
    again = v.items.join(v.orders.filter(F.col("status") == "processing").select("order_id"), "order_id", "left_semi")
    return nested.append_items(v.items, again)


_NESTED_SQL = {
    "nest_orders": cte("v_orders_named", "v_items", extra=[("agg", """
        select order_id, to_json(list({'product_id': product_id, 'quantity': quantity} order by pos)) as j,
               count(*) as n from v_items group by order_id""")]) + """
        select o.order_id, o.customer_name, o.status, strftime(o.created_at, '%Y-%m-%dT%H:%M:%SZ') as created_at,
               coalesce(a.j, '[]') as items_json, coalesce(a.n, 0) as n_items
        from v_orders_named o left join agg a on a.order_id = o.order_id""",
    "nest_menu": cte("v_menu", "v_bom", extra=[("agg", """
        select menu_item_id,
               '[' || string_agg('{"ingredient_id":' || inventory_id || ',"quantity":' || cast(quantity as varchar) || '}',
                                 ',' order by pos) || ']' as j
        from v_bom group by menu_item_id""")]) + """
        select m.product_id, m.name, m.description, cast(m.price as double) as price,
               coalesce(a.j, '[]') as ingredients_json
        from v_menu m left join agg a on a.menu_item_id = m.product_id""",
    "explode_items": cte("v_items") + "select order_id, pos, product_id, quantity from v_items",
    "explode_ingredients": cte("v_bom") + """
        select menu_item_id as product_id, pos, inventory_id as ingredient_id, cast(quantity as double) as quantity
        from v_bom""",
    "append_items": cte("v_orders", "v_items", extra=[("mx", "select order_id, max(pos) as m from v_items group by order_id")]) + """
        select order_id, product_id, quantity, pos from v_items
        union all
        select i.order_id, i.product_id, i.quantity, i.pos + mx.m as pos
        from v_items i join v_orders o on o.order_id = i.order_id and o.status = 'processing'
        join mx on mx.order_id = i.order_id""",
}


# ---------------------------------------------------------------------------
# sources and sinks (write to the shared scratch folder, read back)
def q_scan_stock(spark, d):
    v = Views(spark, d)
    root = scratch_path(spark, "stock")
    path = files.write_snapshot(v.stock, root)
    return files.scan_stock(spark, path).withColumn("quantity", F.col("quantity").cast("double"))


def q_scan_menu_json(spark, d):
    v = Views(spark, d)
    root = scratch_path(spark, "menu_json")
    # ids as in the reference's files: text
    menu = v.menu.withColumn("product_id", F.concat(F.lit("p"), "product_id"))
    bom = v.bom.withColumns({"menu_item_id": F.concat(F.lit("p"), "menu_item_id"), "inventory_id": F.concat(F.lit("i"), "inventory_id"),
                             "quantity": (F.col("quantity") / 1000).cast("decimal(18,3)")})
    path = files.write_snapshot(nested.nest_menu(menu, bom), root, fmt="json")
    back = files.scan_menu_json(spark, path)
    listed = F.transform("ingredients", lambda x: F.concat(x["ingredient_id"], F.lit(":"), x["quantity"].cast("decimal(18,3)").cast("string")))
    return back.select("product_id", "name", "description", F.col("price").cast("double").alias("price"),
                       F.array_join(listed, ",").alias("ingredients"))


def q_scan_orders_json(spark, d):
    v = Views(spark, d)
    root = scratch_path(spark, "orders_json")
    heads = v.orders_named.withColumn("order_id", F.concat(F.lit("o"), "order_id"))
    lines = v.items.withColumns({"order_id": F.concat(F.lit("o"), "order_id"), "product_id": F.concat(F.lit("p"), "product_id")})
    path = files.write_snapshot(nested.nest_orders(heads, lines), root, fmt="json")
    back = files.scan_orders_json(spark, path)
    listed = F.transform("items", lambda x: F.concat(x["product_id"], F.lit(":"), x["quantity"].cast("string")))
    return back.select("order_id", "customer_name", "status", "created_at", F.array_join(listed, ",").alias("items"))


def q_write_snapshot(spark, d):
    """Two versions published one after the other; readers see the latest."""
    v = Views(spark, d)
    root = scratch_path(spark, "snap")
    files.write_snapshot(v.stock, root)
    files.write_snapshot(v.stock.withColumn("quantity", F.col("quantity") + 1), root)
    return files.read_snapshot(spark, root).select("ingredient_id", F.col("quantity").cast("double").alias("quantity"))


def q_append_rows(spark, d):
    """Stock with holes is published, then every stock row is offered, some with a quantity of 0: only valid holes go in."""
    v = Views(spark, d)
    root = scratch_path(spark, "append")
    files.write_snapshot(v.stock_holes, root)
    none = F.when(F.col("ingredient_id") % 2 == 0, F.lit(0)).otherwise(F.col("quantity")).cast("decimal(18,2)")
    files.append_rows(v.stock.withColumn("quantity", none), root)
    return files.read_snapshot(spark, root).withColumn("quantity", F.col("quantity").cast("double"))


def q_report_json(spark, d):
    v = Views(spark, d)
    pop = sales.popular_items(v.orders, v.items_plain)
    return files.report_json(pop.select(F.col("product_id").cast("string").alias("product_id"), "quantity"))


_SOURCES_SQL = {
    "scan_stock": cte("v_stock") + "select ingredient_id, name, cast(quantity as double) as quantity, unit from v_stock",
    "scan_menu_json": cte("v_menu", "v_bom", extra=[("agg", """
        select menu_item_id, string_agg('i' || inventory_id || ':' || cast(cast(quantity / 1000 as decimal(18,3)) as varchar), ',' order by pos) as l
        from v_bom group by menu_item_id""")]) + """
        select 'p' || m.product_id as product_id, name, description, cast(price as double) as price, coalesce(a.l, '') as ingredients
        from v_menu m left join agg a on a.menu_item_id = m.product_id""",
    "scan_orders_json": cte("v_orders_named", "v_items", extra=[("agg", """
        select order_id, string_agg('p' || product_id || ':' || quantity, ',' order by pos) as l from v_items group by order_id""")]) + """
        select 'o' || o.order_id as order_id, o.customer_name, o.status, strftime(o.created_at, '%Y-%m-%dT%H:%M:%SZ') as created_at,
               coalesce(a.l, '') as items
        from v_orders_named o left join agg a on a.order_id = o.order_id""",
    "write_snapshot": cte("v_stock") + "select ingredient_id, cast(quantity + 1 as double) as quantity from v_stock",
    "append_rows": cte("v_stock", "v_stock_holes") + """
        select ingredient_id, name, cast(quantity as double) as quantity, unit from v_stock
        where ingredient_id in (select ingredient_id from v_stock_holes) or ingredient_id % 2 <> 0""",
    "report_json": cte("v_orders", "v_items") + """
        select to_json({'product_id': cast(product_id as varchar), 'quantity': quantity}) as json from (
          select i.product_id, sum(i.quantity) as quantity
          from v_items i join v_orders o on o.order_id = i.order_id
          where o.status = 'closed' group by i.product_id) t""",
}


# ---------------------------------------------------------------------------
# bill of materials and stock
def q_ingredient_demand(spark, d):
    v = Views(spark, d)
    return stock.ingredient_demand(v.items, v.bom).withColumn("demand", F.col("demand").cast("double"))


def q_missing_ingredients(spark, d):
    v = Views(spark, d)
    return (stock.missing_ingredients(v.bom, v.stock_holes)
            .select("menu_item_id", "inventory_id", "pos", F.col("quantity").cast("double").alias("quantity")))


def q_line_shortages(spark, d):
    v = Views(spark, d)
    out = stock.line_shortages(stock.ingredient_demand(v.items, v.bom), v.stock_low)
    return out.select("order_id", "pos", "ingredient_pos", "ingredient_id",
                      F.col("demand").cast("double").alias("demand"), F.col("stock").cast("double").alias("stock"))


def q_order_check(spark, d):
    v = Views(spark, d)
    return stock.order_check(v.items, v.menu_holes, v.bom, v.stock_low_holes)


def q_order_cumulative_shortage(spark, d):
    v = Views(spark, d)
    out = stock.order_cumulative_shortage(stock.ingredient_demand(v.items, v.bom), v.stock_low)
    return out.select("order_id", "pos", "ingredient_pos", "ingredient_id",
                      F.col("demand").cast("double").alias("demand"),
                      F.col("cum_demand").cast("double").alias("cum_demand"),
                      F.col("stock").cast("double").alias("stock"), "is_first")


def q_ingredient_usage(spark, d):
    v = Views(spark, d)
    u = stock.ingredient_usage(stock.ingredient_demand(v.items_plain, v.bom))
    return u.withColumn("usage", F.col("usage").cast("double"))


def q_apply_usage(spark, d):
    """Usage of the processing orders applied to the stock with holes."""
    v = Views(spark, d)
    proc = v.items_plain.join(v.orders.filter(F.col("status") == "processing").select("order_id"), "order_id", "left_semi")
    out = stock.apply_usage(v.stock_holes, stock.ingredient_usage(stock.ingredient_demand(proc, v.bom)))
    return out.select("ingredient_id", *[F.col(c).cast("double").alias(c) for c in ("quantity_before", "usage", "quantity")],
                      "reason")


_DEMAND = """select i.order_id, i.pos, i.product_id, b.pos as ingredient_pos, b.inventory_id as ingredient_id,
                    b.quantity * i.quantity as demand
             from v_items i join v_bom b on b.menu_item_id = i.product_id"""

_STOCK_SQL = {
    "ingredient_demand": cte("v_items", "v_bom") + f"""
        select order_id, pos, product_id, ingredient_pos, ingredient_id, cast(demand as double) as demand
        from ({_DEMAND}) t""",
    "missing_ingredients": cte("v_bom", "v_stock_holes") + """
        select menu_item_id, inventory_id, pos, cast(quantity as double) as quantity from v_bom b
        where not exists (select 1 from v_stock_holes s where s.ingredient_id = b.inventory_id)""",
    "line_shortages": cte("v_items", "v_bom", "v_stock_low", extra=[("dm", _DEMAND)]) + """
        select d.order_id, d.pos, d.ingredient_pos, d.ingredient_id, cast(d.demand as double) as demand,
               cast(s.quantity as double) as stock
        from dm d join v_stock_low s on s.ingredient_id = d.ingredient_id where d.demand > s.quantity""",
    "order_check": cte("v_items", "v_bom", "v_menu_holes", "v_stock_low_holes", extra=[("dm", _DEMAND), ("probs", """
        select i.order_id, i.pos, 0 as ingredient_pos, 'unknown_item' as reason, i.product_id,
               cast(null as bigint) as ingredient_id
        from v_items i where not exists (select 1 from v_menu_holes m where m.product_id = i.product_id)
        union all
        select d.order_id, d.pos, d.ingredient_pos,
               case when s.ingredient_id is null then 'unknown_ingredient' else 'not_enough' end,
               d.product_id, d.ingredient_id
        from dm d left join v_stock_low_holes s on s.ingredient_id = d.ingredient_id
        where exists (select 1 from v_menu_holes m where m.product_id = d.product_id)
          and (s.ingredient_id is null or d.demand > s.quantity)""")]) + """
        select order_id, pos, ingredient_pos, reason, product_id, ingredient_id from (
          select *, row_number() over (partition by order_id order by pos, ingredient_pos) as rn from probs) t
        where rn = 1""",
    "order_cumulative_shortage": cte("v_items", "v_bom", "v_stock_low", extra=[("dm", _DEMAND)]) + """
        select order_id, pos, ingredient_pos, ingredient_id, cast(demand as double) as demand,
               cast(cum_demand as double) as cum_demand, cast(stock as double) as stock,
               row_number() over (partition by order_id order by pos, ingredient_pos) = 1 as is_first from (
          select d.*, s.quantity as stock,
                 sum(d.demand) over (partition by d.order_id, d.ingredient_id order by d.pos, d.ingredient_pos
                                     rows between unbounded preceding and current row) as cum_demand
          from dm d join v_stock_low s on s.ingredient_id = d.ingredient_id) t
        where cum_demand > stock""",
    "ingredient_usage": cte("v_items", "v_bom", extra=[("dm", _DEMAND)]) + """
        select ingredient_id, cast(sum(demand) as double) as usage from dm group by ingredient_id""",
    "apply_usage": cte("v_orders", "v_items", "v_bom", "v_stock_holes", extra=[("dm", _DEMAND), ("u", """
        select d.ingredient_id, sum(d.demand) as usage from dm d
        join v_orders o on o.order_id = d.order_id and o.status = 'processing' group by d.ingredient_id""")]) + """
        select coalesce(s.ingredient_id, u.ingredient_id) as ingredient_id,
               cast(s.quantity as double) as quantity_before,
               cast(coalesce(u.usage, 0) as double) as usage,
               cast(case when s.ingredient_id is null then s.quantity
                         when s.quantity - coalesce(u.usage, 0) < 0 then s.quantity
                         else s.quantity - coalesce(u.usage, 0) end as double) as quantity,
               case when s.ingredient_id is null then 'unknown_ingredient'
                    when s.quantity - coalesce(u.usage, 0) < 0 then 'not_enough' end as reason
        from v_stock_holes s full join u on u.ingredient_id = s.ingredient_id""",
}


# ---------------------------------------------------------------------------
# keyed merges on the menu (change batch: every CHANGE_EVERY-th part with price + 1,
# and the same rows shifted out of the key range)
def _menu_batch(v: Views) -> DataFrame:
    changed = (v.menu.filter(F.col("product_id") % CHANGE_EVERY == 0)
               .withColumn("price", F.col("price") + 1))
    shifted = changed.withColumn("product_id", unmatched("product_id"))
    return changed.unionByName(shifted)


def _menu_valid() -> "F.Column":
    return ~(non_positive("price") | blank("name") | blank("description"))


def q_merge_insert(spark, d):
    v = Views(spark, d)
    snap, _, _ = merge.merge_insert(v.menu, _menu_batch(v), "product_id", _menu_valid())
    return snap.select("product_id", "name", F.col("price").cast("double").alias("price"))


def q_merge_replace(spark, d):
    v = Views(spark, d)
    snap, _ = merge.merge_replace(v.menu, _menu_batch(v), "product_id", _menu_valid())
    return snap.select("product_id", "name", "description", F.col("price").cast("double").alias("price"))


def q_stamp_updated_at(spark, d):
    v = Views(spark, d)
    base = v.menu.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    ts = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    snap, _ = merge.merge_replace(base, _menu_batch(v), "product_id", _menu_valid(), stamp=ts)
    return snap.select("product_id", F.col("price").cast("double").alias("price"), "updated_at")


def q_merge_quantity(spark, d):
    v = Views(spark, d)
    changed = (v.stock.filter(F.col("ingredient_id") % CHANGE_EVERY == 0)
               .select("ingredient_id", (F.col("quantity") * 2).alias("quantity")))
    batch = changed.unionByName(changed.withColumn("ingredient_id", unmatched("ingredient_id")))
    snap, _ = merge.merge_quantity(v.stock, batch)
    return snap.withColumn("quantity", F.col("quantity").cast("double"))


def q_merge_delete(spark, d):
    v = Views(spark, d)
    snap, _ = merge.merge_delete(v.menu, _menu_batch(v), "product_id")
    return snap.select("product_id", "name")


def q_merge_rejects(spark, d):
    v = Views(spark, d)
    b = _menu_batch(v)
    _, _, r1 = merge.merge_insert(v.menu, b, "product_id", _menu_valid())
    _, r2 = merge.merge_replace(v.menu, b, "product_id", _menu_valid())
    _, r3 = merge.merge_delete(v.menu, b, "product_id")
    return (r1.withColumn("op", F.lit("insert")).unionByName(r2.withColumn("op", F.lit("replace")))
            .unionByName(r3.withColumn("op", F.lit("delete"))))


def q_delete_effects(spark, d):
    """Deleting the batch's menu items: BOM and price history cascade, order lines restrict."""
    v = Views(spark, d)
    eff = merge.delete_effects(
        _menu_batch(v).select("product_id"), "product_id",
        [merge.ChildRef("ingredients", v.bom, "menu_item_id", "cascade"),
         merge.ChildRef("order_items", v.items_plain, "product_id", "restrict"),
         merge.ChildRef("price_history", v.price, "menu_item_id", "cascade")])
    return eff["summary"]


_BATCH = f"""select product_id, name, description, category, price + 1 as price from v_menu
             where product_id % {CHANGE_EVERY} = 0
             union all
             select -1 - product_id, name, description, category, price + 1 from v_menu
             where product_id % {CHANGE_EVERY} = 0"""
_VALID = "not (coalesce(price, 0) <= 0 or coalesce(name, '') = '' or coalesce(description, '') = '')"

_MERGE_SQL = {
    "merge_insert": cte("v_menu", extra=[("b", _BATCH)]) + f"""
        select product_id, name, cast(price as double) as price from v_menu
        union all
        select product_id, name, cast(price as double) from b
        where {_VALID} and product_id not in (select product_id from v_menu)""",
    "merge_replace": cte("v_menu", extra=[("b", _BATCH)]) + f"""
        select m.product_id, coalesce(b.name, m.name) as name, coalesce(b.description, m.description) as description,
               cast(coalesce(b.price, m.price) as double) as price
        from v_menu m left join (select * from b where {_VALID}) b on b.product_id = m.product_id""",
    "stamp_updated_at": cte("v_menu", extra=[("b", _BATCH)]) + f"""
        select m.product_id, cast(coalesce(b.price, m.price) as double) as price,
               case when b.product_id is not null then timestamp '2024-06-01 12:00:00' end as updated_at
        from v_menu m left join (select * from b where {_VALID}) b on b.product_id = m.product_id""",
    "merge_quantity": cte("v_stock") + f"""
        select ingredient_id, name,
               cast(case when ingredient_id % {CHANGE_EVERY} = 0 then quantity * 2 else quantity end as double) as quantity,
               unit from v_stock""",
    "merge_delete": cte("v_menu") + f"select product_id, name from v_menu where product_id % {CHANGE_EVERY} <> 0",
    "merge_rejects": cte("v_menu", extra=[("b", _BATCH)]) + f"""
        select product_id, case when not ({_VALID}) then 'invalid' else 'exists' end as reason, 'insert' as op
        from b where not ({_VALID}) or product_id in (select product_id from v_menu)
        union all
        select product_id, case when not ({_VALID}) then 'invalid' else 'not_found' end, 'replace'
        from b where not ({_VALID}) or product_id not in (select product_id from v_menu)
        union all
        select product_id, 'not_found', 'delete' from b where product_id not in (select product_id from v_menu)""",
    "delete_effects": cte("v_menu", "v_bom", "v_price", extra=[("b", _BATCH), ("p", "select distinct product_id from b"),
        ("ni", "select l_partkey as k, count(*) as n from lineitem group by l_partkey"),
        ("nb", "select menu_item_id as k, count(*) as n from v_bom group by menu_item_id"),
        ("np", "select menu_item_id as k, count(*) as n from v_price group by menu_item_id")]) + """
        select p.product_id, ni.k is not null as blocked, coalesce(nb.n, 0) as n_ingredients,
               coalesce(ni.n, 0) as n_order_items, coalesce(np.n, 0) as n_price_history
        from p left join ni on ni.k = p.product_id left join nb on nb.k = p.product_id
        left join np on np.k = p.product_id""",
}

# ---------------------------------------------------------------------------
# change tracking: ledger, status history, price history
_OPENING = "100.00"  # fixed: ledger opening balance (FIXTURES)
_MERGE_AT = "2002-01-01 00:00:00"
_CHANGE_CUTOFF = "2001-01-01 00:00:00"
_CLOSE_BEFORE = "1998-01-01 00:00:00"


def q_stock_ledger(spark, d):
    v = Views(spark, d)
    out = history.stock_ledger(v.ledger, F.lit(_OPENING).cast("decimal(18,2)"))
    return out.select("event_id", "inventory_id", "transaction_type", F.col("balance").cast("double").alias("balance"))


def q_stock_balance(spark, d):
    v = Views(spark, d)
    return history.stock_balance(v.ledger, F.lit(_OPENING).cast("decimal(18,2)")).withColumn("balance", F.col("balance").cast("double"))


def q_stock_balance_int(spark, d):
    v = Views(spark, d)
    return history.stock_balance_int(v.ledger, F.lit(_OPENING).cast("decimal(18,2)"))


def q_status_history(spark, d):
    v = Views(spark, d)
    return history.status_history(v.status)


def q_price_history(spark, d):
    v = Views(spark, d)
    return history.price_history(v.price).withColumn("price", F.col("price").cast("double"))


def q_price_history_merge(spark, d):
    """The history built from all observations, then the current menu prices applied."""
    v = Views(spark, d)
    h = materialize(history.price_history(v.price), "price_history")   # the stored history table
    snap = v.menu.select(F.col("product_id").alias("menu_item_id"), "price")
    out = history.price_history_merge(h, snap, F.lit(_MERGE_AT).cast("timestamp_ntz"))
    return out.withColumn("price", F.col("price").cast("double"))


def _promotions(h: DataFrame) -> DataFrame:
    """Intervals that overlap and leave gaps: of each history interval from an even month only the first 60 days, and for every
    third item another price for the 200 days from each interval's start on."""
    cut = (F.month("effective_from") % 2 == 0)
    end = F.col("effective_from") + F.expr("interval 60 days")
    short = h.withColumn("effective_to", F.when(cut, F.least(F.coalesce("effective_to", end), end)).otherwise(F.col("effective_to")))
    other = h.filter("menu_item_id % 3 = 0").select("menu_item_id", (F.col("price") + 7).alias("price"), "effective_from",
                                                    (F.col("effective_from") + F.expr("interval 200 days")).alias("effective_to"))
    return short.select("menu_item_id", "price", "effective_from", "effective_to").unionByName(other)


def q_price_as_of_promotions(spark, d):
    """W5 over intervals that overlap and leave gaps."""
    v = Views(spark, d)
    ev = v.items.join(v.orders.select("order_id", "created_at"), "order_id")
    out = history.price_as_of(ev, _promotions(materialize(history.price_history(materialize(v.price, "price_table")), "price_history")))
    return out.select("order_id", "pos", "product_id", "created_at", F.col("price").cast("double").alias("price"))


def q_price_as_of(spark, d):
    v = Views(spark, d)
    ev = v.items.join(v.orders.select("order_id", "created_at"), "order_id")
    out = history.price_as_of(ev, materialize(history.price_history(materialize(v.price, "price_table")), "price_history"))
    return out.select("order_id", "pos", "product_id", "created_at", F.col("price").cast("double").alias("price"))


def _orders_changed(v: Views) -> DataFrame:
    close = (F.col("status") == "open") & (F.col("created_at") < F.lit(_CLOSE_BEFORE).cast("timestamp_ntz"))
    return v.orders.withColumn("status", F.when(close, F.lit("closed")).otherwise(F.col("status")))


def q_status_change_snapshot(spark, d):
    """Old snapshot: orders before the cutoff; new: all orders with old open ones closed."""
    v = Views(spark, d)
    old = v.orders.filter(F.col("created_at") < F.lit(_CHANGE_CUTOFF).cast("timestamp_ntz"))
    return history.status_change_snapshot(old, _orders_changed(v))


_W4 = """
    select id, menu_item_id, price, effective_from,
           lead(effective_from) over (partition by menu_item_id order by effective_from) as effective_to
    from (select menu_item_id || '_' || epoch_us(ts) || '_0' as id, menu_item_id, price, ts as effective_from
          from (select *, lag(price) over (partition by menu_item_id order by ts) as prev,
                       row_number() over (partition by menu_item_id order by ts) as rn from v_price) t
          where rn = 1 or prev is distinct from price) c"""

# the ledger oracle is a sequential fold (recursive CTE), independent of the window algorithm
_FOLD = [("num", """select *, row_number() over (partition by inventory_id order by ts, event_id) as rn
                    from v_ledger"""),
         ("fold(inventory_id, rn, event_id, transaction_type, balance)", """
            select inventory_id, rn, event_id, transaction_type,
                   case transaction_type when 'increment' then 100.00 + quantity
                        when 'decrement' then 100.00 - quantity when 'adjustment' then quantity end
            from num where rn = 1
            union all
            select n.inventory_id, n.rn, n.event_id, n.transaction_type,
                   case n.transaction_type when 'increment' then f.balance + n.quantity
                        when 'decrement' then f.balance - n.quantity when 'adjustment' then n.quantity end
            from fold f join num n on n.inventory_id = f.inventory_id and n.rn = f.rn + 1""")]

_HISTORY_SQL = {
    "stock_ledger": cte("v_ledger", extra=_FOLD).replace("with ", "with recursive ", 1) + """
        select event_id, inventory_id, transaction_type, cast(balance as double) as balance from fold""",
    "stock_balance": cte("v_ledger", extra=_FOLD).replace("with ", "with recursive ", 1) + """
        select inventory_id, cast(arg_max(balance, rn) as double) as balance from fold group by inventory_id""",
    "stock_balance_int": cte("v_ledger", extra=_FOLD).replace("with ", "with recursive ", 1) + """
        select inventory_id, cast(round(arg_max(balance, rn), 0) as int) as quantity from fold group by inventory_id""",
    "status_history": cte("v_status") + """
        select order_id || '_' || epoch_us(ts) || '_' || event_id as id, order_id, status, ts as created_at
        from (select *, lag(status) over w as prev, row_number() over w as rn from v_status
              window w as (partition by order_id order by ts, event_id)) t
        where rn = 1 or prev is distinct from status""",
    "price_history": cte("v_price", extra=[("h", _W4)]) + """
        select id, menu_item_id, cast(price as double) as price, effective_from, effective_to from h""",
    "price_history_merge": cte("v_price", "v_menu", extra=[
        ("h", _W4), ("o", "select * from h where effective_to is null"),
        ("s", "select product_id as menu_item_id, price from v_menu")]) + f"""
        select id, menu_item_id, cast(price as double) as price, effective_from, effective_to
        from h where effective_to is not null
        union all
        select o.id, o.menu_item_id, cast(o.price as double), o.effective_from,
               case when s.menu_item_id is not null and s.price is distinct from o.price
                    then timestamp '{_MERGE_AT}' end
        from o left join s on s.menu_item_id = o.menu_item_id
        union all
        select s.menu_item_id || '_' || epoch_us(timestamp '{_MERGE_AT}') || '_0', s.menu_item_id,
               cast(s.price as double), timestamp '{_MERGE_AT}', null
        from s left join o on o.menu_item_id = s.menu_item_id
        where o.id is null or o.price is distinct from s.price""",
    "price_as_of": cte("v_price", "v_items", "v_orders", extra=[("h", _W4)]) + """
        select i.order_id, i.pos, i.product_id, o.created_at, cast(h.price as double) as price
        from v_items i join v_orders o on o.order_id = i.order_id
        left join h on h.menu_item_id = i.product_id and h.effective_from <= o.created_at
                   and (o.created_at < h.effective_to or h.effective_to is null)""",
    "price_as_of_promotions": cte("v_price", "v_items", "v_orders", extra=[("h", _W4), ("iv", """
          select menu_item_id, price, effective_from, case when month(effective_from) % 2 = 0
                 then least(coalesce(effective_to, effective_from + interval 60 day), effective_from + interval 60 day) else effective_to end as effective_to from h
          union all select menu_item_id, price + 7, effective_from, effective_from + interval 200 day from h where menu_item_id % 3 = 0""")]) + """
        select order_id, pos, product_id, created_at, cast(price as double) as price from (
          select i.order_id, i.pos, i.product_id, o.created_at, iv.price, row_number() over (
                 partition by i.order_id, i.pos order by iv.effective_from desc nulls last, coalesce(iv.effective_to, timestamp '9999-01-01') desc, iv.price desc) as nth
          from v_items i join v_orders o on o.order_id = i.order_id
          left join iv on iv.menu_item_id = i.product_id and iv.effective_from <= o.created_at
                     and (o.created_at < iv.effective_to or iv.effective_to is null)) where nth = 1""",
    "status_change_snapshot": cte("v_orders", extra=[
        ("old", f"select * from v_orders where created_at < timestamp '{_CHANGE_CUTOFF}'"),
        ("new", f"""select order_id, case when status = 'open' and created_at < timestamp '{_CLOSE_BEFORE}'
                                     then 'closed' else status end as status from v_orders""")]) + """
        select n.order_id, o.status as old_status, n.status,
               case when o.order_id is null then 'insert' else 'update' end as change
        from new n left join old o on o.order_id = n.order_id
        where o.order_id is null or o.status is distinct from n.status""",
}

# ---------------------------------------------------------------------------
# data quality.  "Dirty" inputs set some values to zero, empty or NULL by key
# modulus (fixed rules), so every rule has rows to find.
def _dirty_menu(v: Views) -> DataFrame:
    k = F.col("product_id")
    return (v.menu
            .withColumn("price", F.when(k % 11 == 0, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("price")))
            .withColumn("name", F.when(k % 13 == 0, F.lit("")).otherwise(F.col("name")))
            .withColumn("description", F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("description")))
            .withColumn("category", F.when(k % 19 == 0, F.lit(None).cast("string")).otherwise(F.col("category"))))


def _dirty_menu_docs(v: Views) -> DataFrame:
    docs = nested.nest_menu(_dirty_menu(v), v.bom)
    zero_first = F.transform("ingredients", lambda x, i: F.when(
        i == 0, F.struct(x["ingredient_id"].alias("ingredient_id"), F.lit(0).cast("decimal(10,2)").alias("quantity")))
        .otherwise(x))
    return docs.withColumn("ingredients", F.when(F.col("product_id") % 29 == 0, zero_first).otherwise(F.col("ingredients")))


def _dirty_order_docs(v: Views) -> DataFrame:
    docs = nested.nest_orders(v.orders_named, v.items)
    k = F.col("order_id")
    zero_first = F.transform("items", lambda x, i: F.when(
        i == 0, F.struct(x["product_id"].alias("product_id"), F.lit(0).alias("quantity"))).otherwise(x))
    return (docs.withColumn("customer_name", F.when(k % 31 == 0, F.lit("")).otherwise(F.col("customer_name")))
            .withColumn("items", F.when(k % 37 == 0, zero_first).otherwise(F.col("items"))))


def _dirty_stock(v: Views) -> DataFrame:
    k = F.col("ingredient_id")
    return (v.stock
            .withColumn("quantity", F.when(k % 11 == 0, F.lit(0)).when(k % 7 == 3, F.lit(-5))
                        .otherwise(F.col("quantity")).cast("decimal(18,2)"))
            .withColumn("ingredient_id", F.when(k % 17 == 0, F.lit(None).cast("long")).otherwise(k)))


def _spoilt(df: DataFrame, key, spoil: dict[str, tuple[int, object]]) -> DataFrame:
    """``df`` with a column set to a value (None: NULL) where ``key`` leaves a given rest by 31; kinds stay."""
    return df.withColumns({c: F.when(key % 31 == rest, F.lit(value)).otherwise(F.col(c)).cast(df.schema[c].dataType)
                           for c, (rest, value) in spoil.items()})


def _customers(v: Views) -> DataFrame:
    c = v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return _spoilt(c, F.col("id"), {"name": (3, None)})


def _relational(v: Views, nulls: bool) -> dict[str, DataFrame]:
    """The schema's tables with bad values by fixed rules: NULLs, or values that break a CHECK or an enum."""
    bad = lambda value: None if nulls else value
    line = F.col("order_id") + F.col("pos")
    event = F.col("event_id")
    return {
        "menu_item_ingredients": _spoilt(v.bom.withColumn("unit", F.lit("g")), F.col("menu_item_id") + F.col("inventory_id"), {"quantity": (1, bad(0)), "unit": (2, None)}),
        "orders": _spoilt(v.orders, F.col("order_id"), {"total_amount": (4, bad(-1)), "status": (5, bad("lost"))}),
        "order_items": _spoilt(v.items_priced, line, {"quantity": (6, bad(0)), "unit_price": (7, bad(0))}),
        "order_status_history": _spoilt(v.status, event, {"status": (8, None)}),
        "price_history": _spoilt(v.price.withColumn("place", F.dayofyear("ts")), F.col("menu_item_id") + F.col("place"), {"price": (9, bad(0)), "ts": (10, None)}),
        "inventory_transactions": _spoilt(v.ledger, event, {"transaction_type": (11, bad("gift")), "quantity": (12, bad(0))}),
    }


def q_invalid_menu(spark, d):
    return quality.invalid_menu(_dirty_menu_docs(Views(spark, d)))


def q_invalid_orders(spark, d):
    return quality.invalid_orders(_dirty_order_docs(Views(spark, d)))


def q_invalid_stock(spark, d):
    return quality.invalid_stock(_dirty_stock(Views(spark, d)))


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_KEYS = {"menu_item_ingredients": ["menu_item_id", "inventory_id"], "orders": ["order_id"], "order_items": ["order_id", "pos"],
         "order_status_history": ["event_id"], "price_history": ["menu_item_id", "place"], "inventory_transactions": ["event_id"]}


def q_check_violations(spark, d):
    """The seven CHECK constraints (NULL passes)."""
    v = Views(spark, d)
    t, c = _relational(v, nulls=False), quality.check
    rules = {
        "menu_item_ingredients": {"positive_quantity": c(F.col("quantity") > 0)},
        "orders": {"positive_total_amount": c(F.col("total_amount") >= 0)},
        "order_items": {"positive_quantity": c(F.col("quantity") > 0), "positive_unit_price": c(F.col("unit_price") > 0)},
        "price_history": {"positive_price": c(F.col("price") > 0)},
        "inventory_transactions": {"non_zero_quantity": c(F.col("quantity") != 0)},
    }
    menu = quality.violations(_dirty_menu(v), "menu_items", ["product_id"], {"positive_price": c(F.col("price") > 0)})
    return _together([menu] + [quality.violations(t[n], n, _KEYS[n], r) for n, r in rules.items()])


def q_null_violations(spark, d):
    """NOT NULL columns of the mapped tables, one pass per table."""
    v = Views(spark, d)
    t = _relational(v, nulls=True)
    nn = lambda cols: {f"{c}_not_null": quality.not_null(c) for c in cols}
    menu = _spoilt(_dirty_menu(v), F.col("product_id"), {"name": (13, None), "price": (14, None)})
    return _together([
        quality.violations(_customers(v), "customers", ["id"], nn(["name"])),
        quality.violations(menu, "menu_items", ["product_id"], nn(["name", "category", "price"])),
        *[quality.violations(t[n], n, _KEYS[n], nn(cols)) for n, cols in {
            "menu_item_ingredients": ["quantity", "unit"], "orders": ["status", "total_amount"], "order_items": ["quantity", "unit_price"],
            "order_status_history": ["status"], "price_history": ["price", "ts"], "inventory_transactions": ["transaction_type", "quantity"]}.items()]])


def q_enum_violations(spark, d):
    """Statuses and types outside the enums: the application's 'open' is not in one."""
    t = _relational(Views(spark, d), nulls=False)
    return (quality.violations(t["orders"], "orders", ["order_id"],
                               {"status_enum": quality.in_domain("status", ORDER_STATUS_ENUM)})
            .unionByName(quality.violations(t["inventory_transactions"], "inventory_transactions", ["event_id"],
                                            {"type_enum": quality.in_domain("transaction_type", TRANSACTION_TYPE_ENUM)})))


def q_apply_defaults(spark, d):
    v = Views(spark, d)
    ts = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    out = quality.apply_defaults(_dirty_menu(v), {"name": F.lit("unnamed"), "is_available": F.lit(True),
                                                  "created_at": ts, "updated_at": ts})
    return out.select("product_id", "name", "is_available", "created_at", "updated_at")


def q_key_duplicates(spark, d):
    v = Views(spark, d)
    t = v.table
    parts = [
        quality.key_duplicates(t("lineitem"), "lineitem", ["l_orderkey", "l_linenumber"]),
        quality.key_duplicates(t("orders"), "orders", ["o_orderkey"]),
        quality.key_duplicates(t("part"), "part", ["p_partkey"]),
        quality.key_duplicates(t("supplier"), "supplier", ["s_suppkey"]),
        quality.key_duplicates(t("customer"), "customer", ["c_custkey"]),
        quality.key_duplicates(t("customer"), "customer_name", ["c_name"], nulls_allowed=True),
        quality.key_duplicates(v.bom, "menu_item_ingredients", ["menu_item_id", "inventory_id"]),
        quality.key_duplicates(materialize(v.price, "price_table"), "price_history", ["menu_item_id", "ts"]),   # the stored table
        quality.key_duplicates(v.status, "order_status_history", ["order_id", "ts"]),
        quality.key_duplicates(v.ledger, "inventory_transactions", ["event_id"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_fk_orphans(spark, d):
    """The nine foreign keys over the mapped tables (with the deliberate holes)."""
    v = Views(spark, d)
    o = quality.fk_orphans
    no_order = v.ledger.withColumn("order_id", F.lit(None).cast("long"))
    parts = [
        o(v.bom, "menu_item_id", v.menu_holes, "product_id", "menu_item_ingredients.menu_item_id"),
        o(v.bom, "inventory_id", v.stock_holes, "ingredient_id", "menu_item_ingredients.inventory_id"),
        o(v.orders, "customer_id", v.customers_holes, "id", "orders.customer_id"),
        o(v.items_plain, "order_id", v.orders, "order_id", "order_items.order_id"),
        o(v.items_plain, "product_id", v.menu_holes, "product_id", "order_items.menu_item_id"),
        o(v.status, "order_id", v.orders, "order_id", "order_status_history.order_id"),
        o(v.price, "menu_item_id", v.menu_holes, "product_id", "price_history.menu_item_id"),
        o(v.ledger, "inventory_id", v.stock_holes, "ingredient_id", "inventory_transactions.inventory_id"),
        o(no_order, "order_id", v.orders, "order_id", "inventory_transactions.order_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_DM = """select product_id, name, description, category, price,
                case when product_id % 11 = 0 then cast(0 as decimal(18,2)) else price end as dprice,
                case when product_id % 13 = 0 then '' else name end as dname,
                case when product_id % 23 = 0 then null else description end as ddesc,
                case when product_id % 19 = 0 then null else category end as dcat
         from v_menu"""

_QUALITY_SQL = {
    "invalid_menu": cte("v_menu", "v_bom", extra=[("dm", _DM)]) + """
        select 'menu' as "table", 'price_not_positive' as rule, cast(product_id as varchar) as key from dm
        where coalesce(dprice, 0) <= 0
        union all select 'menu', 'name_empty', cast(product_id as varchar) from dm where coalesce(dname, '') = ''
        union all select 'menu', 'description_empty', cast(product_id as varchar) from dm where coalesce(ddesc, '') = ''
        union all select 'menu', 'ingredient_invalid', cast(product_id as varchar) from dm m
        where exists (select 1 from v_bom b where b.menu_item_id = m.product_id
                      and (b.quantity <= 0 or (m.product_id % 29 = 0 and b.pos = 1)))""",
    "invalid_orders": cte("v_orders_named", "v_items") + """
        select 'orders' as "table", 'status_closed' as rule, cast(order_id as varchar) as key
        from v_orders_named where status = 'closed'
        union all select 'orders', 'customer_empty', cast(order_id as varchar) from v_orders_named
        where order_id % 31 = 0 or coalesce(customer_name, '') = ''
        union all select 'orders', 'item_invalid', cast(order_id as varchar) from v_orders_named o
        where exists (select 1 from v_items i where i.order_id = o.order_id
                      and (i.quantity <= 0 or (o.order_id % 37 = 0 and i.pos = 1)))""",
    "invalid_stock": cte("v_stock", extra=[("ds", """
        select case when ingredient_id % 17 = 0 then null else ingredient_id end as ingredient_id,
               case when ingredient_id % 11 = 0 then 0 when ingredient_id % 7 = 3 then -5 else quantity end as quantity
        from v_stock""")]) + """
        select 'inventory' as "table", 'ingredient_id_empty' as rule, coalesce(cast(ingredient_id as varchar), '') as key
        from ds where ingredient_id is null
        union all select 'inventory', 'quantity_not_positive', coalesce(cast(ingredient_id as varchar), '') from ds
        where coalesce(quantity, 0) <= 0""",
    "check_violations": cte("v_menu", "v_bom", "v_orders", "v_items_priced", "v_price", "v_ledger", extra=[("dm", _DM)]) + """
        select 'menu_items' as "table", 'positive_price' as rule, cast(product_id as varchar) as key from dm
        where dprice <= 0
        union all select 'menu_item_ingredients', 'positive_quantity', menu_item_id || '|' || inventory_id
        from v_bom where quantity <= 0 or (menu_item_id + inventory_id) % 31 = 1
        union all select 'orders', 'positive_total_amount', cast(order_id as varchar) from v_orders where total_amount < 0 or order_id % 31 = 4
        union all select 'order_items', 'positive_quantity', order_id || '|' || pos from v_items_priced where quantity <= 0 or (order_id + pos) % 31 = 6
        union all select 'order_items', 'positive_unit_price', order_id || '|' || pos from v_items_priced where unit_price <= 0 or (order_id + pos) % 31 = 7
        union all select 'price_history', 'positive_price', menu_item_id || '|' || dayofyear(ts)
        from v_price where price <= 0 or (menu_item_id + dayofyear(ts)) % 31 = 9
        union all select 'inventory_transactions', 'non_zero_quantity', cast(event_id as varchar)
        from v_ledger where quantity = 0 or event_id % 31 = 12""",
    "null_violations": cte("v_menu", "v_bom", "v_orders", "v_items_priced", "v_status", "v_price", "v_ledger", extra=[("dm", _DM)]) + """
        select 'customers' as "table", 'name_not_null' as rule, cast(c_custkey as varchar) as key
        from customer where c_name is null or c_custkey % 31 = 3
        union all select 'menu_items', 'name_not_null', cast(product_id as varchar) from dm where dname is null or product_id % 31 = 13
        union all select 'menu_items', 'category_not_null', cast(product_id as varchar) from dm where dcat is null
        union all select 'menu_items', 'price_not_null', cast(product_id as varchar) from dm where dprice is null or product_id % 31 = 14
        union all select 'menu_item_ingredients', 'quantity_not_null', menu_item_id || '|' || inventory_id
        from v_bom where quantity is null or (menu_item_id + inventory_id) % 31 = 1
        union all select 'menu_item_ingredients', 'unit_not_null', menu_item_id || '|' || inventory_id
        from v_bom where (menu_item_id + inventory_id) % 31 = 2
        union all select 'orders', 'status_not_null', cast(order_id as varchar) from v_orders where status is null or order_id % 31 = 5
        union all select 'orders', 'total_amount_not_null', cast(order_id as varchar) from v_orders where total_amount is null or order_id % 31 = 4
        union all select 'order_items', 'quantity_not_null', order_id || '|' || pos from v_items_priced where quantity is null or (order_id + pos) % 31 = 6
        union all select 'order_items', 'unit_price_not_null', order_id || '|' || pos from v_items_priced where unit_price is null or (order_id + pos) % 31 = 7
        union all select 'order_status_history', 'status_not_null', cast(event_id as varchar) from v_status
        where status is null or event_id % 31 = 8
        union all select 'price_history', 'price_not_null', menu_item_id || '|' || dayofyear(ts) from v_price
        where price is null or (menu_item_id + dayofyear(ts)) % 31 = 9
        union all select 'price_history', 'ts_not_null', menu_item_id || '|' || dayofyear(ts) from v_price
        where ts is null or (menu_item_id + dayofyear(ts)) % 31 = 10
        union all select 'inventory_transactions', 'transaction_type_not_null', cast(event_id as varchar) from v_ledger
        where transaction_type is null or event_id % 31 = 11
        union all select 'inventory_transactions', 'quantity_not_null', cast(event_id as varchar) from v_ledger
        where quantity is null or event_id % 31 = 12""",
    "enum_violations": cte("v_orders", "v_ledger") + f"""
        select 'orders' as "table", 'status_enum' as rule, cast(order_id as varchar) as key from v_orders
        where status not in {ORDER_STATUS_ENUM} or order_id % 31 = 5
        union all select 'inventory_transactions', 'type_enum', cast(event_id as varchar) from v_ledger
        where transaction_type not in {TRANSACTION_TYPE_ENUM} or event_id % 31 = 11""",
    "apply_defaults": cte("v_menu", extra=[("dm", _DM)]) + """
        select product_id, dname as name, true as is_available, timestamp '2024-06-01 12:00:00' as created_at,
               timestamp '2024-06-01 12:00:00' as updated_at from dm""",
    "key_duplicates": cte("v_bom", "v_price", "v_status", "v_ledger") + """
        select 'lineitem' as "table", l_orderkey || '|' || l_linenumber as key, count(*) as n from lineitem
        group by l_orderkey, l_linenumber having count(*) > 1
        union all select 'orders', cast(o_orderkey as varchar), count(*) from orders group by o_orderkey having count(*) > 1
        union all select 'part', cast(p_partkey as varchar), count(*) from part group by p_partkey having count(*) > 1
        union all select 'supplier', cast(s_suppkey as varchar), count(*) from supplier group by s_suppkey
        having count(*) > 1
        union all select 'customer', cast(c_custkey as varchar), count(*) from customer group by c_custkey
        having count(*) > 1
        union all select 'customer_name', c_name, count(*) from customer where c_name is not null group by c_name
        having count(*) > 1
        union all select 'menu_item_ingredients', menu_item_id || '|' || inventory_id, count(*) from v_bom
        group by menu_item_id, inventory_id having count(*) > 1
        union all select 'price_history', menu_item_id || '|' || cast(ts as varchar), count(*) from v_price
        group by menu_item_id, ts having count(*) > 1
        union all select 'order_status_history', order_id || '|' || cast(ts as varchar), count(*) from v_status
        group by order_id, ts having count(*) > 1
        union all select 'inventory_transactions', cast(event_id as varchar), count(*) from v_ledger
        group by event_id having count(*) > 1""",
    "fk_orphans": cte("v_bom", "v_menu_holes", "v_stock_holes", "v_orders", "v_customers_holes", "v_items",
                      "v_status", "v_price", "v_ledger") + """
        select 'menu_item_ingredients.menu_item_id' as fk, cast(menu_item_id as varchar) as ref from v_bom b
        where not exists (select 1 from v_menu_holes m where m.product_id = b.menu_item_id)
        union all select 'menu_item_ingredients.inventory_id', cast(inventory_id as varchar) from v_bom b
        where not exists (select 1 from v_stock_holes s where s.ingredient_id = b.inventory_id)
        union all select 'orders.customer_id', cast(customer_id as varchar) from v_orders o
        where customer_id is not null and not exists (select 1 from v_customers_holes c where c.id = o.customer_id)
        union all select 'order_items.order_id', cast(order_id as varchar) from v_items i
        where not exists (select 1 from v_orders o where o.order_id = i.order_id)
        union all select 'order_items.menu_item_id', cast(product_id as varchar) from v_items i
        where not exists (select 1 from v_menu_holes m where m.product_id = i.product_id)
        union all select 'order_status_history.order_id', cast(order_id as varchar) from v_status s
        where not exists (select 1 from v_orders o where o.order_id = s.order_id)
        union all select 'price_history.menu_item_id', cast(menu_item_id as varchar) from v_price p
        where not exists (select 1 from v_menu_holes m where m.product_id = p.menu_item_id)
        union all select 'inventory_transactions.inventory_id', cast(inventory_id as varchar) from v_ledger l
        where not exists (select 1 from v_stock_holes s where s.ingredient_id = l.inventory_id)""",
}

# ---------------------------------------------------------------------------
# order lifecycle.  Requests: every order of 1996, plus the same ids shifted out
# of range (unknown orders).
_REQ_FROM_TO = ("1996-01-01 00:00:00", "1996-12-31 23:59:59.999999")
_REQ_SQL = "created_at between timestamp '{}' and timestamp '{}'".format(*_REQ_FROM_TO)


def _request_ids(v: Views) -> DataFrame:
    year = F.col("created_at").between(*[F.lit(t).cast("timestamp_ntz") for t in _REQ_FROM_TO])
    ids = v.orders.filter(year).select("order_id")
    return ids.unionByName(ids.select(unmatched("order_id").alias("order_id")))


_DONE: dict[tuple, dict] = {}


def _stored(spark, d: str, what: str, run: Callable[[], dict]) -> dict:
    """Results of one admission run, stored once per session and input, for the keys that show its parts."""
    at = (spark.sparkContext.applicationId, d, what)
    if at not in _DONE:
        _DONE[at] = {k: materialize(x, what) for k, x in run().items() if isinstance(x, DataFrame)}
    return _DONE[at]


def _placed(spark, d) -> dict:
    """M4: every order is a new request (no status yet), admitted against the stock in arrival order."""
    v = Views(spark, d)
    req = v.orders_named.withColumn("status", F.lit(None).cast("string"))
    after = v.orders.select(F.max("order_id")).scalar()
    return _stored(spark, d, "place", lambda: orders.place_orders(req, v.items, v.menu_holes, v.bom, v.stock, after=after))


def q_place_orders(spark, d):
    return _placed(spark, d)["accepted"].select("order_id", "new_id", "status", "created_at")


def q_place_rejects(spark, d):
    return _placed(spark, d)["rejects"]


def q_place_stock(spark, d):
    return _placed(spark, d)["stock"].select("ingredient_id", F.col("quantity").cast("double").alias("quantity"))


def q_close_orders(spark, d):
    v = Views(spark, d)
    snap, _ = orders.close_orders(v.orders, _request_ids(v))
    return snap.select("order_id", "status")


def q_close_rejects(spark, d):
    v = Views(spark, d)
    _, rej = orders.close_orders(v.orders, _request_ids(v))
    return rej


def q_cancel_orders(spark, d):
    v = Views(spark, d)
    res = orders.cancel_orders(v.orders, v.items, v.menu, v.bom, v.stock, _request_ids(v))
    return res["stock"].select("ingredient_id", F.col("quantity").cast("double").alias("quantity"))


def q_cancel_rejects(spark, d):
    v = Views(spark, d)
    return orders.cancel_orders(v.orders, v.items, v.menu, v.bom, v.stock, _request_ids(v))["rejects"]


def _amended(spark, d) -> dict:
    """M6: each 1996 order asks for its own lines once more; only the new lines are checked and deducted."""
    v = Views(spark, d)
    named = v.orders_named
    ids = _request_ids(v)
    reqs = (ids.join(named.select("order_id", "customer_name", "created_at"), "order_id", "left")
            .select("order_id", F.coalesce("customer_name", F.lit("walk-in")).alias("customer_name"),
                    F.lit(None).cast("string").alias("status"),
                    F.coalesce("created_at", F.lit("2000-01-01").cast("timestamp_ntz")).alias("requested_at")))
    new_items = v.items.join(ids, "order_id", "left_semi")
    return _stored(spark, d, "amend", lambda: orders.amend_orders(
        v.orders, v.items, reqs, new_items, v.menu, v.bom, v.stock.withColumn("quantity", (F.col("quantity") / 12).cast("decimal(18,2)"))))


def q_amend_orders(spark, d):
    return _amended(spark, d)["accepted"]


def q_amend_rejects(spark, d):
    return _amended(spark, d)["rejects"]


def q_amend_items(spark, d):
    return _amended(spark, d)["items"].select("order_id", "pos", "product_id", "quantity")


def q_amend_stock(spark, d):
    return _amended(spark, d)["stock"].select("ingredient_id", F.col("quantity").cast("double").alias("quantity"))


def q_assign_ids(spark, d):
    """One new order per customer, numbered after the largest existing order id."""
    v = Views(spark, d)
    after = v.orders.select(F.max("order_id")).scalar()
    cust = v.table("customer").select("c_custkey")
    return orders.assign_ids(cust, ["c_custkey"], after).select("c_custkey", "new_id")


_IDS = [("ids", f"""select order_id from v_orders where {_REQ_SQL}
                    union all select -1 - order_id from v_orders where {_REQ_SQL}""")]

# M4 oracle: an independent sequential walk over the orders in arrival order (recursive CTE);
# the stock is carried as a list indexed by ingredient id (ids are 0..n-1).
_ADMISSION_WALK = cte("v_orders", "v_items", "v_bom", "v_stock", extra=[
    ("n", "select count(*)::int as n from v_stock"),
    ("dem", """select i.order_id, b.inventory_id as ing, sum(b.quantity * i.quantity) as d
               from v_items i join v_bom b on b.menu_item_id = i.product_id group by i.order_id, b.inventory_id"""),
    ("o", """select row_number() over (order by o.created_at, o.order_id) as rn, o.order_id, o.created_at,
                    list_transform(range(0, (select n from n)),
                                   lambda j: coalesce(list_sum(list_transform(list_filter(dl, lambda x: x.ing = j),
                                                                              lambda x: x.d)), 0)) as dense
             from v_orders o left join (select order_id, list({'ing': ing, 'd': d}) as dl from dem group by order_id) g
             on g.order_id = o.order_id"""),
    ("walk(rn, bal, acc)", """
        select 0::bigint, (select list(quantity::decimal(38,2) order by ingredient_id) from v_stock), true
        union all
        select o.rn,
               case when list_bool_and(list_transform(range(1, len(w.bal) + 1), lambda j: o.dense[j] <= w.bal[j]))
                    then list_transform(range(1, len(w.bal) + 1), lambda j: w.bal[j] - o.dense[j]) else w.bal end,
               list_bool_and(list_transform(range(1, len(w.bal) + 1), lambda j: o.dense[j] <= w.bal[j]))
        from walk w join o on o.rn = w.rn + 1""")]).replace("with ", "with recursive ", 1)

# M4 over the menu with holes: orders that name an unknown product never arrive at the stock
_PLACE_WALK = (_ADMISSION_WALK
               .replace("with recursive ", "with recursive " + cte("v_menu", "v_menu_holes")[len("with "):-1] + """,
    bad as (select distinct i.order_id from lineitem l join (select l_orderkey as order_id, l_partkey as product_id from lineitem) i
            on i.order_id = l.l_orderkey and i.product_id = l.l_partkey
            where not exists (select 1 from v_menu_holes m where m.product_id = i.product_id)),
    """, 1)
               .replace("from v_orders o left join (select order_id, list({'ing': ing, 'd': d})",
                        "from (select * from v_orders where order_id not in (select order_id from bad)) o "
                        "left join (select order_id, list({'ing': ing, 'd': d})"))

_AMEND_WALK = _ADMISSION_WALK.replace("select list(quantity::decimal(38,2)", "select list((quantity / 12)::decimal(18,2)::decimal(38,2)").replace(
    "from v_orders o left join (select order_id, list({'ing': ing, 'd': d})",
    f"from (select * from v_orders where {_REQ_SQL} and status = 'open') o "
    "left join (select order_id, list({'ing': ing, 'd': d})")

_ORDERS_SQL = {
    "amend_orders": _AMEND_WALK + """
        select o.order_id from walk w join o on o.rn = w.rn where w.acc and w.rn > 0""",
    "amend_rejects": _AMEND_WALK + f"""
        select o.order_id, 'not_enough' as reason from walk w join o on o.rn = w.rn where not w.acc and w.rn > 0
        union all select order_id, 'not_open' from v_orders where {_REQ_SQL} and status <> 'open'
        union all select -1 - order_id, 'not_found' from v_orders where {_REQ_SQL}""",
    "amend_items": _AMEND_WALK + """
        select order_id, pos, product_id, quantity from v_items
        union all
        select i.order_id, i.pos + (select max(p.pos) from v_items p where p.order_id = i.order_id), i.product_id, i.quantity
        from v_items i where i.order_id in (select o.order_id from walk w join o on o.rn = w.rn where w.acc and w.rn > 0)""",
    "amend_stock": _AMEND_WALK + """
        select i - 1 as ingredient_id, cast(bal[i] as double) as quantity
        from (select bal, unnest(range(1, len(bal) + 1)) as i from (select bal from walk order by rn desc limit 1))""",
    "place_orders": _PLACE_WALK + """
        select o.order_id, (select max(order_id) from v_orders) + row_number() over (order by w.rn) as new_id,
               'open' as status, o.created_at from walk w join o on o.rn = w.rn where w.acc and w.rn > 0""",
    "place_rejects": _PLACE_WALK + """
        select o.order_id, 'not_enough' as reason from walk w join o on o.rn = w.rn where not w.acc and w.rn > 0
        union all select order_id, 'unknown_item' from bad""",
    "place_stock": _PLACE_WALK + """
        select s.ingredient_id, cast(s.quantity - coalesce(u.d, 0) as double) as quantity
        from v_stock s left join (
          select dem.ing, sum(dem.d) as d from dem where dem.order_id in (select o.order_id from walk w join o on o.rn = w.rn where w.acc and w.rn > 0)
          group by dem.ing) u on u.ing = s.ingredient_id""",
    "close_orders": cte("v_orders", extra=_IDS) + """
        select order_id, case when order_id in (select order_id from ids) then 'closed' else status end as status
        from v_orders""",
    "close_rejects": cte("v_orders", extra=_IDS) + """
        select i.order_id, case when o.order_id is null then 'not_found' else 'already_closed' end as reason
        from ids i left join v_orders o on o.order_id = i.order_id
        where o.order_id is null or o.status = 'closed'""",
    "cancel_orders": cte("v_orders", "v_items", "v_bom", "v_stock", extra=_IDS + [
        ("done", "select o.order_id from v_orders o join ids on ids.order_id = o.order_id where o.status <> 'closed'"),
        ("back", """select b.inventory_id, sum(b.quantity * i.quantity) as u
                    from v_items i join done on done.order_id = i.order_id
                    join v_bom b on b.menu_item_id = i.product_id group by b.inventory_id""")]) + """
        select s.ingredient_id, cast(s.quantity + coalesce(back.u, 0) as double) as quantity
        from v_stock s left join back on back.inventory_id = s.ingredient_id""",
    "cancel_rejects": cte("v_orders", extra=_IDS) + """
        select i.order_id, case when o.order_id is null then 'not_found' else 'already_closed' end as reason
        from ids i left join v_orders o on o.order_id = i.order_id
        where o.order_id is null or o.status = 'closed'""",
    "assign_ids": """
        select c_custkey, (select max(o_orderkey) from orders) + row_number() over (order by c_custkey) as new_id
        from customer""",
}

# ---------------------------------------------------------------------------
# text search, lookups, indexed filters
_TERMS = ["red", "gear", "economy", "small", "2"]        # fixed search terms
_NAME_TERMS = ["000000042", "000000777", "nobody"]       # fixed customer-name terms
_TRGM = 0.3                                              # trigram similarity threshold
_TRGM_URLS = 0.75                                        # the same for page addresses


def q_weighted_search(spark, d):
    return text.weighted_search(Views(spark, d).menu, _TERMS)


def q_weighted_search_many(spark, d):
    """Every category is a query against every menu row."""
    v = Views(spark, d)
    qs = v.menu.select(F.col("category").alias("query_id"), F.col("category").alias("text")).distinct()
    return text.weighted_search_many(v.menu, qs, top=10)


def q_name_search(spark, d):
    c = Views(spark, d).table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return text.name_search(c, _NAME_TERMS)


def q_trigram_pairs(spark, d):
    return text.trigram_pairs(Views(spark, d).menu.select("name"), _TRGM)


def q_trigram_pairs_urls(spark, d):
    """Page addresses: distinct values grow with the table."""
    return text.trigram_pairs(Views(spark, d).table("pages").select("url"), _TRGM_URLS, col="url")


def q_lookup_by_id(spark, d):
    v = Views(spark, d)
    found, _ = lookup.lookup_by_id(v.orders, _request_ids(v), "order_id")
    return found.select("order_id", "status")


def q_lookup_missing(spark, d):
    v = Views(spark, d)
    return lookup.lookup_by_id(v.orders, _request_ids(v), "order_id")[1]


def q_exists_by_id(spark, d):
    v = Views(spark, d)
    return lookup.exists_by_id(v.orders, _request_ids(v), "order_id")


def q_filter_indexed(spark, d):
    v = Views(spark, d)
    out = lookup.filter_indexed(v.orders, status="closed", created_from="1996-01-01", created_to="1997-01-01")
    return out.select("order_id", "status", "created_at")


def q_filter_partitioned(spark, d):
    """P7 with partition pruning: orders written partitioned by month, read back for one year."""
    v = Views(spark, d)
    path = files.write_partitioned(v.orders, scratch_path(spark, "orders_by_month"))
    back = spark.read.parquet(path)
    out = back.filter((F.col("created_at_month") >= F.lit("1996-01-01").cast("date"))
                      & (F.col("created_at_month") < F.lit("1997-01-01").cast("date")))
    out = lookup.filter_indexed(out, status="closed", created_from="1996-01-01", created_to="1997-01-01")
    return out.select("order_id", "status", "created_at")


def q_filter_category(spark, d):
    return lookup.filter_indexed(Views(spark, d).menu, category="ECONOMY").select("product_id", "name")


def q_filter_available(spark, d):
    """P7 by availability: parts of an odd size are on offer."""
    menu = Views(spark, d).table("part").select(F.col("p_partkey").alias("product_id"), (F.col("p_size") % 2 == 1).alias("is_available"))
    return lookup.filter_indexed(menu, available=True)


def _tok_sql(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda x: x <> ''))"


def _pairs_sql(names: str, threshold: float, *views: str) -> str:
    """All pairs of ``names`` that share a trigram, by brute force."""
    return cte(*views, extra=[
        ("n", names),
        ("w", f"select name, '  ' || unnest({_tok_sql('name')}) || ' ' as p from n"),
        ("tg", "select distinct name, substr(p, i, 3) as g from w, range(1, length(p) - 1) r(i)"),
        ("sz", "select name, count(*) as c from tg group by name"),
        ("inter", """select a.name as a, b.name as b, count(*) as k from tg a join tg b
                     on a.g = b.g and a.name < b.name group by a.name, b.name""")]) + f"""
        select i.a, i.b, i.k / (sa.c + sb.c - i.k) as similarity
        from inter i join sz sa on sa.name = i.a join sz sb on sb.name = i.b
        where i.k >= {threshold} * (sa.c + sb.c - i.k)"""


_TEXT_SQL = {
    "weighted_search": cte("v_menu", extra=[("m", f"""
        select product_id, len(list_intersect({_tok_sql('name')}, {_TERMS})) as na,
               len(list_intersect({_tok_sql('description')}, {_TERMS})) as nb from v_menu""")]) + """
        select product_id, cast(1.0 as double) * na + cast(0.4 as double) * nb as score from m where na + nb > 0""",
    "weighted_search_many": cte("v_menu", extra=[
        ("q", "select distinct category as query_id, category as text from v_menu"),
        ("qt", f"select query_id, unnest({_tok_sql('text')}) as tok from q"),
        ("t", f"""select product_id, unnest({_tok_sql('name')}) as tok, 1 as in_a, 0 as in_b from v_menu
                  union all
                  select product_id, unnest({_tok_sql('description')}), 0, 1 from v_menu""")]) + """
        select * from (select *, row_number() over (partition by query_id order by score desc, product_id) as rank from (
          select query_id, product_id, cast(1.0 as double) * na + cast(0.4 as double) * nb as score from (
          select qt.query_id, t.product_id, sum(in_a) as na, sum(in_b) as nb
          from qt join t on t.tok = qt.tok group by qt.query_id, t.product_id) x) y) z where rank <= 10""",
    "name_search": f"""
        select c_custkey as id, c_name as name from customer
        where len(list_intersect({_tok_sql('c_name')}, {_NAME_TERMS})) > 0""",
    "trigram_pairs": _pairs_sql("select distinct name from v_menu where name is not null", _TRGM, "v_menu"),
    "trigram_pairs_urls": _pairs_sql("select distinct url as name from pages where url is not null", _TRGM_URLS),
    "lookup_by_id": cte("v_orders", extra=_IDS) + """
        select order_id, status from v_orders where order_id in (select order_id from ids)""",
    "lookup_missing": cte("v_orders", extra=_IDS) + """
        select distinct order_id from ids where order_id not in (select order_id from v_orders)""",
    "exists_by_id": cte("v_orders", extra=_IDS) + """
        select distinct order_id, order_id in (select order_id from v_orders) as "exists" from ids""",
    "filter_indexed": cte("v_orders") + """
        select order_id, status, created_at from v_orders where status = 'closed'
        and created_at >= timestamp '1996-01-01' and created_at < timestamp '1997-01-01'""",
    "filter_category": cte("v_menu") + "select product_id, name from v_menu where category = 'ECONOMY'",
    "filter_available": "select p_partkey as product_id, true as is_available from part where p_size % 2 = 1",
    "filter_partitioned": cte("v_orders") + """
        select order_id, status, created_at from v_orders where status = 'closed'
        and created_at >= timestamp '1996-01-01' and created_at < timestamp '1997-01-01'""",
}

# ---------------------------------------------------------------------------
# Structured Streaming: tables stored in steps that follow one another in time, read as
# streams of one step a micro-batch, run to the end (availableNow), results read
# back from the shared folder.
_STEPS, _FILES = 4, 4
_ENOUGH = 1000   # rows of a step from which no file of it can be empty


def _in_steps(df: DataFrame, ts: str) -> tuple[str, int]:
    """Folder of files in _STEPS steps that follow one another in ``ts`` (quarters of its span), and the files of a step.

    Every step has as many files, _FILES or, where a step has few rows, one: so a micro-batch of that many files is a step.
    """
    path = scratch_path(df.sparkSession, "stream-input")
    low, high = df.agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))), F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    step = F.least(F.floor((at - low) * _STEPS / F.lit(high - low + 1)), F.lit(_STEPS - 1))
    held = [r["count"] for r in df.groupBy(step.alias("step")).count().collect()]
    each = _FILES if len(held) == _STEPS and min(held) >= _ENOUGH else 1
    for k in range(_STEPS):
        df.filter(step == k).repartition(each).write.mode("append").parquet(path)
    return path, each


def _step_stream(spark, df: DataFrame, ts: str) -> DataFrame:
    path, files_a_step = _in_steps(df, ts)
    return streams.read_table_stream(spark, path, "*.parquet", max_files=files_a_step)


def q_stream_status_history(spark, d):
    st = _step_stream(spark, Views(spark, d).status, "ts")
    out = scratch_path(spark, "st1", "out")
    streams.run_to_end(streams.status_history_stream(st), "parquet", scratch_path(spark, "st1", "ckpt"), path=out)
    return spark.read.parquet(out).filter(~F.col("late")).drop("late")


def q_stream_stock_balance(spark, d):
    tx = _step_stream(spark, Views(spark, d).ledger, "ts")
    out = scratch_path(spark, "st2", "out")
    streams.run_to_end(streams.stock_balance_stream(tx, _OPENING), "parquet", scratch_path(spark, "st2", "ckpt"),
                       path=out)
    return (spark.read.parquet(out).filter(~F.col("late"))
            .select("event_id", "inventory_id", "transaction_type", F.col("balance").cast("double").alias("balance")))


def q_stream_price_history(spark, d):
    obs = _step_stream(spark, Views(spark, d).price, "ts")
    root = scratch_path(spark, "st3", "history")
    streams.run_to_end(obs, streams.price_history_sink(root), scratch_path(spark, "st3", "ckpt"))
    return streams.read_price_history(spark, root).withColumn("price", F.col("price").cast("double"))


def q_stream_popular_items(spark, d):
    """Lines come by ship date; every order comes open first and takes its status 30 days after it was created."""
    v = Views(spark, d)
    li = _step_stream(spark, v.table("lineitem"), "l_shipdate")
    items = li.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
                      F.col("l_quantity").cast("int").alias("quantity"))
    later = F.col("created_at") + F.expr("interval 30 days")
    statuses = (v.orders.select("order_id", F.lit("open").alias("status"), F.col("created_at").alias("ts"))
                .unionByName(v.orders.filter("status <> 'open'").select("order_id", "status", later.alias("ts"))))
    root = scratch_path(spark, "st4", "popular")
    streams.run_to_end(streams.popular_changes_stream(items, _step_stream(spark, statuses, "ts")), streams.totals_sink(root, compact=3),
                       scratch_path(spark, "st4", "ckpt"))
    return streams.read_totals(spark, root).select("product_id", "quantity")


_STREAM_SQL = {
    "stream_status_history": _HISTORY_SQL["status_history"],
    "stream_stock_balance": _HISTORY_SQL["stock_ledger"],
    "stream_price_history": _HISTORY_SQL["price_history"],
    "stream_popular_items": _SALES_SQL["popular_items"],
}

# ---------------------------------------------------------------------------
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "popular_items": q_popular_items,
    "popular_top_n": q_popular_top_n,
    "total_sales": q_total_sales,
    "total_sales_as_written": q_total_sales_as_written,
    "priced_items": q_priced_items,
    "missing_menu_items": q_missing_menu_items,
    "filter_status": q_filter_status,
    "order_total_check": q_order_total_check,
    "nest_orders": q_nest_orders,
    "nest_menu": q_nest_menu,
    "explode_items": q_explode_items,
    "explode_ingredients": q_explode_ingredients,
    "append_items": q_append_items,
    "scan_stock": q_scan_stock,
    "scan_menu_json": q_scan_menu_json,
    "scan_orders_json": q_scan_orders_json,
    "write_snapshot": q_write_snapshot,
    "append_rows": q_append_rows,
    "report_json": q_report_json,
    "ingredient_demand": q_ingredient_demand,
    "missing_ingredients": q_missing_ingredients,
    "line_shortages": q_line_shortages,
    "order_check": q_order_check,
    "order_cumulative_shortage": q_order_cumulative_shortage,
    "ingredient_usage": q_ingredient_usage,
    "apply_usage": q_apply_usage,
    "merge_insert": q_merge_insert,
    "merge_replace": q_merge_replace,
    "stamp_updated_at": q_stamp_updated_at,
    "merge_quantity": q_merge_quantity,
    "merge_delete": q_merge_delete,
    "merge_rejects": q_merge_rejects,
    "delete_effects": q_delete_effects,
    "stock_ledger": q_stock_ledger,
    "stock_balance": q_stock_balance,
    "stock_balance_int": q_stock_balance_int,
    "status_history": q_status_history,
    "price_history": q_price_history,
    "price_history_merge": q_price_history_merge,
    "price_as_of": q_price_as_of,
    "price_as_of_promotions": q_price_as_of_promotions,
    "status_change_snapshot": q_status_change_snapshot,
    "invalid_menu": q_invalid_menu,
    "invalid_orders": q_invalid_orders,
    "invalid_stock": q_invalid_stock,
    "check_violations": q_check_violations,
    "null_violations": q_null_violations,
    "enum_violations": q_enum_violations,
    "apply_defaults": q_apply_defaults,
    "key_duplicates": q_key_duplicates,
    "fk_orphans": q_fk_orphans,
    "place_orders": q_place_orders,
    "place_rejects": q_place_rejects,
    "place_stock": q_place_stock,
    "close_orders": q_close_orders,
    "close_rejects": q_close_rejects,
    "cancel_orders": q_cancel_orders,
    "cancel_rejects": q_cancel_rejects,
    "amend_orders": q_amend_orders,
    "amend_rejects": q_amend_rejects,
    "amend_items": q_amend_items,
    "amend_stock": q_amend_stock,
    "assign_ids": q_assign_ids,
    "weighted_search": q_weighted_search,
    "weighted_search_many": q_weighted_search_many,
    "name_search": q_name_search,
    "trigram_pairs": q_trigram_pairs,
    "trigram_pairs_urls": q_trigram_pairs_urls,
    "filter_available": q_filter_available,
    "lookup_by_id": q_lookup_by_id,
    "lookup_missing": q_lookup_missing,
    "exists_by_id": q_exists_by_id,
    "filter_indexed": q_filter_indexed,
    "filter_category": q_filter_category,
    "filter_partitioned": q_filter_partitioned,
    "stream_status_history": q_stream_status_history,
    "stream_stock_balance": q_stream_stock_balance,
    "stream_price_history": q_stream_price_history,
    "stream_popular_items": q_stream_popular_items,
}

_ORACLE: dict[str, str] = {**_SALES_SQL, **_NESTED_SQL, **_SOURCES_SQL, **_STOCK_SQL, **_MERGE_SQL, **_HISTORY_SQL, **_QUALITY_SQL, **_ORDERS_SQL, **_TEXT_SQL, **_STREAM_SQL}


# The training-data operators and the pipeline are optional: without their folders the rest stands.
try:
    from larder.llm import queries as _llm
except ModuleNotFoundError as e:
    if not (e.name or "").startswith("larder.llm"):
        raise
else:
    _QUERIES.update(_llm.QUERIES)
    _ORACLE.update(_llm.ORACLE)
try:
    import corpus_pipeline as _pipeline
except ModuleNotFoundError as e:
    if e.name != "corpus_pipeline" and not (e.name or "").startswith("larder.llm"):
        raise
else:
    _QUERIES["pipeline"] = _pipeline.run
    if _pipeline.ORACLE_SQL:
        _ORACLE["pipeline"] = _pipeline.ORACLE_SQL


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: popular items (closed orders, quantity descending) at sf0.001."""
    return q_popular_items(spark, SF_SMOKE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
