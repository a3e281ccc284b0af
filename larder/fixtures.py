"""Reference-shaped inputs mapped onto the driver's parquet tables.

The reference ships no data, so its entities (orders with items, menu with a
bill of materials, stock, a stock ledger, status and price changes) are
derived from the TPC-H-like tables by fixed rules.  Each view exists twice:
as a lazy Spark DataFrame (``Views``) and as DuckDB SQL text (``cte``) for the
independent oracle.  Both read whole tables; the only row removals are the
deliberate referential "holes" (``*_holes``), which exist so that anti-join
operators have orphans to find.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.grouping import dealt_groups

# Fixed values of the mapping (shared by the Spark views and the SQL oracle).
STATUS_MAP = {"O": "open", "F": "closed"}          # anything else -> 'processing'
OPENING_BALANCE = "100.00"                           # stock ledger opening balance
MENU_HOLE, STOCK_HOLE, CUSTOMER_HOLE = 17, 13, 19    # key moduli removed on purpose
CHANGE_EVERY = 5                                     # merge batch: keys divisible by 5


def unmatched(col: str):
    """Merge batches: the key's partner that no table has (tables' keys are not negative)."""
    return -1 - F.col(col)



TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


class Views:
    """Lazy accessors for the base tables and the fixture views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- orders and items -------------------------------------------------
    @cached_property
    def orders(self) -> DataFrame:
        o = self.table("orders")
        status = (F.when(F.col("o_orderstatus") == "O", F.lit("open"))
                  .when(F.col("o_orderstatus") == "F", F.lit("closed"))
                  .otherwise(F.lit("processing")))
        return o.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            status.alias("status"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("total_amount"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def orders_named(self) -> DataFrame:
        """Orders with the customer's name (the nested document's customer_name)."""
        c = self.table("customer").select(F.col("c_custkey").alias("customer_id"),
                                          F.col("c_name").alias("customer_name"))
        return self.orders.join(c, "customer_id", "left")

    @cached_property
    def items(self) -> DataFrame:
        """One row per order line; ``pos`` is the 1-based position in the order.

        (l_orderkey, l_linenumber) is not unique in the data, so the position
        orders by every column needed to make it total.
        """
        li = self.table("lineitem")
        w = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.row_number().over(w).alias("pos"),
        )

    @cached_property
    def items_priced(self) -> DataFrame:
        """Order lines with the price agreed for one unit (here the line's extended price)."""
        w = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("unit_price"), F.row_number().over(w).alias("pos"))

    @cached_property
    def items_plain(self) -> DataFrame:
        """Order lines without the position (no window needed)."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"))

    # ---- menu, bill of materials, stock ------------------------------------
    @cached_property
    def menu(self) -> DataFrame:
        p = self.table("part")
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("description"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
        )

    @cached_property
    def bom(self) -> DataFrame:
        """Three ingredients per menu item; ``pos`` is the ingredient's position."""
        n_ingredients = self.table("supplier").select(F.count(F.lit(1))).scalar()
        k = F.col("k")
        return (self.table("part")
                .select("p_partkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
                .select(
                    F.col("p_partkey").alias("menu_item_id"),
                    ((F.col("p_partkey") + 7 * k) % n_ingredients).alias("inventory_id"),
                    (1 + (F.col("p_partkey") + k) % 3).cast("decimal(10,2)").alias("quantity"),
                    (k + 1).alias("pos"),
                ))

    @cached_property
    def stock(self) -> DataFrame:
        s = self.table("supplier")
        return s.select(
            F.col("s_suppkey").alias("ingredient_id"),
            F.col("s_name").alias("name"),
            (50000 + 1000 * (F.col("s_suppkey") % 7)).cast("decimal(18,2)").alias("quantity"),
            F.lit("unit").alias("unit"),
        )

    @cached_property
    def stock_low(self) -> DataFrame:
        s = self.table("supplier")
        return s.select(
            F.col("s_suppkey").alias("ingredient_id"),
            (60 + 15 * (F.col("s_suppkey") % 7)).cast("decimal(18,2)").alias("quantity"),
        )

    # ---- change logs ---------------------------------------------------------
    @cached_property
    def ledger(self) -> DataFrame:
        e = self.table("events")
        ttype = (F.when(F.col("event_type") == "signup", F.lit("adjustment"))
                 .when(F.col("event_type").isin("view", "click"), F.lit("increment"))
                 .otherwise(F.lit("decrement")))
        return e.select(
            "event_id",
            F.col("user_id").alias("inventory_id"),
            ttype.alias("transaction_type"),
            F.col("value").cast("decimal(18,2)").alias("quantity"),
            "ts",
        )

    @cached_property
    def status(self) -> DataFrame:
        e = self.table("events")
        return e.select("event_id", F.col("user_id").alias("order_id"),
                        F.col("event_type").alias("status"), "ts")

    @cached_property
    def price(self) -> DataFrame:
        li = self.table("lineitem")
        stepped = (20000 * F.floor(F.max("l_extendedprice") / 20000) + 100).cast("decimal(18,2)")
        return (dealt_groups(li, ["l_partkey", "l_shipdate"], stepped.alias("price"))
                .select(F.col("l_partkey").alias("menu_item_id"), F.col("l_shipdate").alias("ts"), "price"))

    # ---- referential holes ---------------------------------------------------
    @cached_property
    def menu_holes(self) -> DataFrame:
        return self.menu.filter(F.col("product_id") % MENU_HOLE != 0)

    @cached_property
    def stock_holes(self) -> DataFrame:
        return self.stock.filter(F.col("ingredient_id") % STOCK_HOLE != 0)

    @cached_property
    def stock_low_holes(self) -> DataFrame:
        return self.stock_low.filter(F.col("ingredient_id") % STOCK_HOLE != 0)

    @cached_property
    def customers_holes(self) -> DataFrame:
        c = self.table("customer")
        return (c.filter(F.col("c_custkey") % CUSTOMER_HOLE != 0)
                .select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


# ---------------------------------------------------------------------------
# DuckDB text of the same views, for the oracle.  Keys are view names; each
# entry lists the views it depends on.
_SQL = {
    "v_orders": ((), """
        select o_orderkey as order_id, o_custkey as customer_id,
               case o_orderstatus when 'O' then 'open' when 'F' then 'closed' else 'processing' end as status,
               cast(o_totalprice as decimal(18,2)) as total_amount, o_orderdate as created_at
        from orders"""),
    "v_orders_named": (("v_orders",), """
        select o.*, c.c_name as customer_name
        from v_orders o left join customer c on c.c_custkey = o.customer_id"""),
    "v_items": ((), """
        select l_orderkey as order_id, l_partkey as product_id, cast(l_quantity as int) as quantity,
               row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
                                  l_quantity, l_extendedprice, l_shipdate) as pos
        from lineitem"""),
    "v_items_priced": ((), """
        select l_orderkey as order_id, l_partkey as product_id, cast(l_quantity as int) as quantity,
               cast(l_extendedprice as decimal(18,2)) as unit_price,
               row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
                                  l_quantity, l_extendedprice, l_shipdate) as pos
        from lineitem"""),
    "v_menu": ((), """
        select p_partkey as product_id, p_name as name, concat(p_brand, ' ', p_type) as description,
               p_type as category, cast(p_retailprice as decimal(18,2)) as price
        from part"""),
    "v_bom": ((), """
        select p_partkey as menu_item_id, (p_partkey + 7 * k) % n as inventory_id,
               cast(1 + (p_partkey + k) % 3 as decimal(10,2)) as quantity, k + 1 as pos
        from part, (select unnest([0, 1, 2]) as k) ks, (select count(*) as n from supplier) sc"""),
    "v_stock": ((), """
        select s_suppkey as ingredient_id, s_name as name,
               cast(50000 + 1000 * (s_suppkey % 7) as decimal(18,2)) as quantity, 'unit' as unit
        from supplier"""),
    "v_stock_low": ((), """
        select s_suppkey as ingredient_id, cast(60 + 15 * (s_suppkey % 7) as decimal(18,2)) as quantity
        from supplier"""),
    "v_ledger": ((), """
        select event_id, user_id as inventory_id,
               case when event_type = 'signup' then 'adjustment'
                    when event_type in ('view', 'click') then 'increment' else 'decrement' end as transaction_type,
               cast(value as decimal(18,2)) as quantity, ts
        from events"""),
    "v_status": ((), "select event_id, user_id as order_id, event_type as status, ts from events"),
    "v_price": ((), """
        select l_partkey as menu_item_id, l_shipdate as ts,
               cast(20000 * floor(max(l_extendedprice) / 20000) + 100 as decimal(18,2)) as price
        from lineitem group by l_partkey, l_shipdate"""),
    "v_menu_holes": (("v_menu",), f"select * from v_menu where product_id % {MENU_HOLE} <> 0"),
    "v_stock_holes": (("v_stock",), f"select * from v_stock where ingredient_id % {STOCK_HOLE} <> 0"),
    "v_stock_low_holes": (("v_stock_low",), f"select * from v_stock_low where ingredient_id % {STOCK_HOLE} <> 0"),
    "v_customers_holes": ((), f"select c_custkey as id, c_name as name from customer where c_custkey % {CUSTOMER_HOLE} <> 0"),
}


def cte(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause defining the named views (and their dependencies) in order.

    ``extra`` appends query-specific (name, sql) pairs after the views.
    """
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in _SQL[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} as ({_SQL[n][1]})" for n in order]
    parts += [f"{n} as ({sql})" for n, sql in (extra or [])]
    return "with " + ",\n".join(parts) + "\n" if parts else ""
