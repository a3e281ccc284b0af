"""Validation and data quality.

Every check returns violation rows ``(table, rule, key)`` - never an
exception per row - and can also return the clean rows.  All rules of one
table are evaluated in a single pass: an array of ``when(violated, rule)``
per row, NULLs filtered out, exploded.  Keys are rendered as text
(composite keys joined with ``|``) so checks over different tables union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.grouping import dealt_groups
from larder.functions.scalar import blank, non_positive


def key_text(cols: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def violations(df: DataFrame, table: str, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One pass over ``df``: a row per (violated rule) -> (table, rule, key)."""
    hits = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]),
                    lambda x: x.isNotNull())
    # the plain condition first, so that it can reach the scan
    return (df.filter(~holds(rules)).select(key_text(key).alias("key"), F.explode(hits).alias("rule"))
            .select(F.lit(table).alias("table"), "rule", "key"))


def holds(rules: dict[str, Column]) -> Column:
    """True for rows breaking none of ``rules``."""
    bad = F.lit(False)
    for c in rules.values():
        bad = bad | F.coalesce(c, F.lit(False))
    return ~bad


# ---- V1-V3: the application's validators (Go zero values: NULL == "" == 0) ----
def menu_rules() -> dict[str, Column]:
    """V1: price <= 0; empty name or description; any ingredient with empty id or quantity <= 0.

    An empty product id and an empty ingredient list are allowed.
    """
    return {
        "price_not_positive": non_positive("price"),
        "name_empty": blank("name"),
        "description_empty": blank("description"),
        "ingredient_invalid": F.exists("ingredients", lambda x: blank(x["ingredient_id"]) | non_positive(x["quantity"])),
    }


def order_rules() -> dict[str, Column]:
    """V2: status closed; empty customer name; any item with empty product or quantity <= 0.

    Zero items is valid.
    """
    return {
        "status_closed": F.col("status") == "closed",
        "customer_empty": blank("customer_name"),
        "item_invalid": F.exists("items", lambda x: blank(x["product_id"]) | non_positive(x["quantity"])),
    }


def stock_rules() -> dict[str, Column]:
    """V3: empty ingredient id, quantity <= 0."""
    return {"ingredient_id_empty": blank("ingredient_id"), "quantity_not_positive": non_positive("quantity")}


def invalid_menu(menu_docs: DataFrame) -> DataFrame:
    return violations(menu_docs, "menu", ["product_id"], menu_rules())


def invalid_orders(order_docs: DataFrame) -> DataFrame:
    return violations(order_docs, "orders", ["order_id"], order_rules())


def invalid_stock(stock: DataFrame) -> DataFrame:
    return violations(stock, "inventory", ["ingredient_id"], stock_rules())


# ---- V4-V6: the schema's constraints (SQL semantics: NULL passes a CHECK) -----
def check(cond: Column) -> Column:
    """A CHECK constraint is violated only when its condition is FALSE (NULL passes)."""
    return F.coalesce(~cond, F.lit(False))


def not_null(col: str) -> Column:
    return F.col(col).isNull()


def in_domain(col: str, domain: tuple[str, ...]) -> Column:
    """Value outside the enum; NULL is left to the NOT NULL rule."""
    return F.col(col).isNotNull() & ~F.col(col).isin(*domain)


def apply_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """V7: add the defaulted columns that are *absent*; an explicit NULL is kept (as SQL does)."""
    for c, v in defaults.items():
        if c not in df.columns:
            df = df.withColumn(c, v)
    return df


# ---- A6, J7 -------------------------------------------------------------------
def key_duplicates(df: DataFrame, table: str, key: list[str], nulls_allowed: bool = False) -> DataFrame:
    """Keys held by more than one row -> (table, key, n).

    ``nulls_allowed`` is the UNIQUE rule (NULLs never collide); a primary
    key treats every row.  A hot key is aggregated partially first, so it
    shuffles one row per map task; a task's groups stay few as the table grows.
    """
    if nulls_allowed:
        cond = None
        for c in key:
            cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
        df = df.filter(cond)
    return (dealt_groups(df, key, F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
            .select(F.lit(table).alias("table"), key_text(key).alias("key"), "n"))


def fk_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, name: str) -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent -> (fk, ref).

    Anti join on the key; NULL foreign keys pass.
    """
    p = parent.select(F.col(pk).alias(fk))
    return (child.filter(F.col(fk).isNotNull()).join(p, fk, "left_anti")
            .select(F.lit(name).alias("fk"), F.col(fk).cast("string").alias("ref")))
