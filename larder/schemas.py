"""Schemas of the reference's entities (nested documents and relational rows)."""

from pyspark.sql import types as T

def order_doc(ids: T.DataType) -> T.StructType:
    """Nested order document (created_at kept as the reference's UTC text) with ids of this type."""
    item = T.StructType([T.StructField("product_id", ids), T.StructField("quantity", T.IntegerType())])
    return T.StructType([
        T.StructField("order_id", ids),
        T.StructField("customer_name", T.StringType()),
        T.StructField("items", T.ArrayType(item)),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ])


def menu_doc(ids: T.DataType) -> T.StructType:
    """Nested menu document with ids of this type; ingredient quantities keep six decimals."""
    part = T.StructType([T.StructField("ingredient_id", ids), T.StructField("quantity", T.DecimalType(18, 6))])
    return T.StructType([
        T.StructField("product_id", ids),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("price", T.DecimalType(18, 2)),
        T.StructField("ingredients", T.ArrayType(part)),
    ])


def inventory(ids: T.DataType) -> T.StructType:
    """Inventory rows with ids of this type."""
    return T.StructType([
        T.StructField("ingredient_id", ids),
        T.StructField("name", T.StringType()),
        T.StructField("quantity", T.DecimalType(18, 2)),
        T.StructField("unit", T.StringType()),
    ])


# Documents and files of the reference have string ids.
ORDER_DOC, MENU_DOC, INVENTORY = order_doc(T.StringType()), menu_doc(T.StringType()), inventory(T.StringType())

# Fixed values from the reference's schema.
ORDER_STATUS_ENUM = ("pending", "processing", "completed", "cancelled", "closed")
TRANSACTION_TYPE_ENUM = ("increment", "decrement", "adjustment")
