"""Readers and writers.

Snapshots are never overwritten in place: each write goes to a fresh version
folder and is then *published* by appending one row to the snapshot's log.
Readers resolve the latest published version, so a reader never sees a
half-written snapshot and a writer never deletes files someone is reading.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.schemas import MENU_DOC, ORDER_DOC

_LOG = "_versions"
_LOG_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("fmt", T.StringType()),
    T.StructField("published_ms", T.LongType()),
])


# ---- S1 -------------------------------------------------------------------
def scan_stock(spark: SparkSession, path: str) -> DataFrame:
    """Inventory rows, the four columns the reference selects.

    The projection reaches the parquet reader (ReadSchema has four columns).
    """
    return spark.read.parquet(path).select("ingredient_id", "name", "quantity", "unit")


# ---- S2 / S3 ----------------------------------------------------------------
def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e)


def _read_json(spark: SparkSession, path: str, schema: T.StructType, multiline: bool) -> DataFrame:
    try:
        return spark.read.schema(schema).option("multiLine", multiline).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:          # missing path -> empty list, as the reference
        if _missing(e):
            return spark.createDataFrame([], schema)
        raise


def scan_menu_json(spark: SparkSession, path: str, multiline: bool = False, schema: T.StructType = MENU_DOC) -> DataFrame:
    """Nested menu documents with a declared schema (no inference); ids are strings.

    ``multiline=True`` reads the reference's single JSON-array file; the
    default reads JSON lines as written by ``write_snapshot``.  A missing or
    empty path yields an empty DataFrame; a file that is not valid JSON of
    the schema fails the read, as in the reference.
    """
    return _read_json(spark, path, schema, multiline)


def scan_orders_json(spark: SparkSession, path: str, multiline: bool = False, schema: T.StructType = ORDER_DOC) -> DataFrame:
    """S3: nested order documents, same rules as ``scan_menu_json``."""
    return _read_json(spark, path, schema, multiline)


# ---- S4 -------------------------------------------------------------------
def _log(spark: SparkSession, root: str) -> DataFrame | None:
    """The versions published under ``root``; None if there is no log.  Any other fault is raised."""
    try:
        return spark.read.schema(_LOG_SCHEMA).option("mode", "FAILFAST").json(f"{root.rstrip('/')}/{_LOG}")
    except AnalysisException as e:
        if _missing(e):
            return None
        raise


def _publish(spark: SparkSession, root: str, version: str, paths: list[str], fmt: str) -> None:
    log = spark.createDataFrame([(version, "\n".join(paths), fmt, int(time.time() * 1000))], _LOG_SCHEMA)
    log.coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/{_LOG}")


def _fresh(spark: SparkSession, root: str, version: str | None) -> tuple[str, str, str]:
    """(version, folder, write mode): a named version that was written but never published is written again."""
    named = version is not None
    version = version or f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
    log = _log(spark, root) if named else None
    if log is not None and log.filter(F.col("version") == version).limit(1).count():
        raise FileExistsError(f"version {version} of {root} is published")
    return version, f"{root.rstrip('/')}/v={version}", "overwrite" if named else "errorifexists"


def write_snapshot(df: DataFrame, root: str, fmt: str = "parquet", version: str | None = None) -> str:
    """Write ``df`` as a new version under ``root`` and publish it.

    Returns the version folder.  Nothing published is overwritten; what a
    crash between the two steps left under the same ``version`` is.
    """
    spark = df.sparkSession
    version, path, mode = _fresh(spark, root, version)
    df.write.mode(mode).format(fmt).save(path)
    _publish(spark, root, version, [path], fmt)
    return path


def current_version(spark: SparkSession, root: str) -> tuple[list[str], str] | None:
    """Folders and format of the latest published version of a snapshot root, or None."""
    log = _log(spark, root)
    if log is None:
        return None
    last = log.orderBy(F.col("published_ms").desc(), F.col("version").desc()).select("path", "fmt").first()
    return (last["path"].split("\n"), last["fmt"]) if last else None


def is_published(spark: SparkSession, root: str, version: str) -> bool:
    log = _log(spark, root)
    return log is not None and log.filter(F.col("version") == version).limit(1).count() > 0


def read_snapshot(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """Read the latest published version of ``root``; empty if nothing is published."""
    cur = current_version(spark, root)
    if cur is None:
        if schema is None:
            raise FileNotFoundError(root)
        return spark.createDataFrame([], schema)
    paths, fmt = cur
    r = spark.read.format(fmt)
    if schema is not None and fmt == "json":
        r = r.schema(schema)
    return r.load(paths)


def add_folders(df: DataFrame, root: str, version: str, column: str) -> str:
    """Write ``df``, split by the boolean ``column``, as a version of its own folder; readers join it with those of the versions before.

    The log gets one row of fixed size.
    """
    spark = df.sparkSession
    version, path, mode = _fresh(spark, root, version)
    df.write.mode(mode).partitionBy(column).parquet(path)
    empty = spark.createDataFrame([], df.drop(column).schema)
    for value in ("false", "true"):     # both folders exist, also when empty
        empty.write.mode("append").parquet(f"{path}/{column}={value}")
    _publish(spark, root, version, [path], "parquet")
    return path


def published_folders(spark: SparkSession, root: str, after: str = "") -> list[str]:
    """The folders of all published versions (one row a version), or of those whose names come after ``after``."""
    log = _log(spark, root)
    if log is None:
        return []
    return sorted({p for r in log.filter(F.col("version") > after).select("path").collect() for p in r["path"].split("\n")})


def write_partitioned(df: DataFrame, root: str, ts: str = "created_at", grain: str = "month",
                      version: str | None = None) -> str:
    """S4 with a date partition column (``<ts>_<grain>``), for partition pruning.

    Readers filtering on the partition column skip whole folders
    (``PartitionFilters`` in the plan); filters on ``ts`` itself still use
    the row-group statistics.  Rows are clustered by partition before the
    write so each task writes few files.
    """
    pcol = f"{ts}_{grain}"
    out = df.withColumn(pcol, F.date_trunc(grain, F.col(ts)).cast("date"))
    spark = df.sparkSession
    version, path, mode = _fresh(spark, root, version)
    out.repartition(pcol).write.mode(mode).partitionBy(pcol).parquet(path)
    _publish(spark, root, version, [path], "parquet")
    return path


# ---- S5 -------------------------------------------------------------------
def append_rows(rows: DataFrame, root: str, key: str = "ingredient_id", valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert-only append of inventory rows to the current snapshot.

    Rows that break the inventory rules (V3, or ``valid``), whose key already
    exists or repeats inside the batch are returned as rejects instead of
    failing the batch.  The accepted rows are written as a folder of their
    own; the new version is the old one's folders and this one, so nothing
    published changes.  Returns (accepted, rejects(key, reason)).
    """
    from larder.operators import quality
    from larder.operators.merge import merge_insert  # local: merge imports sources

    spark = rows.sparkSession
    if valid is None:
        valid = quality.holds(quality.stock_rules())
    cur = current_version(spark, root)
    base = read_snapshot(spark, root) if cur else spark.createDataFrame([], rows.schema)
    _, accepted, rejects = merge_insert(base, rows, key, valid)
    # appended files must carry exactly the snapshot's column types, or the folders become unreadable together
    accepted = accepted.select(*[F.col(c).cast(base.schema[c].dataType).alias(c) for c in base.columns])
    if cur is None:
        write_snapshot(accepted, root)
    else:
        paths, fmt = cur
        version, path, mode = _fresh(spark, root, None)
        accepted.write.mode(mode).format(fmt).save(path)
        _publish(spark, root, version, [*paths, path], fmt)
        accepted = spark.read.format(fmt).schema(accepted.schema).load(path)
    return accepted, rejects


# ---- S6 -------------------------------------------------------------------
def report_json(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One JSON text per row with the declared field names.

    ``names`` maps column -> JSON name (the reference's total-sales field is
    literally ``"total_sales: "``).
    """
    names = names or {}
    return df.select(F.to_json(F.struct(*[F.col(c).alias(names.get(c, c)) for c in df.columns])).alias("json"))

