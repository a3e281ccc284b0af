"""Keyed batch merges: the batch form of the reference's CRUD calls.

Each merge takes a base snapshot and a batch of changes and returns the new
snapshot plus a rejects DataFrame ``(key, reason)`` - never an exception per
row.  Every step is a join on the key (shuffle on the key once; AQE may
broadcast a side that turns out small at runtime); nothing goes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _reject(df: DataFrame, key: str, reason: str) -> DataFrame:
    return df.select(F.col(key), F.lit(reason).alias("reason"))


def one_change_per_key(batch: DataFrame, key: str, order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Enforce the precondition "at most one change per key".

    With ``order_col`` the latest change per key wins (``max_by`` aggregate,
    partially aggregated, so a hot key is combined map-side).  Without it,
    every copy of a repeated key is rejected as ``duplicate_in_batch``.
    Returns (clean batch, rejects).
    """
    if order_col is not None:
        cols = [c for c in batch.columns if c != key]
        latest = (batch.groupBy(key)
                  .agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("_r"))
                  .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]))
        return latest, batch.limit(0).select(F.col(key), F.lit("").alias("reason"))
    dup = batch.groupBy(key).count().filter("count > 1").select(key)
    clean = batch.join(dup, key, "left_anti")
    return clean, _reject(batch.join(dup, key, "left_semi"), key, "duplicate_in_batch")


def merge_insert(base: DataFrame, batch: DataFrame, key: str, valid: Column | None = None,
                 order_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M1: validate, reject keys that exist, append the rest.

    Returns (snapshot, accepted, rejects).  ``valid`` is a boolean column over
    the batch (V1 / V3); NULL counts as invalid.  ``order_col``: keep the
    latest change of a repeated key instead of rejecting its copies.
    """
    batch, dups = one_change_per_key(batch, key, order_col)
    ok = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    checked = batch.withColumn("_ok", ok)
    invalid = _reject(checked.filter(~F.col("_ok")), key, "invalid")
    good = checked.filter(F.col("_ok")).drop("_ok")
    exists = _reject(good.join(base.select(key), key, "left_semi"), key, "exists")
    accepted = good.join(base.select(key), key, "left_anti")
    snapshot = base.unionByName(accepted.select(*base.columns))
    return snapshot, accepted, dups.unionByName(invalid).unionByName(exists)


def merge_replace(base: DataFrame, batch: DataFrame, key: str, valid: Column | None = None,
                  stamp: Column | None = None, stamp_col: str = "updated_at",
                  order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace the whole row of existing keys; unknown keys and invalid rows are rejected.

    With ``stamp`` (M9) the replaced rows get ``stamp_col = stamp`` - even
    when nothing changed, as the reference's BEFORE UPDATE trigger does.
    Returns (snapshot, rejects).
    """
    batch, dups = one_change_per_key(batch, key, order_col)
    ok = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    checked = batch.withColumn("_ok", ok)
    invalid = _reject(checked.filter(~F.col("_ok")), key, "invalid")
    good = checked.filter(F.col("_ok")).drop("_ok")
    missing = _reject(good.join(base.select(key), key, "left_anti"), key, "not_found")
    cols = [c for c in base.columns if c != key and c in good.columns]
    new = good.select(key, F.lit(True).alias("_m"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    j = base.join(new, key, "left")
    matched = F.coalesce(F.col("_m"), F.lit(False))
    out = []
    for c in base.columns:
        if c == key:
            out.append(F.col(key))
        elif stamp is not None and c == stamp_col:
            out.append(F.when(matched, stamp).otherwise(F.col(c)).alias(c))
        elif c in cols:
            out.append(F.when(matched, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out), dups.unionByName(invalid).unionByName(missing)


def merge_quantity(base: DataFrame, batch: DataFrame, key: str = "ingredient_id",
                   qty: str = "quantity", stamp: Column | None = None,
                   stamp_col: str = "updated_at", order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Set only ``quantity`` (and the update stamp) of existing keys; no validation.

    Name and unit are untouched.  Unknown keys are rejected.
    """
    batch, dups = one_change_per_key(batch.select(key, qty, *([order_col] if order_col else [])), key, order_col)
    batch = batch.select(key, qty)
    missing = _reject(batch.join(base.select(key), key, "left_anti"), key, "not_found")
    new = batch.select(key, F.col(qty).alias("_nq"), F.lit(True).alias("_m"))
    j = base.join(new, key, "left")
    matched = F.coalesce(F.col("_m"), F.lit(False))
    out = []
    for c in base.columns:
        if c == qty:
            out.append(F.when(matched, F.col("_nq")).otherwise(F.col(c)).alias(c))
        elif stamp is not None and c == stamp_col:
            out.append(F.when(matched, stamp).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out), dups.unionByName(missing)


def merge_delete(base: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """M3: remove rows by key; keys that are absent are rejected."""
    k = keys.select(key).distinct()
    return (base.join(k, key, "left_anti"),
            _reject(k.join(base.select(key), key, "left_anti"), key, "not_found"))


def stamp_updated_at(df: DataFrame, touched: Column, ts: Column, col: str = "updated_at") -> DataFrame:
    """M9: touched rows get the batch timestamp (passed in, so reruns are repeatable)."""
    return df.withColumn(col, F.when(touched, ts).otherwise(F.col(col)))


# ---- J8 -------------------------------------------------------------------
@dataclass(frozen=True)
class ChildRef:
    """A foreign key from ``df.fk`` to the parent key, with its ON DELETE action."""
    name: str
    df: DataFrame
    fk: str
    action: str  # 'cascade' | 'restrict' | 'set_null'


def delete_effects(parents: DataFrame, key: str, children: list[ChildRef]) -> dict[str, DataFrame]:
    """What deleting ``parents`` does to their children.

    A parent with any RESTRICT child is *blocked* and stays (with its
    children).  For the others, CASCADE children are deleted and SET NULL
    children get their key nulled.  Returns DataFrames ``summary`` (one row
    per requested parent), ``blocked``, ``deleted`` and, per child,
    ``cascade:<name>`` / ``set_null:<name>`` rows.
    """
    p = parents.select(key).distinct()
    out: dict[str, DataFrame] = {}
    blockers = []
    for ch in children:
        if ch.action == "restrict":
            c = (ch.df.filter(F.col(ch.fk).isNotNull())
                 .groupBy(F.col(ch.fk).alias(key)).agg(F.count(F.lit(1)).alias("n")))
            blockers.append(p.join(c, key).select(key, F.col("n").alias(f"restrict_{ch.name}")))
    blocked_keys = None
    for b in blockers:
        k = b.select(key)
        blocked_keys = k if blocked_keys is None else blocked_keys.unionByName(k)
    blocked = (blocked_keys.distinct() if blocked_keys is not None
               else p.limit(0))
    deleted = p.join(blocked, key, "left_anti")
    out["blocked"], out["deleted"] = blocked, deleted
    summary = p.join(blocked.withColumn("blocked", F.lit(True)), key, "left") \
               .withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    for ch in children:
        cnt = (ch.df.filter(F.col(ch.fk).isNotNull())
               .groupBy(F.col(ch.fk).alias(key)).agg(F.count(F.lit(1)).alias(f"n_{ch.name}")))
        summary = summary.join(cnt, key, "left").withColumn(f"n_{ch.name}", F.coalesce(f"n_{ch.name}", F.lit(0)))
        if ch.action == "cascade":
            out[f"cascade:{ch.name}"] = ch.df.join(deleted.withColumnRenamed(key, ch.fk), ch.fk, "left_semi")
        elif ch.action == "set_null":
            hit = deleted.select(F.col(key).alias(ch.fk), F.lit(True).alias("_hit"))
            out[f"set_null:{ch.name}"] = (ch.df.join(hit, ch.fk, "left")
                                          .withColumn(ch.fk, F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(ch.fk)))
                                          .drop("_hit"))
    out["summary"] = summary
    return out
