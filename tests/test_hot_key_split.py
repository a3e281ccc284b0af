"""The bucketed scans must give the same answer however finely a key is split,
also for NULL keys, NULL times and a key whose rows come in one burst."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from larder.fixtures import Views
from larder.functions import scan
from larder.operators import history, stock
from larder.plans.admission import admit_in_order


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ledger_status_price_split_equals_unsplit(spark, sf):
    v = Views(spark, sf)
    op = F.lit(Decimal("100.00"))
    for t in (50,):
        assert _rows(history.stock_ledger(v.ledger, op, target_rows=t), ["event_id", "balance"]) == \
            _rows(history.stock_ledger(v.ledger, op), ["event_id", "balance"])
        assert _rows(history.status_history(v.status, target_rows=t), ["id"]) == \
            _rows(history.status_history(v.status), ["id"])
        cols = ["id", "price", "effective_from", "effective_to"]
        ph = history.price_history(v.price, target_rows=t)
        assert _rows(ph, cols) == _rows(history.price_history(v.price), cols)
        ev = v.items.join(v.orders.select("order_id", "created_at"), "order_id")
        a = history.price_as_of(ev, ph, target_rows=t)
        b = history.price_as_of(ev, history.price_history(v.price))
        assert _rows(a, ["order_id", "pos", "price"]) == _rows(b, ["order_id", "pos", "price"])


def test_one_hot_key_is_split(spark):
    """A key with two thirds of all rows, nearly all of them at one time, spreads over near equal buckets."""
    t0 = dt.datetime(2024, 1, 1)
    rng = random.Random(3)
    rows = [(i, 0 if i % 3 else rng.randrange(1, 5), t0 + dt.timedelta(days=400 if i == 599 else 0, minutes=i % 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, k long, ts timestamp_ntz").withColumn("v", F.lit(1))
    b = scan.ordered(df, ["k"], ["ts", "event_id"], target_rows=50)
    sizes = [r["count"] for r in b.groupBy("_bucket").count().collect()]
    assert max(sizes) <= 100
    assert b.filter("k = 0").select("_bucket").distinct().count() >= 7
    got = scan.running_sums(b, ["k"], ["ts", "event_id"], {"rs": "v"})
    want = {}
    cnt = {}
    for eid, k, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        cnt[k] = cnt.get(k, 0) + 1
        want[eid] = cnt[k]
    assert {r.event_id: r.rs for r in got.collect()} == want


def test_null_keys_and_times_stay(spark):
    """NULL keys are one key, NULL times come first; no row is lost, however fine the buckets."""
    t0 = dt.datetime(2024, 1, 1)
    rng = random.Random(6)
    kinds = ["increment", "decrement", "adjustment", "bogus"]
    rows = [(i, rng.choice([None, 1, 2]), rng.choice([None, t0, t0 + dt.timedelta(hours=rng.randrange(9))]),
             rng.choice(kinds), Decimal(rng.randrange(1, 50)), rng.choice([None, "a", "b"])) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, inventory_id long, ts timestamp_ntz, transaction_type string, quantity decimal(18,2), status string")
    state, ledger, hist, last = {}, {}, set(), {}
    for eid, k, ts, kind, q, st in sorted(rows, key=lambda r: (r[2] is not None, r[2] or t0, r[0])):
        old = state.get(k, Decimal(100))
        new = q if kind == "adjustment" else None if old is None or kind == "bogus" else old + (q if kind == "increment" else -q)
        state[k] = ledger[eid] = new
        if k not in last or last[k] != st:
            hist.add((k, st, ts))
        last[k] = st
    op = F.lit(Decimal("100.00"))
    for t in (3, None):
        got = {r.event_id: r.balance for r in history.stock_ledger(df, op, target_rows=t).collect()}
        assert got == ledger
        assert {r.inventory_id: r.balance for r in history.stock_balance(df, op, target_rows=t).collect()} == state
        got = history.status_history(df.withColumnRenamed("inventory_id", "order_id"), target_rows=t).collect()
        assert {(r.order_id, r.status, r.created_at) for r in got} == hist
        iv = spark.createDataFrame([(1, Decimal(5), t0, None), (None, Decimal(7), t0, None)], "menu_item_id long, price decimal(18,2), effective_from timestamp_ntz, effective_to timestamp_ntz")
        ev = df.select("event_id", F.col("inventory_id").alias("product_id"), F.col("ts").alias("created_at"))
        got = {r.event_id: r.price for r in history.price_as_of(ev, iv, target_rows=t).collect()}
        assert got == {e: (None if ts is None else {1: Decimal(5), None: Decimal(7)}.get(k)) for e, k, ts, *_ in rows}


def test_scans_have_no_window_on_a_bare_key(spark, sf):
    """Without broadcasts, every window over rows is partitioned by key and bucket."""
    v = Views(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (history.stock_ledger(v.ledger), history.status_history(v.status), history.price_history(v.price)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "FlatMapGroups" not in plan and "BroadcastNestedLoop" not in plan
            below = [x for x in plan.split("\n") if "Window " in x and "_edge" in x]
            assert below and all("_bucket" in x for x in below)
        balance = history.stock_balance(v.ledger)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in balance
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_admission_split_equals_unsplit(spark, sf):
    v = Views(spark, sf)
    dem = stock.ingredient_demand(v.items_plain, v.bom)
    arr = v.orders.select("order_id", F.col("created_at").alias("arrival_ts"), F.col("order_id").alias("arrival_seq"))
    a, sa, _ = admit_in_order(dem, arr, v.stock_low, target_rows=400)
    b, sb, _ = admit_in_order(dem, arr, v.stock_low)
    assert _rows(a, ["order_id", "accepted"]) == _rows(b, ["order_id", "accepted"])
    assert _rows(sa, ["ingredient_id", "quantity"]) == _rows(sb, ["ingredient_id", "quantity"])


def test_ledger_poison_crosses_buckets(spark, sf):
    """Unknown transaction types make the balance NULL until the next adjustment, across bucket edges."""
    v = Views(spark, sf)
    t = F.col("transaction_type")
    tx = v.ledger.withColumn("transaction_type",
                             F.when((F.col("event_id") % 11 == 0) & (t != "adjustment"), F.lit("bogus")).otherwise(t))
    op = F.lit(Decimal("100.00"))
    split = _rows(history.stock_ledger(tx, op, target_rows=10), ["event_id", "balance"])
    whole = _rows(history.stock_ledger(tx, op), ["event_id", "balance"])
    assert split == whole
    assert any(b is None for _, b in whole) and any(b is not None for _, b in whole)


def test_groups_are_dealt_into_more_tasks_as_rows_grow(spark):
    """Many keys, a hot key and NULL keys: the groups of ``groupBy``, in tasks of a given number of rows; few rows keep the plain plan."""
    from larder.functions.grouping import dealt_groups
    rows = [(k, None if k % 7 == 0 else k) for k in range(400)] + [(5, 5)] * 300 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "a long, b long")
    n = F.count(F.lit(1)).alias("n")
    want = sorted(map(str, df.groupBy("a", "b").agg(n).collect()))
    dealt = dealt_groups(df, ["a", "b"], n, rows=40)
    assert sorted(map(str, dealt.collect())) == want
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    calm = dealt_groups(df.distinct(), ["a", "b"], n, rows=20)   # no hot key: one aggregate, no plain one beside it
    plan = calm._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Union" not in plan
    assert sorted(map(str, calm.collect())) == sorted(map(str, df.distinct().groupBy("a", "b").agg(n).collect()))
    assert "REPARTITION_BY_NUM" not in dealt_groups(df, ["a", "b"], n)._jdf.queryExecution().executedPlan().toString()


def test_as_of_cuts_times_into_cells_only_where_intervals_overlap(spark, monkeypatch):
    """Half-open intervals, gaps and an overlap: only the time that an earlier interval alone holds is looked up in all of them."""
    t0 = dt.datetime(2024, 1, 1)

    def day(n):
        return None if n is None else t0 + dt.timedelta(days=n)

    iv = [(1, 10, 0, 5), (1, 20, 5, 9), (1, 30, 12, None), (None, 40, 0, None), (2, 50, 0, 3), (2, 60, 3, 3), (1, 70, None, 4)]
    kinds = "menu_item_id long, price long, effective_from timestamp_ntz, effective_to timestamp_ntz"
    plain = [(k, p, day(a), day(b)) for k, p, a, b in iv]
    points = [(1, -1, None), (1, 0, 10), (1, 5, 20), (1, 9, None), (1, 12, 30), (None, 2, 40), (2, 2, 50), (2, 3, None), (1, None, None), (3, 1, None), (1, 0, 10)]
    ev = spark.createDataFrame([(i, k, day(d)) for i, (k, d, _) in enumerate(points)], "event_id long, product_id long, created_at timestamp_ntz")
    asked, real = [], history.interval_matches
    monkeypatch.setattr(history, "interval_matches", lambda p, *a: asked.extend(map(tuple, p.collect())) or real(p, *a))
    for t in (2, None):
        got = {r.event_id: r.price for r in history.price_as_of(ev, spark.createDataFrame(plain, kinds), target_rows=t).collect()}
        assert got == {i: p for i, (_, _, p) in enumerate(points)} and not asked
    over = spark.createDataFrame([*plain, (1, 80, day(0), day(11))], kinds)     # from day 9 on the one that started on day 5 has ended, this one has not
    got = {r.event_id: r.price for r in history.price_as_of(ev, over).collect()}
    assert got == {i: 80 if (k, d) in ((1, 0), (1, 9)) else p for i, (k, d, p) in enumerate(points)}
    assert [k for k, *_ in asked] == [1]
