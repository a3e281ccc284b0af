"""Stream = batch over several files; plan shape checks; the driver contract."""

import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from larder.operators import history
from larder.session import scratch_path
from larder.sources import files
from larder.streaming import changes as streams


def _split_events(spark, sf, n=4):
    d = tempfile.mkdtemp(prefix="larder-test-events-")
    ev = spark.read.parquet(f"{sf}/events.parquet")
    # several files in time order, so several micro-batches arrive in order
    bounds = ev.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")),
                                           [i / n for i in range(1, n)]).alias("q")).first().q
    lo = None
    for i, hi in enumerate(list(bounds) + [None]):
        c = F.lit(True)
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        if lo is not None:
            c = c & (us > lo)
        if hi is not None:
            c = c & (us <= hi)
        ev.filter(c).coalesce(1).write.parquet(os.path.join(d, f"part{i:02d}"))
        lo = hi
    files = []
    for sub in sorted(os.listdir(d)):
        for f in os.listdir(os.path.join(d, sub)):
            if f.endswith(".parquet"):
                os.link(os.path.join(d, sub, f), os.path.join(d, f"{sub}.parquet"))
                files.append(f)
    return d


def test_stream_equals_batch_over_several_files(spark, sf):
    d = _split_events(spark, sf)
    ev = streams.read_table_stream(spark, d, "part*.parquet", max_files=1)
    st = ev.select("event_id", F.col("user_id").alias("order_id"), F.col("event_type").alias("status"), "ts")
    out = scratch_path(spark, "test", "st1")
    streams.run_to_end(streams.status_history_stream(st), "parquet", scratch_path(spark, "test", "ck"), path=out)
    got = spark.read.parquet(out)
    assert got.filter("late").count() == 0
    batch = history.status_history(spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.col("user_id").alias("order_id"), F.col("event_type").alias("status"), "ts"))
    a = sorted(r.id for r in got.collect())
    b = sorted(r.id for r in batch.collect())
    assert a == b


def test_balance_stream_equals_batch_over_several_files(spark, sf):
    from decimal import Decimal
    d = _split_events(spark, sf)
    ev = streams.read_table_stream(spark, d, "part*.parquet", max_files=1)
    t = F.col("event_type")
    tx = ev.select("event_id", F.col("user_id").alias("inventory_id"),
                   F.when(t == "signup", "adjustment").when(t.isin("view", "click"), "increment")
                   .when(t == "error", "bogus").otherwise("decrement").alias("transaction_type"),
                   F.col("value").cast("decimal(18,2)").alias("quantity"), "ts")
    out = scratch_path(spark, "test", "st2")
    streams.run_to_end(streams.stock_balance_stream(tx, "100.00"), "parquet", scratch_path(spark, "test", "ck3"),
                       path=out)
    got = {r.event_id: r.balance for r in spark.read.parquet(out).collect()}
    raw = spark.read.parquet(f"{sf}/events.parquet")
    batch_tx = raw.select("event_id", F.col("user_id").alias("inventory_id"),
                          F.when(t == "signup", "adjustment").when(t.isin("view", "click"), "increment")
                          .when(t == "error", "bogus").otherwise("decrement").alias("transaction_type"),
                          F.col("value").cast("decimal(18,2)").alias("quantity"), "ts")
    want = {r.event_id: r.balance for r in history.stock_ledger(batch_tx, F.lit(Decimal("100.00"))).collect()}
    assert got == want
    assert any(v is None for v in want.values())     # unknown types really poison some balances


def test_late_event_goes_to_late_output(spark):
    import datetime as dt
    d = tempfile.mkdtemp(prefix="larder-test-late-")
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, 5, "a", t0 + dt.timedelta(hours=2))], "event_id long, order_id long, status string, ts timestamp_ntz") \
        .coalesce(1).write.parquet(os.path.join(d, "b1"))
    spark.createDataFrame([(2, 5, "b", t0)], "event_id long, order_id long, status string, ts timestamp_ntz") \
        .coalesce(1).write.parquet(os.path.join(d, "b2"))
    for sub in ("b1", "b2"):
        f = [x for x in os.listdir(os.path.join(d, sub)) if x.endswith(".parquet")][0]
        os.link(os.path.join(d, sub, f), os.path.join(d, f"{sub}.parquet"))
    ev = streams.read_table_stream(spark, d, "b*.parquet", max_files=1)
    out = scratch_path(spark, "test", "late")
    streams.run_to_end(streams.status_history_stream(ev), "parquet", scratch_path(spark, "test", "ck2"), path=out)
    got = {r.status: r.late for r in spark.read.parquet(out).collect()}
    assert got == {"a": False, "b": True}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batch_plans_have_no_cartesian_or_python(spark, sf):
    """Every batch key's plan; the streams run Python state functions, and the op keys have tests of their own."""
    for k, fn in E.queries().items():
        if k.startswith(("stream_", "place_", "amend_", "op")) or k == "pipeline":
            continue
        p = _plan(fn(spark, sf))
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
            assert node not in p, (k, node)


def test_admission_walks_bounded_ranges_and_nothing_else_in_python(spark, sf, monkeypatch):
    """Every table that admission writes is made by joins, windows and aggregates by key, but for the walk, which goes by range."""
    from larder.fixtures import Views
    from larder.functions import scan
    from larder.operators import stock
    from larder.plans import admission

    plans, sizes, write, cut = [], [], admission.materialize, scan.ranges

    def keep(df, *tag):
        plans.append((tag, _plan(df)))
        return write(df, *tag)

    def ranged(*a):
        out = cut(*a)
        sizes.append([r["count"] for r in out.groupBy("_bucket").count().collect()])
        return out

    monkeypatch.setattr(admission, "materialize", keep)
    monkeypatch.setattr(scan, "ranges", ranged)
    v = Views(spark, sf)
    arr = v.orders.filter("order_id % 5 = 0").select("order_id", F.col("created_at").alias("arrival_ts"), F.col("order_id").alias("arrival_seq"))
    low = v.stock.withColumn("quantity", (F.col("quantity") / 20).cast("decimal(18,2)"))
    _, _, rounds = admission.admit_in_order(stock.ingredient_demand(v.items_plain, v.bom).join(arr.select("order_id"), "order_id", "left_semi"), arr, low, 300)
    assert len(sizes) == rounds and len(sizes[0]) > 5 and max(map(max, sizes)) < 900
    assert sum(tag[-1] == "walked" for tag, _ in plans) == rounds
    for tag, p in plans:
        assert "Python" not in p and "Pandas" not in p and "TakeOrdered" not in p
        assert ("MapInArrow" in p) == (tag[-1] == "walked")


def test_scan_prunes_columns_and_pushes_filters(spark, sf):
    p = _plan(E.queries()["filter_indexed"](spark, sf))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in p


def test_partitioned_write_prunes_folders(spark, sf):
    p = _plan(E.queries()["filter_partitioned"](spark, sf))
    assert "PartitionFilters: [isnotnull(created_at_month" in p
    assert "EqualTo(status,closed)" in p


def test_entry_and_contract(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"product_id", "quantity"}
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)


def test_price_sink_is_idempotent_per_batch(spark):
    import datetime as dt
    from decimal import Decimal
    root = scratch_path(spark, "test", "st3")
    sink = streams.price_history_sink(root)
    t0 = dt.datetime(2024, 1, 1)
    b0 = spark.createDataFrame([(1, t0, Decimal("2")), (1, t0 + dt.timedelta(days=1), Decimal("3"))],
                               "menu_item_id long, ts timestamp_ntz, price decimal(18,2)")
    b1 = spark.createDataFrame([(1, t0 + dt.timedelta(days=2), Decimal("3")), (1, t0 + dt.timedelta(days=3), Decimal("4"))],
                               "menu_item_id long, ts timestamp_ntz, price decimal(18,2)")
    sink(b0, 0)
    sink(b1, 1)
    sink(b1, 1)                                   # a replay of the same batch changes nothing
    log = spark.read.json(f"{root}/_versions")
    assert log.count() == 2
    read = lambda: sorted((r.price, r.effective_to is None) for r in streams.read_price_history(spark, root).collect())
    want = [(Decimal("2.00"), False), (Decimal("3.00"), False), (Decimal("4.00"), True)]
    assert read() == want


def test_price_sink_after_a_crash_and_with_late_rows(spark, monkeypatch):
    """A crash between the data and the log: the replay writes the batch again. Late rows are published, once."""
    import datetime as dt
    from decimal import Decimal

    import pytest

    from larder.sources import files
    root, late = scratch_path(spark, "test", "st3"), scratch_path(spark, "test", "late")
    sink = streams.price_history_sink(root, late)
    t0 = dt.datetime(2024, 1, 1)
    kinds = "menu_item_id long, ts timestamp_ntz, price decimal(18,2)"
    b0 = spark.createDataFrame([(1, t0 + dt.timedelta(days=1), Decimal("2"))], kinds)
    b1 = spark.createDataFrame([(1, t0 + dt.timedelta(days=2), Decimal("3")), (1, t0, Decimal("9")), (2, t0, Decimal("5"))], kinds)
    sink(b0, 0)
    publish = files._publish
    with monkeypatch.context() as m:
        m.setattr(files, "_publish", lambda spark, where, *rest: publish(spark, where, *rest) if where == late else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sink(b1, 1)
    sink(b1, 1)
    sink(b1, 1)
    got = sorted((r.menu_item_id, r.price, r.effective_to is None) for r in streams.read_price_history(spark, root).collect())
    assert got == [(1, Decimal("2.00"), False), (1, Decimal("3.00"), True), (2, Decimal("5.00"), True)]
    assert [tuple(r) for r in streams.read_all_versions(spark, late).select("menu_item_id", "price").collect()] == [(1, Decimal("9.00"))]


def test_popular_stream_over_several_files_equals_batch(spark, sf):
    from larder.fixtures import Views
    from larder.operators import sales
    from larder.sources import files
    d = tempfile.mkdtemp(prefix="larder-test-items-")
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    for i in range(3):
        li.filter(F.col("l_orderkey") % 3 == i).coalesce(1).write.parquet(os.path.join(d, f"p{i}"))
        f = [x for x in os.listdir(os.path.join(d, f"p{i}")) if x.endswith(".parquet")][0]
        os.link(os.path.join(d, f"p{i}", f), os.path.join(d, f"p{i}.parquet"))
    v = Views(spark, sf)
    stream = streams.read_table_stream(spark, d, "p*.parquet", max_files=1)
    items = stream.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
                          F.col("l_quantity").cast("int").alias("quantity"))
    root = scratch_path(spark, "test", "st4")
    streams.run_to_end(streams.popular_items_stream(items, v.orders), streams.snapshot_sink(root),
                       scratch_path(spark, "test", "ck4"), mode="complete")
    assert spark.read.json(f"{root}/_versions").count() == 3           # one version per micro-batch
    got = sorted(tuple(r) for r in files.read_snapshot(spark, root).select("product_id", "quantity").collect())
    want = sorted(tuple(r) for r in sales.popular_items(v.orders, v.items_plain).collect())
    assert got == want


def _files(spark, d, batches, schema):
    """One file a batch, in order."""
    for k, rows in enumerate(batches):
        sub = os.path.join(d, f"b{k}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(sub)
        f = [x for x in os.listdir(sub) if x.endswith(".parquet")][0]
        os.link(os.path.join(sub, f), os.path.join(d, f"b{k}.parquet"))
        os.utime(os.path.join(d, f"b{k}.parquet"), (1_700_000_000 + 10 * k,) * 2)


def test_streams_put_rows_in_order_within_the_delay(spark):
    """Text ids; rows up to the delay out of order give what the batch gives, later ones are late; idle keys are forgotten."""
    import datetime as dt
    import random
    from decimal import Decimal
    from larder.streaming import keyed

    t0, rnd = dt.datetime(2024, 1, 1), random.Random(2)
    schema = "event_id string, order_id string, status string, ts timestamp_ntz, transaction_type string, quantity decimal(18,3)"
    rows = [(f"e{i:03d}", rnd.choice(["a", "b", None]), rnd.choice(["x", "y", None]), t0 + dt.timedelta(minutes=10 * i),
             rnd.choice(["increment", "decrement", "adjustment"]), Decimal(rnd.randint(1, 9000)) / 1000) for i in range(60)]
    order = sorted(range(60), key=lambda i: i + rnd.uniform(0, 6))     # at most an hour out of order
    batches = [[rows[i] for i in order[k: k + 15]] for k in range(0, 60, 15)]
    late = ("late", "a", "z", t0 + dt.timedelta(minutes=1), "adjustment", Decimal("1.000"))
    d = tempfile.mkdtemp(prefix="larder-test-order-")
    _files(spark, d, [*batches[:3], [*batches[3], late]], schema)
    keyed.end_stream(spark.createDataFrame([], schema).schema, os.path.join(d, "end"), "ts", spark)
    f = [x for x in os.listdir(os.path.join(d, "end")) if x.endswith(".parquet")][0]
    os.link(os.path.join(d, "end", f), os.path.join(d, "b9.parquet"))
    batch = spark.createDataFrame(rows, schema)
    ev = streams.read_table_stream(spark, d, "b*.parquet", max_files=1)
    out = scratch_path(spark, "test", "order")
    streams.run_to_end(streams.status_history_stream(ev, delay="1 hour"), "parquet", scratch_path(spark, "test", "ck"), path=out)
    got = spark.read.parquet(out)
    assert [r.status for r in got.filter("late").collect()] == ["z"]
    assert sorted(r.id for r in got.filter("not late").collect()) == sorted(r.id for r in history.status_history(batch).collect())
    tx = ev.withColumnRenamed("order_id", "inventory_id")
    out = scratch_path(spark, "test", "order")
    streams.run_to_end(streams.stock_balance_stream(tx, "5", delay="1 hour"), "parquet", scratch_path(spark, "test", "ck"), path=out)
    got = {r.event_id: r.balance for r in spark.read.parquet(out).filter("not late").collect()}
    want = history.stock_ledger(batch.withColumnRenamed("order_id", "inventory_id"), F.lit(Decimal(5)))
    assert got == {r.event_id: r.balance for r in want.collect()}


def test_idle_keys_are_forgotten(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    d = tempfile.mkdtemp(prefix="larder-test-idle-")
    _files(spark, d, [[("1", "a", "x", t0), ("2", "b", "x", t0)], [("3", "b", "x", t0 + dt.timedelta(hours=5))], [("4", "c", "x", t0 + dt.timedelta(days=3))],
                      [("5", "a", "x", t0 + dt.timedelta(days=3, hours=1)), ("6", "c", "x", t0 + dt.timedelta(days=3, hours=1))]],
           "event_id string, order_id string, status string, ts timestamp_ntz")
    for idle, want in ((None, ["1", "2", "4"]), ("1 day", ["1", "2", "4", "5"])):
        ev = streams.read_table_stream(spark, d, "b*.parquet", max_files=1)
        out = scratch_path(spark, "test", "idle")
        streams.run_to_end(streams.status_history_stream(ev, idle=idle), "parquet", scratch_path(spark, "test", "ck"), path=out)
        assert sorted(r.id.rsplit("_", 1)[1] for r in spark.read.parquet(out).collect()) == want


def test_ordered_streams_keep_many_keys_in_a_state_key(spark, monkeypatch):
    """200 keys and NULL, large ids and NULL ones, a key's far row that waits longer than its bucket's others: the state keys are buckets."""
    import datetime as dt
    import random
    from decimal import Decimal
    from larder.streaming import keyed

    rnd, t0 = random.Random(7), dt.datetime(2024, 1, 1)
    schema = "event_id long, inventory_id long, transaction_type string, quantity decimal(18,3), ts timestamp_ntz"
    ids = [None, *(10**17 + i for i in range(200))]
    rows = [(None if i == 77 else 10**17 + i, rnd.choice(ids), rnd.choice(["increment", "decrement", "adjustment"]), Decimal(rnd.randint(1, 9000)) / 1000,
             t0 + dt.timedelta(minutes=i)) for i in range(900)]
    batches = [rows[:300], rows[300:600], rows[600:]]
    batches[0] = batches[0][:-1] + [rows[899]]     # far ahead of its batch, within the delay
    batches[2] = batches[2][:-1] + [rows[299]]     # as late as the delay lets it be
    d = tempfile.mkdtemp(prefix="larder-test-buckets-")
    _files(spark, d, batches, schema)
    keyed.end_stream(spark.createDataFrame([], schema).schema, os.path.join(d, "end"), "ts", spark)
    f = [x for x in os.listdir(os.path.join(d, "end")) if x.endswith(".parquet")][0]
    os.link(os.path.join(d, "end", f), os.path.join(d, "b9.parquet"))
    monkeypatch.setattr(keyed, "KEY_BUCKETS", 8)
    got = streams.stock_balance_stream(streams.read_table_stream(spark, d, "b*.parquet", 1), "5", delay="11 hours")
    assert "bucket" in [x for x in got._jdf.queryExecution().analyzed().toString().split("\n") if "TransformWithState" in x][0]
    out = scratch_path(spark, "test", "buckets")
    streams.run_to_end(got, "parquet", scratch_path(spark, "test", "ck"), path=out)
    got = sorted((r.event_id or 0, r.inventory_id or 0, r.balance, r.late) for r in spark.read.parquet(out).collect())
    want = history.stock_ledger(spark.createDataFrame(rows, schema), F.lit(Decimal(5))).collect()
    assert got == sorted((r.event_id or 0, r.inventory_id or 0, r.balance, False) for r in want)


def test_orders_that_close_later_or_open_again_change_the_totals(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    at = [t0 + dt.timedelta(days=k) for k in range(9)]
    lines, heads = tempfile.mkdtemp(prefix="larder-test-lines-"), tempfile.mkdtemp(prefix="larder-test-heads-")
    _files(spark, lines, [[("o1", "p", 2), ("o2", "p", 3), ("o3", "q", 7)], [("o1", "q", 5)], [("o3", "p", 1)], [("o2", "r", 4)]], "order_id string, product_id string, quantity int")
    _files(spark, heads, [[("o1", "open", at[0]), ("o3", "closed", at[1])], [("o2", "closed", at[2])], [("o1", "closed", at[3]), ("o3", "closed", at[0])],
                          [("o3", "open", at[4]), ("o2", "processing", at[1])]], "order_id string, status string, ts timestamp_ntz")
    for compact in (2, 100):
        root = scratch_path(spark, "test", "st4")
        changes = streams.popular_changes_stream(streams.read_table_stream(spark, lines, "b*.parquet", 1), streams.read_table_stream(spark, heads, "b*.parquet", 1))
        streams.run_to_end(changes, streams.totals_sink(root, compact=compact), scratch_path(spark, "test", "ck"))
        got = {r.product_id: (r.quantity, r.lines) for r in streams.read_totals(spark, root).collect()}
        assert got == {"p": (5, 2), "q": (5, 1), "r": (4, 1)}


def test_popular_changes_keep_many_orders_in_a_state_key(spark, monkeypatch):
    """Statuses and lines of 300 orders and of NULL in any order over batches; the state keys are buckets, not orders, and lines meet flips in a join."""
    import datetime as dt
    import random
    rnd, t0 = random.Random(5), dt.datetime(2024, 1, 1)
    ids = [None, *(10**17 + i for i in range(300))]
    heads = [(o, s, t) for o in ids for s, t in zip(rnd.sample(["open", "closed", "processing", None, "closed "], 3), rnd.sample([None, *(t0 + dt.timedelta(days=i) for i in range(4))], 3), strict=True)]
    heads += [(o, "closed", t0 + dt.timedelta(days=9)) for o in ids[::2]]
    lines = [(o, rnd.randrange(7), rnd.choice([None, 1, 2, 3])) for o in ids for _ in range(3)]
    latest = {}
    for o, s, t in heads:
        if t is not None and (o not in latest or t > latest[o][0]):
            latest[o] = (t, s)
    want = {}
    for o, p, q in lines:
        if latest.get(o, (0, ""))[1] == "closed":
            had = want.get(p, (0, 0))
            want[p] = had[0] + (q or 0), had[1] + 1
    rnd.shuffle(heads)
    rnd.shuffle(lines)
    a, b = tempfile.mkdtemp(prefix="larder-test-lines-"), tempfile.mkdtemp(prefix="larder-test-heads-")
    _files(spark, a, [lines[k::3] for k in range(3)], "order_id long, product_id long, quantity int")
    _files(spark, b, [heads[k::3] for k in range(3)], "order_id long, status string, ts timestamp_ntz")
    monkeypatch.setattr(streams, "ORDER_BUCKETS", 16)
    root = scratch_path(spark, "test", "st4")
    changes = streams.popular_changes_stream(streams.read_table_stream(spark, a, "b*.parquet", 1), streams.read_table_stream(spark, b, "b*.parquet", 1))
    plan = changes._jdf.queryExecution().analyzed().toString()
    assert "Join Inner" in plan and "bucket" in [x for x in plan.split("\n") if "TransformWithState" in x][0]
    streams.run_to_end(changes, streams.totals_sink(root), scratch_path(spark, "test", "ck"))
    assert {r.product_id: (r.quantity, r.lines) for r in streams.read_totals(spark, root).collect()} == want


def test_price_log_rows_stay_small(spark, sf):
    import datetime as dt
    from decimal import Decimal
    root = scratch_path(spark, "test", "log")
    sink = streams.price_history_sink(root)
    for k in range(3):
        sink(spark.createDataFrame([(1, dt.datetime(2024, 1, 1 + k), Decimal(k))] if k != 1 else [], "menu_item_id long, ts timestamp_ntz, price decimal(10,2)"), k)
    log = files._log(spark, root).collect()
    assert len(log) == 3 and all("\n" not in r["path"] for r in log)
    assert streams.read_price_history(spark, root).count() == 2
