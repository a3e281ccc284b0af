"""Spark operators against plain-Python sequential folds on random small inputs."""

import collections
import datetime as dt
import random
from decimal import Decimal, localcontext

from pyspark.sql import functions as F

from larder.functions import scan
from larder.operators import history, orders
from larder.plans import admission
from larder.plans.admission import admit_in_order

T0 = dt.datetime(2024, 1, 1)


def _ledger_rows(rng, n_keys=4, n=60):
    types = ["increment", "decrement", "adjustment"]
    rows = []
    for i in range(n):
        rows.append((i, rng.randrange(n_keys), rng.choice(types),
                     Decimal(rng.randrange(1, 5000)) / 100, T0 + dt.timedelta(hours=rng.randrange(0, 24 * 10))))
    return rows


def _fold(rows, opening):
    bal = {}
    out = {}
    for eid, key, t, q, ts in sorted(rows, key=lambda r: (r[4], r[0])):
        b = bal.get(key, opening)
        b = b + q if t == "increment" else b - q if t == "decrement" else q
        bal[key] = b
        out[eid] = b
    return out, bal


def test_stock_ledger_matches_fold(spark):
    schema = "event_id long, inventory_id long, transaction_type string, quantity decimal(18,2), ts timestamp_ntz"
    for seed in range(5):
        rng = random.Random(seed)
        rows = _ledger_rows(rng)
        df = spark.createDataFrame(rows, schema)
        got = {r.event_id: r.balance for r in history.stock_ledger(df, F.lit(Decimal("100.00"))).collect()}
        want, final = _fold(rows, Decimal("100.00"))
        assert got == want
        bal = {r.inventory_id: r.balance for r in history.stock_balance(df, F.lit(Decimal("100.00"))).collect()}
        assert bal == final


def test_ledger_unknown_type_is_null_until_adjustment(spark):
    rows = [(1, 0, "increment", Decimal("5"), T0), (2, 0, "bogus", Decimal("1"), T0 + dt.timedelta(hours=1)),
            (3, 0, "increment", Decimal("2"), T0 + dt.timedelta(hours=2)),
            (4, 0, "adjustment", Decimal("7"), T0 + dt.timedelta(days=3)),
            (5, 0, "decrement", Decimal("1"), T0 + dt.timedelta(days=4))]
    df = spark.createDataFrame(rows, "event_id long, inventory_id long, transaction_type string, "
                                     "quantity decimal(18,2), ts timestamp_ntz")
    got = {r.event_id: r.balance for r in history.stock_ledger(df, F.lit(Decimal("10"))).collect()}
    assert got == {1: Decimal("15.00"), 2: None, 3: None, 4: Decimal("7.00"), 5: Decimal("6.00")}


def test_status_history_matches_fold(spark):
    for seed in range(5):
        rng = random.Random(100 + seed)
        rows = [(i, rng.randrange(3), rng.choice(["a", "b", None]), T0 + dt.timedelta(hours=rng.randrange(200)))
                for i in range(50)]
        df = spark.createDataFrame(rows, "event_id long, order_id long, status string, ts timestamp_ntz")
        got = sorted(r.id for r in history.status_history(df).collect())
        prev, want = {}, []
        for eid, k, st, ts in sorted(rows, key=lambda r: (r[3], r[0])):
            if k not in prev or prev[k] != st:
                want.append(f"{k}_{int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)}_{eid}")
            prev[k] = st
        assert got == sorted(want)


def test_price_history_intervals(spark):
    rows = [(1, T0, Decimal("2")), (1, T0 + dt.timedelta(days=1), Decimal("2")),
            (1, T0 + dt.timedelta(days=40), Decimal("3")), (1, T0 + dt.timedelta(days=90), Decimal("2")),
            (2, T0, Decimal("5"))]
    df = spark.createDataFrame(rows, "menu_item_id long, ts timestamp_ntz, price decimal(10,2)")
    got = sorted((r.menu_item_id, r.price, r.effective_from, r.effective_to)
                 for r in history.price_history(df).collect())
    assert got == [(1, Decimal("2.00"), T0, T0 + dt.timedelta(days=40)),
                   (1, Decimal("2.00"), T0 + dt.timedelta(days=90), None),
                   (1, Decimal("3.00"), T0 + dt.timedelta(days=40), T0 + dt.timedelta(days=90)),
                   (2, Decimal("5.00"), T0, None)]
    # as-of: half-open intervals, events before the first interval get NULL
    ev = spark.createDataFrame([(1, T0 - dt.timedelta(days=1)), (1, T0 + dt.timedelta(days=40)),
                                (1, T0 + dt.timedelta(days=39)), (1, T0 + dt.timedelta(days=400))],
                               "product_id long, created_at timestamp_ntz")
    asof = sorted((r.created_at, r.price) for r in history.price_as_of(ev, history.price_history(df)).collect())
    assert [p for _, p in asof] == [None, Decimal("2.00"), Decimal("3.00"), Decimal("2.00")]


def _sequential_admission(demand, arrival, stock):
    st = dict(stock)
    need = collections.defaultdict(lambda: collections.defaultdict(Decimal))
    for o, i, d in demand:
        need[o][i] += d
    acc = {}
    for o, _, _ in sorted(arrival, key=lambda r: (r[1], r[2])):
        ok = all(q <= st[i] for i, q in need[o].items())
        if ok:
            for i, q in need[o].items():
                st[i] -= q
        acc[o] = ok
    return acc, st


def test_admission_is_exact(spark):
    for seed in range(2):
        rng = random.Random(7 + seed)
        n_orders, n_ingr = 40, 4
        stock = [(i, Decimal(rng.randrange(20, 60))) for i in range(n_ingr)]
        demand = [(o, rng.randrange(n_ingr), Decimal(rng.randrange(1, 12)))
                  for o in range(n_orders) for _ in range(rng.randrange(0, 4))]
        arrival = [(o, T0 + dt.timedelta(hours=rng.randrange(0, 100)), o) for o in range(n_orders)]
        d = spark.createDataFrame(demand, "order_id long, ingredient_id long, demand decimal(18,2)")
        a = spark.createDataFrame(arrival, "order_id long, arrival_ts timestamp_ntz, arrival_seq long")
        s = spark.createDataFrame(stock, "ingredient_id long, quantity decimal(18,2)")
        dec, after, rounds = admit_in_order(d, a, s)
        want, final = _sequential_admission(demand, arrival, stock)
        assert {r.order_id: r.accepted for r in dec.collect()} == want
        assert {r.ingredient_id: r.quantity for r in after.collect()} == final
        # invariants: accepted usage never exceeds stock; decisions cover every order once
        assert all(q >= 0 for q in final.values())
        assert dec.count() == n_orders


def test_admission_by_many_ranges_is_exact_in_few_rounds(spark):
    """Ranges of a few rows, mixed types of demand, ids of text and ties in arrival: the sequential answer."""
    for seed, kind in ((3, "decimal(18,2)"), (4, "double")):
        rng = random.Random(seed)
        number = Decimal if kind.startswith("decimal") else float
        n_orders, n_ingr = 150, 5
        stock = [(f"i{i}", number(rng.randrange(60, 160))) for i in range(n_ingr)]
        demand = [(f"o{o:03d}", f"i{rng.randrange(n_ingr)}", number(rng.randrange(1, 14))) for o in range(n_orders) for _ in range(rng.randrange(0, 4))]
        arrival = [(f"o{o:03d}", T0 + dt.timedelta(hours=rng.randrange(0, 40)), f"o{o:03d}") for o in range(n_orders)]
        d = spark.createDataFrame(demand, f"order_id string, ingredient_id string, demand {kind}")
        a = spark.createDataFrame(arrival, "order_id string, arrival_ts timestamp_ntz, arrival_seq string")
        s = spark.createDataFrame(stock, f"ingredient_id string, quantity {kind}")
        dec, after, rounds = admit_in_order(d, a, s, target_rows=20)
        want, final = _sequential_admission([(o, i, Decimal(q)) for o, i, q in demand], arrival, [(i, Decimal(q)) for i, q in stock])
        assert {r.order_id: r.accepted for r in dec.collect()} == want
        assert {r.ingredient_id: r.quantity for r in after.collect()} == final
        assert 1 < rounds < 15


def test_admission_walks_one_row_an_order_in_few_ranges(spark, monkeypatch):
    """What is cut and walked are orders, not demands; ranges, and so rounds, do not grow with the shuffle partitions (8 here)."""
    rng = random.Random(11)
    n_orders, n_ingr = 90, 12
    stock = [(i, Decimal(rng.randrange(60, 160))) for i in range(n_ingr)]
    demand = [(o, rng.randrange(n_ingr), Decimal(rng.randrange(1, 14))) for o in range(n_orders) for _ in range(rng.randrange(0, 9))]
    arrival = [(o, T0 + dt.timedelta(hours=rng.randrange(0, 40)), o) for o in range(n_orders)]
    d = spark.createDataFrame(demand, "order_id long, ingredient_id long, demand decimal(18,2)")
    a = spark.createDataFrame(arrival, "order_id long, arrival_ts timestamp_ntz, arrival_seq long")
    s = spark.createDataFrame(stock, "ingredient_id long, quantity decimal(18,2)")
    cut, sizes = scan.ranges, []

    def ranged(*args):
        out = cut(*args)
        sizes.append([r["count"] for r in out.groupBy("_bucket").count().collect()])
        return out

    monkeypatch.setattr(scan, "ranges", ranged)
    monkeypatch.setattr(admission, "RANGE_ROWS", 10)
    monkeypatch.setattr(admission, "RANGES", 3)
    monkeypatch.setattr(admission, "_END_ROWS", 5)
    dec, after, rounds = admit_in_order(d, a, s)
    want, final = _sequential_admission(demand, arrival, stock)
    assert {r.order_id: r.accepted for r in dec.collect()} == want
    assert {r.ingredient_id: r.quantity for r in after.collect()} == final
    assert sum(sizes[0]) <= n_orders < len(demand) and 1 < len(sizes[0]) <= 4 and len(sizes) == rounds


def test_admission_is_exact_for_amounts_of_any_size(spark):
    """Amounts in whole units of 64 bits and beyond, other scales of demand and stock, demands that add up to just the stock."""
    rng = random.Random(12)
    for unit, of_demand, of_stock in ((Decimal("0.001"), "decimal(18,3)", "decimal(18,1)"), (Decimal("123456789012345.678901"), "decimal(38,6)", "decimal(38,6)")):
        stock = [(i, unit * 1000) for i in range(3)]
        demand = [(o, rng.randrange(3), unit * rng.randrange(1, 300)) for o in range(40) for _ in range(3)] + [(40, 0, unit * 400), (40, 0, unit * 600), (40, 1, unit)]
        arrival = [(40, T0, 40)] + [(o, T0 + dt.timedelta(hours=1 + o % 7), o) for o in range(40)]
        d = spark.createDataFrame(demand, f"order_id long, ingredient_id long, demand {of_demand}")
        a = spark.createDataFrame(arrival, "order_id long, arrival_ts timestamp_ntz, arrival_seq long")
        s = spark.createDataFrame(stock, f"ingredient_id long, quantity {of_stock}")
        dec, after, _ = admit_in_order(d, a, s, target_rows=30)
        with localcontext() as exact:
            exact.prec = 60
            want, final = _sequential_admission(demand, arrival, stock)
        assert {r.order_id: r.accepted for r in dec.collect()} == want and want[40]
        assert {r.ingredient_id: r.quantity for r in after.collect()} == final and final[0] == 0


def test_price_as_of_with_overlaps_and_gaps(spark):
    rng = random.Random(8)
    at = lambda h: T0 + dt.timedelta(hours=h)
    iv = []
    for _ in range(120):
        f = rng.randrange(0, 900)
        iv.append((rng.choice([1, 1, 1, 2, None]), Decimal(rng.randrange(1, 50)), at(f), rng.choice([None, at(f), at(f + rng.randrange(1, 30)), at(f + rng.randrange(1, 700))])))
    iv.append((1, Decimal(3), None, at(5)))
    ev = [(i, rng.choice([1, 1, 2, 3, None]), rng.choice([None, *[at(rng.randrange(-20, 1000)) for _ in range(12)]])) for i in range(400)]

    def price(k, t):
        best = [(f, e or dt.datetime.max, p) for key, p, f, e in iv if key == k and t is not None and f is not None and f <= t and (e is None or t < e)]
        return max(best)[2] if best else None
    e = spark.createDataFrame(ev, "event_id long, product_id long, created_at timestamp_ntz")
    h = spark.createDataFrame(iv, "menu_item_id long, price decimal(10,2), effective_from timestamp_ntz, effective_to timestamp_ntz")
    for rows in (None, 20):
        got = {r.event_id: r.price for r in history.price_as_of(e, h, target_rows=rows).collect()}
        assert got == {i: price(k, t) for i, k, t in ev}
    # the half-open interval of a day inside a longer one; no intervals, no events
    h = spark.createDataFrame([(1, Decimal(1), at(0), at(240)), (1, Decimal(2), at(72), at(120))], h.schema)
    e7 = spark.createDataFrame([(1, 1, at(168)), (2, 1, at(72)), (3, 1, at(120)), (4, 1, at(240))], e.schema)
    assert {r.event_id: r.price for r in history.price_as_of(e7, h).collect()} == {1: 1, 2: 2, 3: 1, 4: None}
    assert [r.price for r in history.price_as_of(e7.limit(1), h.limit(0)).collect()] == [None]
    assert history.price_as_of(e7.limit(0), h).count() == 0


def test_intervals_of_a_hot_key_spread(spark):
    """One item with all events and intervals: points and intervals meet by cells, none with a large share."""
    n = 4000
    points = spark.range(n).select(F.lit(1).alias("_k"), (F.col("id") * 1000).alias("_t"))
    spans = spark.range(n // 10).select(F.lit(1).alias("_k"), (F.col("id") * 10_000).alias("_f"), (F.col("id") * 10_000 + 15_000).alias("_e"))
    met = history.interval_matches(points, spans, "_k", "_t")
    per = met.groupBy("_t").count().collect()
    assert sum(r["count"] for r in per) == 15 * (n // 10) - 5 and max(r["count"] for r in per) <= 2
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join Inner" in x]
    assert len(joins) == 1 and "_v" in joins[0] and "_cc" in joins[0]


def test_order_rules_of_the_reference(spark):
    """NULL status is a status, only open orders are amended, requests come once, the first problem counts."""
    kinds = "order_id long, customer_name string, status string, created_at timestamp_ntz"
    base = spark.createDataFrame([(1, "a", "open", T0), (2, "b", None, T0), (3, "c", "processing", T0), (4, "d", "closed", T0)], kinds)
    items = spark.createDataFrame([(o, 1, 10, 1) for o in range(1, 5)], "order_id long, pos int, product_id long, quantity int")
    menu = spark.createDataFrame([(10, "x"), (11, "y")], "product_id long, name string")
    bom = spark.createDataFrame([(10, 0, Decimal("2"), 1), (11, 9, Decimal("1"), 1)], "menu_item_id long, inventory_id long, quantity decimal(10,2), pos int")
    stock = spark.createDataFrame([(0, Decimal("50"))], "ingredient_id long, quantity decimal(18,2)")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "order_id long")
    as_map = lambda df: {r.order_id: r.reason for r in df.collect()}
    snap, rej = orders.close_orders(base, ids)
    assert as_map(rej) == {4: "already_closed", 5: "not_found"}
    assert {r.order_id: r.status for r in snap.collect()} == dict.fromkeys((1, 2, 3, 4), "closed")
    done = orders.cancel_orders(base, items, menu, bom, stock, ids)
    assert as_map(done["rejects"]) == {4: "already_closed", 5: "not_found"}
    assert done["stock"].first().quantity == 56 and done["orders"].count() == 1
    req = spark.createDataFrame([(i, "z", None, T0) for i in (1, 2, 3, 4, 5)] + [(6, "z", None, T0)] * 2, kinds.replace("created_at", "requested_at"))
    new = spark.createDataFrame([(o, 1, 10, 3) for o in range(1, 7)], items.schema)
    res = orders.amend_orders(base, items, req, new, menu, bom, stock)
    assert [r.order_id for r in res["accepted"].collect()] == [1]
    assert as_map(res["rejects"]) == {2: "not_open", 3: "not_open", 4: "not_open", 5: "not_found", 6: "duplicate_in_batch"}
    # no arrival; an unknown ingredient before an unknown product, and the other way round
    req = spark.createDataFrame([(1, "a", None, None), (2, "b", None, T0), (3, "c", None, T0), (7, "d", None, T0)], kinds)
    new = spark.createDataFrame([(1, 1, 10, 1), (2, 1, 11, 1), (2, 2, 99, 1), (3, 1, 99, 1), (3, 2, 11, 1), (7, 1, 10, 1)], items.schema)
    res = orders.place_orders(req, new, menu, bom, stock, after=F.lit(40))
    assert as_map(res["rejects"]) == {1: "invalid", 2: "unknown_ingredient", 3: "unknown_item"}
    assert [(r.order_id, r.new_id, r.status, r.created_at) for r in res["accepted"].collect()] == [(7, 41, "open", T0)]


def test_place_orders_rejects_are_atomic(spark):
    o = spark.createDataFrame([(1, "ann", None, T0), (2, "", None, T0 + dt.timedelta(hours=1)),
                               (3, "bob", None, T0 + dt.timedelta(hours=2)), (4, "cy", None, T0 + dt.timedelta(hours=3)),
                               (5, "di", None, T0 + dt.timedelta(hours=4))],
                              "order_id long, customer_name string, status string, created_at timestamp_ntz")
    it = spark.createDataFrame([(1, 1, 10, 2), (2, 1, 10, 1), (3, 1, 10, 1), (3, 2, 99, 1), (4, 1, 10, 3)],
                               "order_id long, pos int, product_id long, quantity int")
    menu = spark.createDataFrame([(10, "x", "d", Decimal("1"))], "product_id long, name string, description string, price decimal(18,2)")
    bom = spark.createDataFrame([(10, 0, Decimal("2"), 1), (10, 1, Decimal("1"), 2)],
                                "menu_item_id long, inventory_id long, quantity decimal(10,2), pos int")
    stock = spark.createDataFrame([(0, Decimal("8")), (1, Decimal("100"))], "ingredient_id long, quantity decimal(18,2)")
    res = orders.place_orders(o, it, menu, bom, stock)
    acc = sorted(r.order_id for r in res["accepted"].collect())
    rej = {r.order_id: r.reason for r in res["rejects"].collect()}
    # order 1 uses 4 of 8; order 4 needs 6 > 4 left -> rejected and consumes nothing; order 5 has no items
    assert acc == [1, 5]
    assert rej == {2: "invalid", 3: "unknown_item", 4: "not_enough"}
    assert {r.ingredient_id: r.quantity for r in res["stock"].collect()} == {0: Decimal("4.00"), 1: Decimal("98.00")}
