"""M4 core: atomic admission of orders against limited stock, in arrival order.

An order is accepted only if *all* its ingredient demands fit in what the
orders accepted before it left over; a rejected order consumes nothing.  A
plain running sum is wrong (it would let rejected orders consume), and one
sequential walk is one task.  This plan decides orders in rounds, exactly:

  The orders, each one row with its demands, are cut into ranges of the arrival
  order, RANGES of them or of about RANGE_ROWS demands.  At the start of a range
  two stocks are known for each of its scarce ingredients, by running sums over
  the ranges:
    high = stock less the demand of earlier orders that are accepted
    low  = stock less the demand of earlier orders that are accepted or undecided
  All ranges are walked at once, each in arrival order.  An undecided order is
  rejected if it asks for more than ``high`` of any ingredient (it fails even
  if every undecided one before it is rejected) and accepted if it asks for no
  more than ``low`` of all (it fits even if all those are accepted); then both
  stocks fall.  Otherwise it stays undecided and only ``low`` falls.

In the first range low equals high, so a round decides at least that whole
range; the others decide whatever does not hang on orders of earlier ranges.
What is left is cut into ranges anew.  A chain of orders that wait for one
another is followed to its end inside a range; only its steps from range to
range cost rounds, and these get fewer as what is left shrinks.

Accepted orders matter only by their sums: an undecided order carries, for each
of its ingredients, what was accepted since the ingredient's last undecided
order, and a range hands on what is left over at its end.  So the working set
follows the undecided orders.  Each working set is a table in the shared
checkpoint folder, which cuts the lineage and survives executor loss.

Amounts are walked as whole numbers of their smallest decimal unit where these
have room in 64 bits, else as decimals (or doubles): the same sums either way.

Only ingredients whose whole demand exceeds the stock matter; the walk does not
look at the others.

Preconditions: demand > 0, arrival not NULL and every ingredient exists in
``stock`` (reject others before).  With positive demand, the reference's
line-by-line check equals this per-order sum test.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal, localcontext
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import scan
from larder.functions.scan import BUCKET
from larder.session import discard, materialize, ship_package

#: Demands (of an order for an ingredient) that one task walks, about, and at least.
RANGE_ROWS = 1_000_000
#: Ranges of large tables at most, so that rounds do not grow with the tables; a task holds only stocks and a batch of its range.
RANGES = 24
#: Ingredients in a row that a range hands on at its end, at most.
_END_ROWS = 10_000
#: Whole numbers are walked if sums stay below.
_WHOLE = 1 << 62
_ORDER = ["arrival_ts", "arrival_seq", "order_id"]
_AMOUNTS = ["ids", "a", "b"]
#: Kinds of rows of a range, in the order in which they are read: its stocks (``a`` low, ``b`` high), then orders (``a`` demand, ``b`` accepted
#: by others before). Written: undecided orders and what is left over, decisions.
_STOCK, _ROWS, _DECIDED = 0, 1, 2


class _Walk:
    """The stocks of one range, walked in arrival order."""

    def __init__(self):
        self.low: dict = {}
        self.high: dict = {}
        self.taken: dict = {}       # accepted demand of an ingredient since its last undecided order

    def asked(self, ids: list, amounts: list) -> tuple[list, list]:
        sums: dict = {}
        for i, d in zip(ids, amounts, strict=True):
            if i in self.low:
                sums[i] = sums[i] + d if i in sums else d
        return list(sums), list(sums.values())

    def accepted(self, ids: list, amounts: list) -> None:
        low, high, taken = self.low, self.high, self.taken
        for i, d in zip(ids, amounts, strict=True):
            if d:
                low[i] -= d
                high[i] -= d
                taken[i] = taken.get(i, 0) + d

    def order(self, ids: list, amounts: list) -> str:
        low, high = self.low, self.high
        for i, d in zip(ids, amounts, strict=True):
            if d > high[i]:
                return "R"
        for i, d in zip(ids, amounts, strict=True):
            if d > low[i]:
                break
        else:
            self.accepted(ids, amounts)
            return "A"
        for i, d in zip(ids, amounts, strict=True):
            low[i] -= d
        return "U"


class _Written:
    """Rows that the walk writes: places are taken from a batch that was read."""

    def __init__(self, names: list[str], types: list[pa.DataType]):
        self.names, self.types = names, types
        self.kind, self.at, self.st = [], [], []
        self.ends, self.amounts = [0], ([], [], [])

    def add(self, kind: int, at: int, st: str, *amounts: list) -> None:
        self.kind.append(kind)
        self.at.append(at)
        self.st.append(st)
        for mine, more in zip(self.amounts, amounts):
            mine.extend(more)
        self.ends.append(len(self.amounts[0]))

    def batch(self, read: pa.RecordBatch) -> pa.RecordBatch:
        own = dict(zip(self.names, self.types, strict=True))
        ends = pa.array(self.ends, pa.int32())
        columns = read.select(_ORDER).take(pa.array(self.at, pa.int64())).columns
        made = {"kind": pa.array(self.kind, own["kind"]), "st": pa.array(self.st, own["st"])} | dict(zip(_ORDER, columns, strict=True))
        made |= {c: pa.ListArray.from_arrays(ends, pa.array(x, own[c].value_type), type=own[c]) for c, x in zip(_AMOUNTS, self.amounts, strict=True)}
        return pa.RecordBatch.from_arrays([made[c] for c in self.names], names=self.names)


def _lists(column: pa.ListArray) -> tuple[list[int], list]:
    """Where each row's values begin and end, and all values."""
    values = column.values
    plain = values.null_count == 0 and (pa.types.is_integer(values.type) or pa.types.is_floating(values.type))
    return column.offsets.to_pylist(), values.to_numpy().tolist() if plain else values.to_pylist()


def _walk_ranges(rows: DataFrame) -> DataFrame:
    """New states and decisions of ``rows(_bucket, kind, arrival..., st, ids, a, b)``, sorted by range."""
    ship_package(rows.sparkSession)
    names = ["kind", *_ORDER, "st", *_AMOUNTS]
    schema = rows.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, bucket, last = None, None, None

        def ended() -> Iterator[pa.RecordBatch]:
            """What was accepted since the ingredients' last undecided orders, at the range's last place."""
            left = list(walk.taken.items()) if walk is not None else []
            for k in range(0, len(left), _END_ROWS):
                read, at = last
                out = _Written(names, [read.schema.field(c).type for c in names])
                ids, sums = zip(*left[k:k + _END_ROWS], strict=True)
                out.add(_ROWS, at, "A", ids, [0] * len(ids), sums)
                yield out.batch(read)

        with localcontext() as exact:
            exact.prec = 80
            for batch in batches:
                out = _Written(names, [batch.schema.field(c).type for c in names])
                buckets, kinds, states = (batch.column(c).to_pylist() for c in (BUCKET, "kind", "st"))
                (ends, ids), (_, a), (b_ends, b) = (_lists(batch.column(c)) for c in _AMOUNTS)
                for k, (here, kind, st) in enumerate(zip(buckets, kinds, states, strict=True)):
                    if here != bucket:
                        if out.at:
                            yield out.batch(batch)
                            out = _Written(names, out.types)
                        yield from ended()
                        walk, bucket, last = _Walk(), here, None
                    mine, need = ids[ends[k]:ends[k + 1]], a[ends[k]:ends[k + 1]]
                    before = b[b_ends[k]:b_ends[k + 1]]
                    if kind == _STOCK:
                        walk.low.update(zip(mine, need, strict=True))
                        walk.high.update(zip(mine, before, strict=True))
                        continue
                    last = batch, k
                    if before:
                        walk.accepted(mine, before)
                    else:   # the first round: demands are summed, what is not scarce is dropped
                        mine, need = walk.asked(mine, need)
                    if st == "A":
                        continue
                    verdict = walk.order(mine, need)
                    if verdict == "U":
                        out.add(_ROWS, k, "U", mine, need, [walk.taken.pop(i, 0) for i in mine])
                    else:
                        out.add(_DECIDED, k, verdict)
                if out.at:
                    yield out.batch(batch)
            yield from ended()

    return rows.mapInArrow(run, schema)


def _difference(a: T.DataType, b: T.DataType) -> T.DataType:
    """Type that holds sums and differences of the two exactly; doubles stay doubles."""
    if any(isinstance(t, T.FractionalType) and not isinstance(t, T.DecimalType) for t in (a, b)):
        return T.DoubleType()
    return T.DecimalType(38, max(getattr(t, "scale", 0) for t in (a, b)))


class _Unit(NamedTuple):
    """How amounts are stored, and walked as ``kind``; ``back`` makes sums of stored amounts a sum of demands."""
    stored: Callable[[Column], Column]
    kind: str
    walked: Callable[[Column], Column]
    back: Callable[[Column], Column]


def _units(demand: T.DataType, stock: T.DataType, total: T.DataType) -> list[_Unit]:
    """Units of amounts, the first that has room is taken: whole numbers, in which larger amounts are NULL, then the amounts as they are."""
    kind = _difference(demand, stock)
    as_is = _Unit(lambda c: c, kind.simpleString(), lambda c: c.cast(kind), lambda c: c.cast(total))
    scale = getattr(kind, "scale", None)
    if scale is None or scale > 16:
        return [as_is]

    def whole(c: Column) -> Column:
        x = c.try_cast(T.DecimalType(19, scale)) * F.lit(Decimal(10) ** scale)
        return F.when(F.abs(x) < F.lit(Decimal(_WHOLE)), x.cast("bigint"))

    return [_Unit(whole, "bigint", lambda c: c, lambda c: (c.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(total)), as_is]


def _stored(demand: DataFrame, arr: DataFrame, unit: _Unit) -> DataFrame:
    """The orders with their demands: (order_id, arrival..., need), NULL where an order has none. One exchange by order, as many tasks as it has."""
    parts = int(demand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    need = (demand.filter(F.col("order_id").isNotNull()).select("order_id", "ingredient_id", unit.stored(F.col("demand")).alias("d"))
            .repartition(parts, "order_id").groupBy("order_id").agg(F.collect_list(F.struct("ingredient_id", "d")).alias("need")))
    return materialize(arr.join(need, "order_id", "left"), "admission", "demand")


def _needs(asked: DataFrame) -> DataFrame:
    return asked.select(F.explode("need").alias("_n")).select("_n.*")


def _has_room(total: DataFrame, cur: DataFrame) -> bool:
    """Whether no amount and no sum of them left the whole numbers."""
    t = total.agg(F.count(F.when(F.col("_n") != F.col("_k"), 1)).alias("amounts"), F.count(F.when(F.coalesce(F.col("_m"), F.lit(_WHOLE)) >= _WHOLE, 1)).alias("sums")).first()
    return t["amounts"] + t["sums"] + cur.filter(F.col("quantity").isNotNull() & F.col("s").isNull()).count() == 0


def _with_stocks(rows: DataFrame, cur: DataFrame, kind: str) -> DataFrame:
    """The ranges' rows, each range's stocks (low, high) of scarce ingredients before them."""
    zero = F.lit(0).cast(kind)
    each = rows.select(BUCKET, F.explode(F.arrays_zip("ids", "a", "b")).alias("_e"))
    sums = (each.groupBy(BUCKET, F.col("_e.ids").alias("ingredient_id"))
            .agg(F.coalesce(F.sum("_e.b"), zero).cast(kind).alias("_a"), F.coalesce(F.sum("_e.a"), zero).cast(kind).alias("_u")))
    before = Window.partitionBy("ingredient_id").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    start = (sums.withColumns({"_a": F.coalesce(F.sum("_a").over(before), zero), "_u": F.coalesce(F.sum("_u").over(before), zero)})
             .join(cur, "ingredient_id")
             .select(BUCKET, F.lit(_STOCK).alias("kind"), F.array("ingredient_id").alias("ids"),
                     F.array((F.col("s") - F.col("_a") - F.col("_u")).cast(kind)).alias("a"), F.array((F.col("s") - F.col("_a")).cast(kind)).alias("b")))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.withColumn("kind", F.lit(_ROWS)).unionByName(start, allowMissingColumns=True)
    return both.repartitionById(parts, F.col(BUCKET).cast("int")).sortWithinPartitions(BUCKET, "kind", *_ORDER, "st")


def admit_in_order(demand: DataFrame, arrival: DataFrame, stock: DataFrame,
                   target_rows: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Decide every order of ``arrival``.

    demand:  (order_id, ingredient_id, demand)   any number of rows per pair (summed)
    arrival: (order_id, arrival_ts, arrival_seq) one row per order; the order is (ts, seq)
    stock:   (ingredient_id, quantity)
    Returns (decisions(order_id, accepted), stock_after(ingredient_id, quantity), rounds).

    Per round: the working set written by ranges, the walked ranges written,
    and one row of counts for the driver.  ``target_rows`` is the size of a range in
    demands (RANGE_ROWS, or a share of all by RANGES); an order lies in one range.
    """
    arr = arrival.select("order_id", "arrival_ts", "arrival_seq")
    amount, quantity = demand.schema["demand"].dataType, stock.schema["quantity"].dataType
    result = demand.groupBy("order_id").agg(F.sum("demand").alias("d")).groupBy().agg(F.sum("d").alias("d")).schema["d"].dataType
    for unit in (units := _units(amount, quantity, result)):
        asked = _stored(demand, arr, unit)
        cur = materialize(stock.select("ingredient_id", "quantity", unit.stored(F.col("quantity")).alias("s")), "admission", "stock")
        added = F.sum if unit is units[-1] else F.try_sum
        total = materialize(_needs(asked).groupBy("ingredient_id").agg(
            added("d").alias("_t"), added(F.abs("d")).alias("_m"), F.count(F.lit(1)).alias("_n"), F.count("d").alias("_k")), "admission", "total")
        if unit is units[-1] or _has_room(total, cur):
            break
        discard(asked)
    scarce = materialize(total.join(cur, "ingredient_id").filter(F.col("_t") > F.col("s")).select("ingredient_id").distinct(), "admission", "scarce")
    decided, used, rounds, open_ = [], [total, scarce], 0, not scarce.isEmpty()
    if open_:
        cur = cur.join(scarce, "ingredient_id", "left_semi").select("ingredient_id", unit.walked(F.col("s")).alias("s"))
        nothing = F.array().cast(f"array<{unit.kind}>")     # not NULL: Arrow's writer fills NULL lists anew for every row
        rows = asked.select(*_ORDER, F.lit("U").alias("st"), F.coalesce("need.ingredient_id", F.array()).alias("ids"),
                            F.coalesce(F.transform("need.d", unit.walked), nothing).alias("a"), nothing.alias("b"))
        demands = total.agg(F.sum("_n")).first()[0]
        size = max(1, (target_rows or max(RANGE_ROWS, -(-demands // RANGES))) * asked.count() // demands)
    else:
        decided.append(arr.select("order_id", F.lit(True).alias("accepted")))
    while open_:
        rounds += 1
        ranged = scan.ranges(rows, _ORDER, size)
        out = materialize(_walk_ranges(_with_stocks(ranged, cur, unit.kind)), "admission", "walked")
        discard(ranged)
        used.append(out)
        decided.append(out.filter(F.col("kind") == _DECIDED).select("order_id", (F.col("st") == "A").alias("accepted")))
        left = out.agg(F.count(F.when(F.col("kind") == _DECIDED, 1)).alias("decided"), F.count(F.when(F.col("st") == "U", 1)).alias("open")).first()
        open_ = left["open"] > 0
        if open_ and left["decided"] == 0:
            raise RuntimeError(f"admission round {rounds} decided no order")
        rows = out.filter(F.col("kind") == _ROWS).drop("kind")
    decisions = decided[0]
    for more in decided[1:]:
        decisions = decisions.unionByName(more)
    decisions = materialize(decisions, "admission", "decisions")
    for table in used:
        discard(table)
    acc = _needs(asked.join(decisions.filter("accepted").select("order_id"), "order_id", "left_semi"))
    used_all = materialize(acc.groupBy("ingredient_id").agg(unit.back(F.sum("d")).alias("_u")), "admission", "used")
    discard(asked)
    after = (stock.join(used_all, "ingredient_id", "left")
             .withColumn("quantity", F.col("quantity") - F.coalesce(F.col("_u"), F.lit(0))).drop("_u"))
    return decisions, after, rounds
