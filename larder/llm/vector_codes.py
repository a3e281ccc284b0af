"""Vector compression by product quantisation, with exact nearest entries from sliced and intersected bitmasks.

Components become the integers floor(1024 x); a vector is cut into PARTS equal
parts, each with a codebook of ENTRIES entries that Lloyd rounds improve.

Nearest entries: of every dimension the codebook's coordinates are sorted, and
prefix masks say which entries are among the first so many. The distance to a
known entry gives an initial radius; in each dimension the entries within it
are a slice of the sorted coordinates, so the exclusive or of two prefix masks.
The masks of all dimensions, ANDed, hold every entry that can be as near, and
these are compared exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.joins import meet
from larder.llm.common import give_back
from larder.session import materialize, ship_package

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors whose candidates are looked at together.
_BLOCK = 1024
#: Whole numbers below this in size are handled as 64-bit numbers, others as Python's.
_SMALL = 1 << 27
#: Sums travel in parts of so many bits.
_LIMB, _LIMBS = 30, 6
_MOST = (1 << 63) - 1


class Codebook:
    """Entries of one part (rows) with sorted coordinates and prefix masks of each dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, d = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        self.order = order
        one = np.zeros((k, -(-k // 64)), dtype=np.uint64)
        one[np.arange(k), np.arange(k) >> 6] = np.uint64(1) << (np.arange(k) & 63).astype(np.uint64)
        self.all = np.bitwise_or.reduce(one, axis=0)
        #: masks[j, i]: entries among the first i of dimension j
        self.masks = np.zeros((d, k + 1, one.shape[1]), dtype=np.uint64)
        for j in range(d):
            self.masks[j, 1:] = np.bitwise_or.accumulate(one[order[:, j]], axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lower of equal ones) and its squared distance, for each row of ``x``."""
        index, far = [], []
        if self.entries.dtype == object:
            x = x.astype(object)
        for at in range(0, len(x), _BLOCK):
            i, d = self._block(x[at: at + _BLOCK])
            index.append(i)
            far.append(d)
        return np.concatenate(index), np.concatenate(far)

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, (k, dims) = len(x), self.entries.shape
        near = ((x - self.entries[0]) ** 2).sum(axis=1) if dims else np.zeros(n, dtype=np.int64)
        for j in range(dims):  # the entry next in each dimension is a first guess
            at = np.minimum(np.searchsorted(self.sorted[:, j], x[:, j]), k - 1)
            near = np.minimum(near, ((x - self.entries[self.order[at, j]]) ** 2).sum(axis=1))
        radius = np.sqrt(near.astype(np.float64)).astype(np.int64) + 2 if x.dtype != object else np.array([_root(int(v)) for v in near], dtype=object)
        held = np.repeat(self.all[None], n, axis=0)
        for j in range(dims):
            low = np.searchsorted(self.sorted[:, j], x[:, j] - radius, side="left")
            high = np.searchsorted(self.sorted[:, j], x[:, j] + radius, side="right")
            held &= self.masks[j, low] ^ self.masks[j, high]
        bits = np.unpackbits(held.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)
        dist = ((x[row] - self.entries[entry]) ** 2).sum(axis=1) if dims else np.zeros(len(row), dtype=np.int64)
        first = np.searchsorted(row, np.arange(n))
        least = np.minimum.reduceat(dist, first)
        best = np.flatnonzero(dist == least[row])
        best = best[np.searchsorted(row[best], np.arange(n))]
        return entry[best], least


def _root(v: int) -> int:
    """A whole number not below the square root."""
    return math.isqrt(v) + 1


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE x), as Python's integers where 64 bits could overflow later."""
    x = np.floor(values.astype(np.float64) * SCALE)
    if not x.size or np.abs(x).max() < _SMALL:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The batch's vectors as whole numbers, with zeros behind shorter ones up to ``dims``."""
    column = batch.column("embedding")
    size = np.diff(column.offsets.to_numpy())
    flat = whole(column.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((batch.num_rows, dims), dtype=flat.dtype)
    if flat.dtype == object:
        out[:] = 0
    out[np.arange(dims)[None, :] < size[:, None]] = flat
    return out


def _limbs(v: int) -> list[int]:
    """Parts of _LIMB bits, the last with the sign."""
    return [(v >> (_LIMB * i)) & ((1 << _LIMB) - 1) for i in range(_LIMBS - 1)] + [v >> (_LIMB * (_LIMBS - 1))]


def _number(parts: list[int]) -> int:
    return sum(v << (_LIMB * i) for i, v in enumerate(parts))


def _books(codebook: list[list[list[int]]], width: int) -> list[Codebook]:
    out = []
    for entries in codebook:
        big = any(abs(v) >= _SMALL for e in entries for v in e)
        out.append(Codebook(np.array(entries, dtype=object if big else np.int64).reshape(len(entries), width)))
    return out


def _assign(rows: DataFrame, books: list[Codebook], dims: int) -> DataFrame:
    """``rows(vec_id, label, embedding)`` with ``code`` and ``error`` for the embedding."""
    spark = rows.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(books)  # parts x entries x dimensions, whatever the table's size
    width = dims // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code, error = _matrix(batch, dims), np.zeros((batch.num_rows, len(books)), dtype=np.uint8), 0
            for p, book in enumerate(held.value):
                index, far = book.nearest(x[:, p * width: (p + 1) * width])
                code[:, p], error = index, error + far.astype(object if far.dtype == object else np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array([min(int(e), _MOST) for e in error], pa.int64())],
                names=["vec_id", "label", "code", "error"])
        give_back()

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")]
    return rows.mapInArrow(run, ", ".join([*kinds, "code string", "error long"]))


def _sums(rows: DataFrame, books: list[Codebook], dims: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and componentwise sum of the parts that each (part, entry) is nearest to; parts x entries x dimensions numbers come to the driver."""
    spark = rows.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(books)
    width = dims // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, dims)
            for p, book in enumerate(held.value):
                part = x[:, p * width: (p + 1) * width]
                index, _ = book.nearest(part)
                order = np.argsort(index, kind="stable")
                used, first, count = np.unique(index[order], return_index=True, return_counts=True)
                sums = np.add.reduceat(part[order], first, axis=0)
                for e, n, s in zip(used.tolist(), count.tolist(), sums.tolist(), strict=True):
                    got = total.setdefault((p, e), [0, [0] * width])
                    got[0] += n
                    got[1] = [a + b for a, b in zip(got[1], s, strict=True)]
        # position -1 carries the count
        out = [(p, e, j, *_limbs(int(v))) for (p, e), (n, s) in total.items() for j, v in zip(range(-1, width), [n, *s], strict=True)]
        columns = list(zip(*out, strict=True)) if out else [()] * (3 + _LIMBS)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["p", "e", "j", *(f"l{i}" for i in range(_LIMBS))])
        give_back()

    limbs = [f"l{i}" for i in range(_LIMBS)]
    found = (rows.select("embedding").mapInArrow(run, ", ".join(f"{c} long" for c in ["p", "e", "j", *limbs]))
             .groupBy("p", "e", "j").agg(*[F.sum(c).alias(c) for c in limbs]).collect())
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    numbers = {(r["p"], r["e"], r["j"]): _number([r[c] for c in limbs]) for r in found}
    for p, e, j in numbers:
        if j == -1:
            out[p, e] = numbers[p, e, -1], [numbers[p, e, i] for i in range(width)]
    return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, label, embedding)`` of the rows whose vector is not NULL and has only finite components."""
    inf = F.lit(float("inf"))
    fine = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != inf))
    return (vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
            .where(F.col("embedding").isNotNull() & fine.eqNullSafe(True)))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """``(vec_id, label, code, error, label_error)`` of every usable vector, and the codebooks (part, entry, component).

    Codebooks start from the vectors of the smallest ids (NULL last; of equal ids the smaller vector first), fewer
    where there are fewer vectors. Vectors shorter than the longest, or than a multiple of ``parts``, count as having zeros behind. Unused entries stay; NULL labels are a label of their own;
    repeated rows are coded alike and counted each; an error above the 64-bit range is given as its largest
    number; no usable vectors give no rows and empty codebooks; other columns are ignored. ``entries`` is 256 at most.
    """
    rows = usable(vectors, id_col, vector_col, label_col)
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    dims = -(-longest // parts) * parts
    width = dims // parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()  # entries rows
    start = [[int(v) for v in whole(np.array(r["embedding"], dtype=np.float64))] + [0] * (dims - len(r["embedding"])) for r in first]
    codebook = [[v[p * width: (p + 1) * width] for v in start] for p in range(parts)]
    for _ in range(rounds if start else 0):
        for (p, e), (n, total) in _sums(rows, _books(codebook, width), dims).items():
            codebook[p][e] = [s // n for s in total]
    if start:
        coded = _assign(rows, _books(codebook, width), dims)
    else:
        coded = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    coded = materialize(coded.withColumns({"none": F.col("label").isNull(), "of": F.coalesce("label", F.lit(0).cast(rows.schema["label"].dataType))}), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    labels = materialize(coded.groupBy("none", "of").agg(total.alias("label_error"), F.count(F.lit(1)).alias("n")), "codes")
    return meet(coded, labels, ["none", "of"], "n").select("vec_id", "label", "code", "error", "label_error"), codebook


def codebooks_sha256(codebook: list[list[list[int]]]) -> str:
    """Digest of all components, by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(v) for part in codebook for entry in part for v in entry).encode()).hexdigest()


def oracle(table: str = "embeddings") -> str:
    """DuckDB text of the query's result over ``table`` (unique ids, numbers that doubles hold exactly)."""
    steps = [f"""
        v as materialized (
          select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as x from {table}
          where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        part as materialized (
          select vec_id, p, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] as x from v, range({PARTS}) r(p)),
        first_ as (select vec_id, row_number() over (order by vec_id) - 1 as e from (select vec_id from v order by vec_id limit {ENTRIES})),
        book0 as materialized (select p, e, x as c, list_dot_product(x, x) as cc from part join first_ using (vec_id))"""]

    def nearest(r: int) -> str:
        return f"""
        near{r} as materialized (
          select vec_id, p, any_value(x) as x, min((cc - 2 * list_dot_product(x, c), e)) as best from part join book{r} using (p) group by vec_id, p)"""

    for r in range(ROUNDS):
        steps += [nearest(r), f"""
        mean{r} as (
          select p, e, list(m order by j) as c from (
            select p, best[2] as e, j, floor(sum(x[j]) / count(*)) as m from near{r}, unnest(range(1, len(x) + 1)) u(j) group by all) group by p, e),
        book{r + 1} as materialized (
          select b.p, b.e, coalesce(m.c, b.c) as c, list_dot_product(coalesce(m.c, b.c), coalesce(m.c, b.c)) as cc
          from book{r} b left join mean{r} m on m.p = b.p and m.e = b.e)"""]
    steps += [nearest(ROUNDS), f"""
        coded as (
          select vec_id, string_agg(lower(printf('%02x', best[2])), '' order by p) as code, sum(list_dot_product(x, x) + best[1])::bigint as error
          from near{ROUNDS} group by vec_id),
        digest as (
          select sha256(string_agg(list_aggregate(list_transform(c, lambda y: y::bigint::varchar), 'string_agg', ','), ',' order by p, e)) as codebooks_sha256 from book{ROUNDS})
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
        from coded join v using (vec_id), digest"""]
    return "with " + ",".join(steps[:-1]) + "," + steps[-1]
