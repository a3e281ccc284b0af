"""Text matching (X1-X3): weighted token search and trigram-similar pairs."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import tokens, trigrams
from larder.session import materialize, ship_package

#: Strings of one prefix trigram in a part, about; two parts meet in a task.
PART_ROWS = 4_000
#: Rows and numbers of a tile of strings, at most, and bytes of pairs that leave at once, about.
TILE_ROWS, TILE, EMIT_BYTES = 1_000, 1 << 24, 16 << 20
WEIGHT_A, WEIGHT_B = 1.0, 0.4   # fixed: weights of the name (A) and description (B) fields


def weighted_search(df: DataFrame, terms: list[str], key: str = "product_id",
                    a: str = "name", b: str = "description") -> DataFrame:
    """score = 1.0 * |terms in a| + 0.4 * |terms in b|; rows with a positive score.

    A NULL ``b`` counts as empty.  Terms are normalised like the text.
    """
    q = F.array_distinct(F.array(*[F.lit(t.lower()) for t in terms]))
    sa = F.size(F.array_intersect(tokens(a), q))
    sb = F.size(F.array_intersect(tokens(b), q))
    scored = df.select(key, (F.lit(WEIGHT_A) * sa + F.lit(WEIGHT_B) * sb).alias("score"))
    return scored.filter(F.col("score") > 0)


def weighted_search_many(df: DataFrame, queries: DataFrame, key: str = "product_id",
                         a: str = "name", b: str = "description", top: int | None = None) -> DataFrame:
    """X1 for many queries ``(query_id, text)``: explode tokens, equi-join on the token, count matches.

    Only (query, row) pairs that share a token are ever formed.  ``rank``
    orders a query's rows by score, then key; with ``top`` only the best
    ``top`` of each query are kept, cut per task before they meet.
    """
    qt = queries.select("query_id", F.explode(tokens("text")).alias("tok"))
    ta = df.select(key, F.explode(tokens(a)).alias("tok"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    tb = df.select(key, F.explode(tokens(b)).alias("tok"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    hits = qt.join(ta.unionByName(tb), "tok")
    counts = hits.groupBy("query_id", key).agg(F.sum("in_a").alias("na"), F.sum("in_b").alias("nb"))
    scored = counts.select("query_id", key, (F.lit(WEIGHT_A) * F.col("na") + F.lit(WEIGHT_B) * F.col("nb")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    ranked = scored.withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= top) if top else ranked


def name_search(df: DataFrame, terms: list[str], key: str = "id", col: str = "name") -> DataFrame:
    """Rows whose ``col`` tokens contain any of ``terms``."""
    q = F.array_distinct(F.array(*[F.lit(t.lower()) for t in terms]))
    return df.filter(F.arrays_overlap(tokens(col), q)).select(key, col)


def _ceil(a: Column, b: int) -> Column:
    """a / b rounded up, for whole numbers."""
    return F.call_function("div", a + (b - 1), F.lit(b).cast("long"))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each ``(g, lo, hi)``, which come one after the other."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("g", "lo", "hi")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if begin == end:
                continue
            if kept and (keys[begin] != last).any():
                yield pa.Table.from_batches(kept)
                kept = []
            last = keys[begin]
            kept.append(batch.slice(begin, end - begin))
    if kept:
        yield pa.Table.from_batches(kept)


def _near(cell: pa.Table, up: int, down: int) -> Iterator[pa.RecordBatch]:
    """The similar pairs of one cell whose first common trigram is the cell's.

    A tile of rows is a 0/1 matrix with a column for each trigram, so the product of two tiles counts what their
    rows have in common; trigrams ranked before the cell's weigh more than any pair can have in common. From the
    place of the cell's trigram in a row follows how long a partner may be: only tiles that can have pairs are made.
    """
    g, lo, hi = (cell.column(c)[0].as_py() for c in ("g", "lo", "hi"))
    cell = cell.combine_chunks()
    lists = cell.column("r").combine_chunks()
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    if 2 * int(n.max()) * (up + down) >= 1 << 63:
        raise OverflowError("too many digits in the threshold")
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    # similar rows have at least (n + partner's n) * up / (up + down) in common, and no more than what is left from the first common one on
    longest = (n - np.bincount(row[flat < g], minlength=len(n))) * (up + down) // up - n
    text = cell.column("s").combine_chunks().cast(pa.large_binary())
    order = np.empty(len(n), dtype=np.int64)
    order[pc.sort_indices(text).to_numpy()] = np.arange(len(n))
    by_size = np.lexsort((order, n))
    at_size = np.empty(len(n), dtype=np.int64)
    at_size[by_size] = np.arange(len(n))

    keys, column = np.unique(flat, return_inverse=True)
    shared = np.bincount(column) > 1          # a trigram of one row is common to none
    early = (keys < g)[shared]
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    at = np.searchsorted(row, np.arange(len(n) + 1))
    weight = int(n.max()) + 1
    kind = np.float32 if weight * weight < 1 << 24 else np.float64     # holds every product exactly
    most = max(1, min(TILE_ROWS, TILE // len(early)))
    emit = max(1, EMIT_BYTES // (16 + int(pc.max(pc.binary_length(text)).as_py())))

    def matrix(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(early)), dtype=kind)
        size = at[rows + 1] - at[rows]
        mine = np.repeat(at[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        out[np.repeat(np.arange(len(rows)), size), column[mine]] = 1
        return out

    own = cell.column("own").to_numpy()
    for one, two in [(lo, hi), (hi, lo)][: 1 + (lo < hi)]:     # the left row of a pair is the shorter one
        left = by_size[(own == one)[by_size] & (longest >= n)[by_size]]
        right = by_size[(own == two)[by_size]]
        for i in range(0, len(left), most):
            rows = left[i: i + most]
            near = right[(at_size[right] > at_size[rows[0]]) & (longest[right] >= n[rows[0]]) & (n[right] <= longest[rows].max())]
            if not len(near):
                continue
            weighted = matrix(rows)
            weighted[:, early] *= weight
            for j in range(0, len(near), most):
                others = near[j: j + most]
                common = weighted @ matrix(others).T
                least = -(-int(n[rows[0]] + n[others[0]]) * up // (up + down))
                a, b = np.nonzero((common >= least) & (common < weight))
                inter = common[a, b].astype(np.int64)
                a, b = rows[a], others[b]
                both = n[a] + n[b]
                keep = (inter * (up + down) >= both * up) & (at_size[a] < at_size[b])
                a, b, inter, both = a[keep], b[keep], inter[keep], both[keep]
                swap = order[a] > order[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                similarity = inter / (both - inter)
                for k in range(0, len(a), emit):
                    yield pa.RecordBatch.from_arrays(
                        [text.take(pa.array(x[k: k + emit])).cast(pa.large_string()).cast(pa.string()) for x in (a, b)] + [pa.array(similarity[k: k + emit])],
                        names=["a", "b", "similarity"])


def trigram_pairs(names: DataFrame, threshold: float, col: str = "name", part_rows: int = PART_ROWS) -> DataFrame:
    """Pairs of distinct strings whose trigram Jaccard similarity is >= ``threshold``.

    Exact, without forming all pairs: prefix filtering.  Trigrams are ranked
    globally by document frequency (rarest first); two sets with Jaccard
    >= t must share a trigram within their first ``|A| - ceil(t|A|) + 1``
    ranked trigrams, so strings meet where they share a *prefix* trigram.  The
    strings of one are dealt into parts, and each two of its parts are a cell,
    whose pairs are counted by matrix products and come out where their first
    common trigram is the cell's, so once.  All checks are in whole numbers.
    Output: a < b, similarity = |A n B| / |A u B|.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = names.sparkSession
    ship_package(spark)
    # exact arithmetic: the threshold is the fraction up / down as it is written
    share = Fraction(str(threshold))
    up, down = share.numerator, share.denominator

    tok = names.select(F.col(col).alias("s")).filter(F.col("s").isNotNull()).distinct().select("s", F.explode(trigrams("s")).alias("g"))
    # a trigram's rank in one number: its frequency, then its three characters (blank, a-z, 0-9: at most 37 ** 3 trigrams, so they can be broadcast)
    code = sum((F.ascii(F.substring("g", i + 1, 1)).cast("long") * (1 << 8 * (2 - i)) for i in range(3)), F.lit(0).cast("long"))
    freq = tok.groupBy("g").agg(F.count(F.lit(1)).alias("df")).select("g", (F.col("df") * (1 << 24) + code).alias("rank"))
    ranked = tok.join(F.broadcast(freq), "g").groupBy("s").agg(F.sort_array(F.collect_list("rank")).alias("r"))
    held = materialize(ranked, "trigrams")
    n = F.size("r").cast("long")
    need = _ceil(n * up, down)          # a partner shares at least so many trigrams
    prefix = held.select("s", "r", F.explode(F.slice("r", F.lit(1), (n - need + 1).cast("int"))).alias("g"))
    sizes = prefix.groupBy("g").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("g", F.ceil(F.col("held") / part_rows).cast("int").alias("parts"))
    own, other = F.col("own"), F.col("other")
    cells = (prefix.join(F.broadcast(sizes), "g")
             .withColumns({"own": F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
             .select("g", F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi"), "own", "s", "r")
             .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            if cell.num_rows > 1:
                yield from _near(cell, up, down)

    return cells.mapInArrow(run, "a string, b string, similarity double")
