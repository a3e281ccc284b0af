"""Set-similarity join on word shingles: token-combination prefixes.

Two sets of sizes up to n whose Jaccard similarity reaches the threshold differ
in at most e(n) tokens of the larger one. With all tokens in one global order,
rarest first, the first e + 1 tokens of each (its prefix) share a token. Where
a shared token is frequent that says little, so prefixes are extended: if they
hold x_c tokens of class c and the sum over classes of x_c - (c - 1) exceeds e,
two linked sets share c tokens of some class c. Rare tokens (class 1) are
indexed alone, those of class 2 by pairs, those of class 3 by triples.

The order may be any, so the frequencies that it goes by are counted in a fixed
number of buckets; the classes are by exact counts of the prefixes that hold a
token. Long sets have too many pairs and triples of tokens, so the largest class
falls with the size (LEVELS); a set whose partners may be of the next level is
indexed for both.

Sets that share a key meet in a task. Parity bitmaps bound their difference
from below and drop most; the task returns pairs that connect what is left of a key
(not all pairs, but for keys of a few sets), and these are verified on the sets. Only where such a pair
fails are the sets of that candidate component brought to those of their keys
that hold several parts of it, and compared exactly there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.joins import meet
from larder.llm.common import GRAM, SPACE_TABLE, Words, free_shuffles, give_back, grams, inside, mix, partitions, signed, text_bytes, text_slices
from larder.llm.components import connected_components
from larder.session import discard, materialize, ship_package

SHINGLE = 3
#: Jaccard similarity in per cent.
PERCENT = 90
#: Prefixes that hold a token: above these counts it is of class 2, of class 3.
FREQUENT = (64, 4096)
#: (largest size, largest class) of each level; larger sets index single tokens.
LEVELS = ((64, 3), (256, 2))
#: Buckets in which tokens are counted for the global order; one byte each goes to every task.
BUCKETS = 1 << 20
_CHUNK = 1 << 12
#: Sets of one part of a key, and tokens of one part where sets are compared exactly.
PART_SETS, PART_TOKENS = 4096, 1 << 21
#: Bits of the bitmap that says which sets are to be fetched again; fixed, whatever the tables.
FILTER_BITS = 1 << 24
#: Bounds of the parity bitmaps' bits.
_BITS = (128, 8192)
#: Edges of one set that are verified with one copy of it.
_SHARE = 256
#: Sets of a task that is solved together with others, and words of bitmaps compared at once.
_SMALL, _WORDS = 16, 1 << 21

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in SPACE_TABLE)


def shingle_sets(texts: list[bytes | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of each text's distinct ``k``-word shingles, sorted; fewer words are one shingle."""
    w = Words(texts, _TABLE)
    h, n = w.hashes(), len(w.start)
    of = np.repeat(np.arange(len(texts)), w.counts)
    at = np.flatnonzero(inside(w.first, n, k))
    text, token = [of[at]], [grams(h, k)[at]]
    for size in range(1, k):
        short = np.flatnonzero(w.counts == size)
        text.append(short)
        token.append(grams(h, size)[w.first[short]])
    text, token = np.concatenate(text), np.concatenate(token)
    order = np.lexsort((token, text))
    text, token = text[order], token[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (token[1:] != token[:-1])
    return text[new], token[new]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums (wrapping) of ``values`` between neighbouring ``bounds``."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def nodes_of(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit name of each set; equal sets have the same."""
    size = np.diff(bounds).astype(np.uint64)
    return mix(_sums(mix(token), bounds) * GRAM ^ mix(size) ^ _sums(mix(token ^ GRAM), bounds))


def bits_for(size: np.ndarray) -> np.ndarray:
    """Bits of the parity bitmap of sets of these sizes: about half a bit a token, a power of two."""
    wide = np.maximum(_BITS[0], np.minimum(_BITS[1], size // 2))
    return 1 << np.ceil(np.log2(wide)).astype(np.int64)


def bitmaps(token: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity bitmap of each set: bit b tells whether an odd number of its tokens fall on b."""
    size = np.diff(bounds)
    bits = bits_for(size)
    base = np.concatenate([[0], np.cumsum(bits)])
    at = (token >> np.uint64(20)).astype(np.int64) & np.repeat(bits - 1, size)
    odd = np.bincount(np.repeat(base[:-1], size) + at, minlength=base[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little")
    return [packed[a >> 3: b >> 3].tobytes() for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def errors(size, percent: int):
    """Tokens of a set of this size that a linked set, not larger or not smaller, may lack."""
    return size * (100 - percent) // 100


def levels_of(size: np.ndarray, levels=LEVELS) -> np.ndarray:
    return np.searchsorted(np.array([n for n, _ in levels]), size, side="left")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """``doc_id, th, n, node, bits`` of every row, and rows ``chunk, counts``: the tokens counted in buckets by each task."""
    ship_package(rows.sparkSession)
    fields = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        names = [*(f.name for f in fields), "n", "node", "bits", "chunk", "counts"]
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.column(f.name).type for f in fields]
            for part in text_slices(batch):
                text, token = shingle_sets(text_bytes(part), k)
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
                total += np.bincount((token & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                none = pa.nulls(part.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in fields), pa.array(np.diff(bounds)), pa.array(signed(nodes_of(token, bounds))),
                     pa.array(bitmaps(token, bounds), pa.binary()), none, pa.nulls(part.num_rows, pa.binary())], names=names)
        used = [c for c in range(0, BUCKETS, _CHUNK) if total[c: c + _CHUNK].any()]
        if used:
            packed = [np.ascontiguousarray(total[c: c + _CHUNK]).astype("<i8").tobytes() for c in used]
            blank = [pa.nulls(len(used), t) for t in [*kinds, pa.int64(), pa.int64(), pa.binary()]]
            yield pa.RecordBatch.from_arrays([*blank, pa.array([c // _CHUNK for c in used], pa.int32()), pa.array(packed, pa.binary())], names=names)
        give_back()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{kinds}, n long, node long, bits binary, chunk int, counts binary")


def order_of(counts: DataFrame) -> np.ndarray:
    """Rank of each bucket by the number of its tokens, in quarters of a power of two; BUCKETS / _CHUNK rows come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(part, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["chunk", "counts"])

    found = counts.repartition(partitions(counts.sparkSession), "chunk").mapInArrow(run, "chunk int, counts binary").collect()
    out = np.zeros(BUCKETS, dtype=np.uint8)
    for r in found:
        out[r["chunk"] * _CHUNK: (r["chunk"] + 1) * _CHUNK] = np.log2(np.frombuffer(r["counts"], "<i8") + 1.0) * 4
    return out


def _prefixes(rows: DataFrame, rank: np.ndarray, k: int, percent: int, levels=LEVELS) -> DataFrame:
    """``token, node, n, level``: the extended prefix of every text's set, at each level at which it may have partners."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(rank)  # BUCKETS bytes
    extra = np.array([(c - 1) * c // 2 for _, c in levels] + [0])  # sum of c - 1 over the classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                text, token = shingle_sets(text_bytes(part), k)
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
                size, node = np.diff(bounds), signed(nodes_of(token, bounds))
                order = np.lexsort((token, held.value[(token & np.uint64(BUCKETS - 1)).astype(np.int64)], text))
                sorted_, place = token[order], np.arange(len(token)) - bounds[text]
                largest = size * 100 // percent
                low, high = levels_of(size, levels), levels_of(largest, levels)
                may = errors(largest, percent) > 0  # smaller sets link with equal ones only
                for level in np.unique([low, high]):
                    use = may & ((low == level) | (high == level))
                    at = np.flatnonzero(use[text] & (place < (errors(size, percent) + 1 + extra[level])[text]))
                    of = text[at]
                    own = mix(sorted_[at] ^ np.uint64(level + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(own)), pa.array(node[of]), pa.array(size[of]), pa.array(np.full(len(at), level, dtype=np.int32))],
                                                     names=["token", "node", "n", "level"])
        give_back()

    return rows.select("text").mapInArrow(run, "token long, node long, n long, level int")


def _keys(shared: DataFrame) -> DataFrame:
    """``sig, node, n, bits``: the index keys of ``shared(node, level, tokens, n, bits)``, tokens as (class, token)."""
    ship_package(shared.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, row, sig = batch.column("tokens").to_pylist(), [], []
            for i, pairs in enumerate(tokens):
                for c in (1, 2, 3):
                    own = np.sort(np.array([p["token"] for p in pairs if p["class"] == c], dtype=np.int64).view(np.uint64))
                    if len(own) < c:
                        continue
                    if c == 1:
                        key = own
                    elif c == 2:
                        a, b = np.triu_indices(len(own), 1)
                        key = mix(own[a] * GRAM ^ mix(own[b]))
                    else:
                        a, b, d = np.array(list(combinations(range(len(own)), 3))).T
                        key = mix((own[a] * GRAM ^ mix(own[b])) * GRAM ^ mix(own[d]))
                    sig.append(key)
                    row.append(np.full(len(key), i))
            if not sig:
                continue
            at = np.concatenate(row)
            for cut in range(0, len(at), 1 << 15):
                take = pa.array(at[cut: cut + (1 << 15)])
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sig)[cut: cut + (1 << 15)])), *(batch.column(c).take(take) for c in ("node", "n", "bits"))],
                                                 names=["sig", "node", "n", "bits"])

    return shared.select("node", "tokens", "n", "bits").mapInArrow(run, "sig long, node long, n long, bits binary")


def _dealt(members: DataFrame, load: Column, most: int) -> DataFrame:
    """Members of each ``sig`` dealt into parts of ``most`` by ``load``; each pair of parts is a task ``(sig, i, j)``.

    In a task of two parts, ``side`` tells them apart.
    """
    large = materialize(members.groupBy("sig").agg(F.ceil(F.sum(load) / most).cast("int").alias("parts")).where("parts > 1"), "jaccard")
    return (members.join(large, "sig", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
            .drop("own", "other", "parts"))


def _tasks(dealt: DataFrame, solve: Callable, columns: list[str]) -> DataFrame:
    """``u, v, s``: the edges that ``solve(rows, bounds)`` finds in whole tasks, as row numbers; ``s`` numbers the shares of one set's edges.

    ``rows`` has node, n, side and ``columns``; each task, sorted by n, lies between two neighbouring ``bounds``.
    """
    spark = dealt.sparkSession
    ship_package(spark)
    keys = ["sig", "i", "j"]
    rows = dealt.select(*keys, "side", "node", "n", *columns).repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last task, which may go on

        def out(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(bounds) - 1 == rows.num_rows:
                return
            a, b = solve(rows.combine_chunks(), bounds)
            if len(a):
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                node = rows.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array((np.arange(len(a)) - np.searchsorted(a, a)) // _SHARE)], names=["u", "v", "s"])

        def key(batch: pa.RecordBatch) -> np.ndarray:
            return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = key(batch)
            cuts = (np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1).tolist()
            if held and (key(held[-1].slice(held[-1].num_rows - 1))[:, 0] != own[:, 0]).any():
                yield from out(pa.Table.from_batches(held), np.array([0, sum(h.num_rows for h in held)]))
                held = []
            if cuts:
                before = sum(h.num_rows for h in held)
                yield from out(pa.Table.from_batches([*held, batch.slice(0, cuts[-1])]), np.array([0, *(before + c for c in cuts)]))
                held = []
            held.append(batch.slice(cuts[-1] if cuts else 0))
        if held:
            yield from out(pa.Table.from_batches(held), np.array([0, sum(h.num_rows for h in held)]))
        give_back()

    return rows.mapInArrow(run, "u long, v long, s long")


def _spanning(size: np.ndarray, side: np.ndarray, percent: int, linked: Callable[[int, np.ndarray], np.ndarray],
              label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what ``linked`` links, of rows sorted by ``size``: a row is compared with later ones that it isn't connected to yet.

    Only sizes that can link are compared, and only different sides where there are two. Rows with the same ``label`` are connected from the start.
    """
    label, a, b = np.arange(len(size)) if label is None else label.copy(), [], []
    end = np.searchsorted(size, size * 100 // percent, side="right")
    two = bool(side.any())
    for r in range(len(size) - 1):
        other = np.arange(r + 1, end[r])
        other = other[(label[r + 1: end[r]] != label[r]) & (side[r + 1: end[r]] != side[r])] if two else other[label[r + 1: end[r]] != label[r]]
        if not len(other):
            continue
        found = linked(r, other)
        if len(found):
            group, first = np.unique(label[found], return_index=True)
            a.append(np.full(len(group), r))
            b.append(found[first])
            label[np.isin(label, group)] = label[r]
    if not a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(a), np.concatenate(b)


class _Bitmaps:
    """Parity bitmaps of many sets, compared in bulk."""

    def __init__(self, size: np.ndarray, bits: pa.Array, percent: int):
        self.size, self.percent = size, percent
        at = np.frombuffer(bits.buffers()[1], dtype="<i4")[bits.offset: bits.offset + len(bits) + 1].astype(np.int64)
        data = np.frombuffer(bits.buffers()[2], dtype=np.uint8)[at[0]: at[-1]]
        self.words, self.at, self.wide = np.ascontiguousarray(data).view("<u8"), (at[:-1] - at[0]) >> 3, np.diff(at) >> 3

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs (a, b), the first not the larger set, differ in no more bits than linked sets may."""
        out = np.zeros(len(a), dtype=bool)
        fits = np.flatnonzero(self.size[b] * self.percent <= self.size[a] * 100)
        kind = self.wide[a[fits]] * 2 + (self.wide[b[fits]] > self.wide[a[fits]])
        for k in np.unique(kind).tolist():
            w, fold, every = k >> 1, k & 1, fits[kind == k]
            for cut in range(0, len(every), max(1, _WORDS // w)):
                pick = every[cut: cut + max(1, _WORDS // w)]
                x, y = a[pick], b[pick]
                step = np.arange(w)
                left, at = self.words[self.at[x][:, None] + step], self.at[y][:, None] + step
                right = self.words[at] ^ self.words[at + w] if fold else self.words[at]
                differ = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
                out[pick] = differ * (100 + self.percent) <= (self.size[x] + self.size[y]) * (100 - self.percent)
        return out


def _by_bitmap(percent: int) -> Callable:
    """Edges between sets whose bitmaps allow a link: of tasks of _SMALL sets at most all, solved together; of others what connects them."""
    def solve(rows: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, side = rows.column("n").to_numpy(), rows.column("side").to_numpy()
        maps = _Bitmaps(size, rows.column("bits").chunk(0), percent)
        held, first = np.diff(bounds), bounds[:-1]
        two = np.maximum.reduceat(side, first) > 0
        a, b = [], []
        for m in range(2, _SMALL + 1):
            task = np.flatnonzero(held == m)
            if len(task):
                i, j = np.triu_indices(m, 1)
                x, y = (first[task][:, None] + i).ravel(), (first[task][:, None] + j).ravel()
                pick = np.flatnonzero((side[x] != side[y]) | ~np.repeat(two[task], len(i)))
                pick = pick[maps.near(x[pick], y[pick])]
                a.append(x[pick])
                b.append(y[pick])
        for t in np.flatnonzero(held > _SMALL).tolist():
            low, high = bounds[t], bounds[t + 1]
            x, y = _spanning(size[low:high], side[low:high], percent, lambda r, o, low=low: o[maps.near(np.full(len(o), low + r), low + o)])
            a.append(x + low)
            b.append(y + low)
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, dtype=np.int64),) * 2

    return solve


def _by_set(percent: int) -> Callable:
    """Edges between sets that are as similar as asked for and not connected yet."""
    def pairs(size: np.ndarray, side: np.ndarray, label: np.ndarray, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([np.frombuffer(t, "<i8") for t in tokens])
        row = np.repeat(np.arange(len(size)), size)
        _, name = np.unique(flat, return_inverse=True)
        order = np.argsort(name, kind="stable")
        holders, begin = row[order], np.searchsorted(name[order], np.arange(name.max() + 2))
        bounds = np.concatenate([[0], np.cumsum(size)])

        def linked(r: int, other: np.ndarray) -> np.ndarray:
            own = name[bounds[r]: bounds[r + 1]]
            held = np.concatenate([holders[begin[t]: begin[t + 1]] for t in own.tolist()])
            both = np.bincount(held, minlength=len(size))[other]
            return other[100 * both >= percent * (size[r] + size[other] - both)]

        return _spanning(size, side, percent, linked, label)

    def solve(rows: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, side, label, tokens = *(rows.column(c).to_numpy() for c in ("n", "side", "label")), rows.column("tokens")
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if high - low > 1:
                x, y = pairs(size[low:high], side[low:high], label[low:high], tokens.slice(low, high - low).to_pylist())
                a.append(x + low)
                b.append(y + low)
        return np.concatenate(a), np.concatenate(b)

    return solve


def _fetched(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``node, n, tokens`` of the sets ``wanted(node)`` (distinct), read again from the texts of ``rows``.

    A bitmap of FILTER_BITS keeps most other sets from being exchanged.
    """
    spark = rows.sparkSession
    at = F.col("node").bitwiseAND(F.lit(FILTER_BITS - 1))
    marks = (wanted.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast((node & 63) as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())  # FILTER_BITS / 64 rows at most
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in marks:
        table[r["word"]] = r["bits"]
    held = spark.sparkContext.broadcast(table.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                text, token = shingle_sets(text_bytes(part), k)
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
                node = nodes_of(token, bounds)
                bit = node & np.uint64(FILTER_BITS - 1)
                hit = (held.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                _, first = np.unique(node, return_index=True)  # copies in one slice go once
                hit &= np.isin(np.arange(len(node)), first)
                pick = np.flatnonzero(hit)
                if len(pick):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(node[pick])), pa.array(np.diff(bounds)[pick]),
                                                      pa.array([token[bounds[i]: bounds[i + 1]].tobytes() for i in pick.tolist()], pa.binary())], names=["node", "n", "tokens"])
        give_back()

    found = rows.select("text").mapInArrow(run, "node long, n long, tokens binary")
    return found.join(wanted, "node", "left_semi").groupBy("node", "n").agg(F.min("tokens").alias("tokens"))


def _verified(rows: DataFrame, edges: DataFrame, k: int, percent: int) -> DataFrame:
    """``edges(u, v, s)`` with ``ok``: whether the sets are as similar as asked for."""
    ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    sets = materialize(_fetched(rows, ends, k), "jaccard")
    shares = edges.select(F.col("u").alias("node"), "s").distinct()
    first = shares.join(sets, "node").select(F.col("node").alias("u"), "s", F.col("n").alias("nu"), F.col("tokens").alias("tu"))
    second = edges.join(sets, edges["v"] == sets["node"]).select("u", "v", "s", F.col("n").alias("nv"), F.col("tokens").alias("tv"))
    both = second.join(first, ["u", "s"]).select("u", "v", "nu", "nv", "tu", "tv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = np.array([len(np.intersect1d(np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"), assume_unique=True))
                             for a, b in zip(batch.column("tu").to_pylist(), batch.column("tv").to_pylist(), strict=True)], dtype=np.int64)
            size = batch.column("nu").to_numpy() + batch.column("nv").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(100 * same >= percent * (size - same))], names=["u", "v", "ok"])

    return both.mapInArrow(run, "u long, v long, ok boolean")


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` of the nodes in ``links``."""
    found = connected_components(links.select("u", "v"))
    return nodes.select("node").join(found, "node")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT,
            frequent: tuple[int, int] = FREQUENT, levels: tuple[tuple[int, int], ...] = LEVELS, part_sets: int = PART_SETS,
            part_tokens: int = PART_TOKENS) -> DataFrame:
    """``doc_id, th, n_shingles, node, component, component_id`` for every row of ``docs``; ``th`` is the text's hash, ``node`` names its
    set (equal sets have the same) and ``component`` the sets that links connect.

    ``percent`` is 80 to 100. component_id is the smallest id that links reach (NULL ids count as none: a component of NULL ids has NULL).
    NULL, empty and wordless texts have no shingles and are linked with nothing: ``component`` is NULL, component_id their own id.
    Rows with equal sets are linked, repeated rows too; an empty table gives no rows; other columns are ignored.
    Shingles and sets are told apart by 64 bits of hash; links are verified on the shingles' hashes.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent is 80 to 100")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    read = materialize(_sets(texts, k), "jaccard")
    rows = read.where("node is not null").select("doc_id", "th", "n", "node")
    nodes = materialize(read.where("n > 0").groupBy("node", "n").agg(F.min("bits").alias("bits"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "jaccard")
    rank = order_of(read.where("chunk is not null").select("chunk", "counts"))
    prefixes = materialize(_prefixes(texts, rank, k, percent, levels).distinct(), "jaccard")
    holders = materialize(prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "jaccard")
    most = F.element_at(F.array(*[F.lit(c) for _, c in levels], F.lit(1)), F.col("level") + 1)
    usual = F.when(F.col("holders") <= frequent[0], 1).when(F.col("holders") <= frequent[1], 2).otherwise(3)
    kind = F.least("usual", most)
    shared = (meet(prefixes, holders.withColumn("usual", usual), ["token"], "holders").groupBy("node", "level")
              .agg(F.collect_list(F.struct(kind.alias("class"), "token")).alias("tokens")))
    members = materialize(_keys(shared.join(nodes.select("node", "n", "bits"), "node")), "jaccard")
    discard(prefixes)
    discard(holders)
    free_shuffles(spark)
    tasks = _dealt(members, F.lit(1), part_sets)
    edges = materialize(_tasks(tasks, _by_bitmap(percent), ["bits"]).groupBy("u", "v").agg(F.min("s").alias("s")), "jaccard")
    free_shuffles(spark)
    judged = materialize(_verified(texts, edges, k, percent), "jaccard")
    links = judged.where("ok")
    found = materialize(_components(nodes, judged), "jaccard")
    wrong = found.join(judged.where("not ok").select(F.col("u").alias("node")).distinct(), "node").select("component").distinct()
    doubtful = found.join(wrong, "component", "left_semi").select("node")
    if not wrong.isEmpty():
        # connections that do hold; a key needs another look if it is not small (of small ones all pairs are judged) and has sets of several of them
        now = materialize(_components(nodes, links), "jaccard")
        marked = doubtful.join(now, "node", "left").select("node", F.coalesce("component", "node").alias("label"))
        large = members.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > _SMALL)
        again = materialize(members.select("sig", "node", "n").join(large.select("sig"), "sig", "left_semi").join(marked, "node"), "jaccard")
        several = again.groupBy("sig").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("sig")
        again = materialize(again.join(several, "sig", "left_semi"), "jaccard")
        discard(members)
        free_shuffles(spark)
        sets = materialize(_fetched(texts, again.select("node").distinct(), k).select("node", "tokens"), "jaccard")
        exact = _tasks(_dealt(again, F.col("n"), part_tokens).join(sets, "node"), _by_set(percent), ["label", "tokens"])
        links = materialize(links.select("u", "v").unionByName(exact.select("u", "v")).distinct(), "jaccard")
        found = materialize(_components(nodes, links), "jaccard")
    own = nodes.join(found, "node", "left").select("node", "rep", "rows", F.coalesce("component", "node").alias("component"))
    least = own.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("held"))
    labels = materialize(meet(own, materialize(least, "jaccard"), ["component"], "held").select("node", "component", "component_id", "rows"), "jaccard")
    free_shuffles(spark)
    named = meet(rows.where("n > 0"), labels, ["node"], "rows")
    blank = rows.where("n = 0").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    columns = ["doc_id", "th", F.col("n").alias("n_shingles"), "node", "component", "component_id"]
    return named.select(*columns).unionByName(blank.select(*columns))


def oracle(table: str = "documents") -> str:
    """DuckDB text of the query's result over ``table`` (unique ids)."""
    return rf"""
        with recursive w as (
          select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from {table}),
        s as materialized (
          select doc_id, list_sort(list_distinct(case when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
                 else list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) end)) as s
          from w where len(w) > 0),
        classes as materialized (select min(doc_id) as rep, s, len(s) as n from s group by s),
        t as materialized (select rep, n, unnest(s) as t from classes),
        links as materialized (
          select a.rep as u, b.rep as v from t a join t b on a.t = b.t and a.rep <> b.rep and 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
          group by a.rep, a.n, b.rep, b.n having 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
        reach as (select rep as a, rep as b from classes union select reach.a, links.v from reach join links on links.u = reach.b),
        least_ as (select a, min(b) as component_id from reach group by a)
        select {table}.doc_id, coalesce(len(s.s), 0)::bigint as n_shingles, coalesce(component_id, {table}.doc_id) as component_id
        from {table} left join s using (doc_id) left join classes using (s) left join least_ on least_.a = classes.rep"""
