"""Substring dedup by seed and extend.

A repeated window of SPAN words holds a k-gram (KGRAM words) that winnowing
selects in every copy: the anchor. Consecutive windows that share one selected
anchor make up its stretch. Documents meet on anchors; a stretch is the anchor
extended both ways as far as its windows reach, so equal stretches (compared by
128 bits of hash) repeat all their windows at once and all but the earliest go.
Where an anchor meets different stretches, a repeat ends inside them: the
windows of the earliest stretch of each kind are then compared one by one.

No pairs are made: each kind of stretch or window keeps its earliest place, and
each slice of texts first drops its own later ones, so a passage that a third
of all documents share sends one row a slice. An anchor with HOT or more kinds
in a slice is compared by windows there, so its rows stay few as well.

Rows equal in id and text stand at the same places, and no place is later than
itself: they count as one row, once within a slice and as ties across slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import GRAM, Words, free_shuffles, grams, inside, mix, signed, text_bytes, text_slices, winnow
from larder.session import materialize, ship_package

SPAN, KGRAM = 20, 8
HOT = 8
#: Bytes of text whose repeats are dropped before anything is exchanged.
SLICE = 4 << 20
#: Rows: words that go, a stretch, a window, and the mark of an anchor compared by windows.
GONE, STRETCH, WINDOW, MARK = 0, 1, 2, 3
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_ROW = "k1 long, k2 long, did long, th long, pack long"


def _pack(start: np.ndarray, length: np.ndarray | int, kind: int) -> np.ndarray:
    """Start word, length in words (under 64) and kind in one number that sorts by start."""
    return (start.astype(np.int64) << 8) | (np.asarray(length, dtype=np.int64) << 2) | kind


def _batch(k1, k2, did, th, pack) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(k1)), pa.array(signed(k2)), pa.array(did), pa.array(th), pa.array(pack)],
                                      names=["k1", "k2", "did", "th", "pack"])


def _firsts(k1, k2, did, th, start) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and place, and a mask of each key's first in that order."""
    order = np.lexsort((start, th, did, k2, k1))
    a, b = k1[order], k2[order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(order)]


def _once(part: pa.RecordBatch) -> pa.RecordBatch:
    """The slice's rows without those that repeat an earlier one's id and text."""
    did, th = (part.column(c).to_numpy(zero_copy_only=False) for c in ("did", "th"))
    order = np.lexsort((th, did))  # stable: the first of equal rows comes first
    new = np.concatenate([[True], (did[order][1:] != did[order][:-1]) | (th[order][1:] != th[order][:-1])])[: len(order)]
    return part if new.all() else part.take(pa.array(np.sort(order[new])))


class _Slice:
    """Words of a slice of rows and the hashes of its windows."""

    def __init__(self, part: pa.RecordBatch, span: int):
        self.words = Words(text_bytes(part))
        self.hash = self.words.hashes()
        self.n = len(self.hash)
        self.row = np.repeat(np.arange(part.num_rows), self.words.counts)
        self.did = part.column("did").to_numpy(zero_copy_only=False)
        self.th = part.column("th").to_numpy(zero_copy_only=False)
        self.one, self.two = grams(self.hash, span), grams(mix(self.hash ^ _OTHER), span)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = self.row[at]
        return self.did[row], self.th[row], at - self.words.first[row]

    def gone(self, at: np.ndarray, length: np.ndarray | int) -> pa.RecordBatch:
        did, th, start = self.place(at)
        spread = mix(th.view(np.uint64) + start.view(np.uint64))
        return _batch(spread, spread, did, th, _pack(start, length, GONE))

    def windows(self, at: np.ndarray, span: int) -> Iterator[pa.RecordBatch]:
        """Rows of the windows at these words: the slice's first of each, the others as gone."""
        did, th, start = self.place(at)
        order, first = _firsts(self.one[at], self.two[at], did, th, start)
        yield self.gone(at[order[~first]], span)
        o = order[first]
        yield _batch(self.one[at[o]], self.two[at[o]], did[o], th[o], _pack(start[o], span, WINDOW))


def _stretches(part: pa.RecordBatch, span: int, k: int, hot: int) -> Iterator[pa.RecordBatch]:
    s = _Slice(part, span)
    valid = inside(s.words.first, s.n, span)
    if not valid.any():
        return
    gram = grams(s.hash, k)
    anchor = np.where(valid, winnow(gram, span - k + 1), -1)
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (s.row[1: len(anchor)] != s.row[: len(anchor) - 1])]))
    end = np.concatenate([begin[1:], [len(anchor)]])
    begin, end = begin[valid[begin]], end[valid[begin]]
    at, count = anchor[begin], end - begin
    # polynomial of the stretch's window hashes, from prefix sums (odd numbers have inverses modulo 2^64)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(s.one), GRAM)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(s.one), np.uint64(pow(int(GRAM), -1, 1 << 64)))]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(s.two * power[:-1])])
    kind = mix((total[end] - total[begin]) * back[begin] + mix((count * 64 + (at - begin)).astype(np.uint64)))
    seed = gram[at]
    did, th, start = s.place(begin)
    order, first = _firsts(seed, kind, did, th, start)
    later = order[~first]
    yield s.gone(begin[later], count[later] + span - 1)
    o = order[first]
    new = np.flatnonzero(np.concatenate([[True], seed[o][1:] != seed[o][:-1]]))
    kinds = np.diff(np.concatenate([new, [len(o)]]))
    many = np.repeat(kinds >= hot, kinds)
    p = o[~many]
    yield _batch(seed[p], kind[p], did[p], th[p], _pack(start[p], count[p] + span - 1, STRETCH))
    p = o[many]
    if len(p):
        marks = o[new][kinds >= hot]
        yield _batch(seed[marks], kind[marks], did[marks], th[marks], _pack(start[marks], 0, MARK))
        size = count[p]
        ends = np.cumsum(size)
        yield from s.windows(np.repeat(begin[p] - (ends - size), size) + np.arange(ends[-1]), span)


def _later(rows: DataFrame) -> DataFrame:
    """Rows with ``place``, 1 for the earliest of each kind of stretch or window and for all rows at its very place."""
    same = Window.partitionBy("k1", "w", "k2").orderBy("did", "th", F.shiftright("pack", 8))
    return rows.withColumn("place", F.rank().over(same))


def repeats(docs: DataFrame, span: int = SPAN, k: int = KGRAM, hot: int = HOT) -> DataFrame:
    """``(did, th, pack)``: the stretches of words (start << 8 | length << 2) covered by windows that also start earlier.

    docs: ``did`` (long, not NULL), ``th``, ``text``; earlier is by (did, th, start), and rows
    equal in did and th are one. A stretch of a repeated row may come more than once.
    """
    spark = docs.sparkSession
    ship_package(spark)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                yield from _stretches(_once(part), span, k, hot)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in map(_once, text_slices(batch, limit=SLICE)):
                s = _Slice(part, span)
                lists = part.column("packs")
                pack = lists.flatten().to_numpy(zero_copy_only=False)
                first = s.words.first[np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))]
                size = ((pack >> 2) & 63) - (span - 1)
                ends = np.cumsum(size)
                yield from s.windows(np.repeat(first + (pack >> 8) - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0), span)

    kind = F.col("pack").bitwiseAND(F.lit(3))
    made = docs.select("did", "th", "text").mapInArrow(seeds, _ROW).withColumn("w", kind == WINDOW)
    met = Window.partitionBy("k1", "w")
    stretch = F.when(kind == STRETCH, F.col("k2"))
    # an anchor that meets different stretches, or was compared by windows somewhere
    mixed = (F.coalesce(F.min(stretch).over(met) != F.max(stretch).over(met), F.lit(False)) | (F.max(kind).over(met) == MARK))
    first = materialize(
        _later(made.withColumn("mixed", mixed))
        .select("k1", "k2", "did", "th", "pack", "w",
                F.when((kind == GONE) | (kind.isin(STRETCH, WINDOW) & (F.col("place") > 1)), F.lit("gone"))
                .when(kind == WINDOW, F.lit("window")).when((kind == STRETCH) & F.col("mixed"), F.lit("split")).alias("what"))
        .where("what is not null"), "substring")
    free_shuffles(spark)
    wanted = first.where("what = 'split'").groupBy("did", "th").agg(F.collect_set("pack").alias("packs"))
    texts = docs.select("did", "th", "text").join(wanted, ["did", "th"])
    windows = (texts.mapInArrow(expand, _ROW).withColumn("w", kind == WINDOW)
               .unionByName(first.where("what = 'window'").drop("what")))
    second = materialize(_later(windows).where((kind == GONE) | (F.col("place") > 1)).select("did", "th", "pack"), "substring")
    free_shuffles(spark)
    return first.where("what = 'gone'").select("did", "th", "pack").unionByName(second)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, k: int = KGRAM, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row: the text without repeated passages, words joined by one space.

    Windows of ``span`` words that also start in a smaller id (NULL is the smallest;
    of one id's texts by text hash) or earlier in the same text lose their words.
    Ids are integers. NULL, empty and short texts lose nothing; of rows equal in id
    and text one keeps what the rule leaves it, the others lose all words if they
    hold a window; no rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("did"),
                       F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    found = repeats(rows, span, k, hot)
    cut = found.groupBy("did", "th").agg(F.collect_set("pack").alias("packs"))
    again = Window.partitionBy("did", "th").orderBy("did")
    joined = rows.join(cut, ["did", "th"], "left").withColumn("again", F.row_number().over(again) > 1)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts, packs = text_bytes(part), part.column("packs")
                again = part.column("again").to_pylist()
                count, removed, kept = [], [], []
                for i, t in enumerate(texts):
                    words = (t or b"").split()
                    n, gone = len(words), 0
                    if again[i] and n >= span:
                        words, gone = [], n
                    elif packs[i].is_valid:
                        p = packs[i].values.to_numpy(zero_copy_only=False)
                        depth = np.bincount(p >> 8, minlength=n + 1)[: n + 1] - np.bincount((p >> 8) + ((p >> 2) & 63), minlength=n + 1)[: n + 1]
                        stay = np.cumsum(depth)[:n] == 0
                        words, gone = list(compress(words, stay.tolist())), int(n - stay.sum())
                    count.append(n)
                    removed.append(gone)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                                 names=["doc_id", "n_words", "n_removed", "kept"])

    ship_package(spark)
    return joined.select("doc_id", "text", "packs", "again").mapInArrow(
        keep, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")
