"""Benchmark decontamination by winnowing.

A run of SPAN words that a document shares with a benchmark item holds at least
one k-gram (KGRAM words) that winnowing selects in both, since every window of
``SPAN - KGRAM + 1`` k-grams keeps its smallest hash. Selected k-grams are
joined by hash; each hit is then extended word by word to both sides, as far as
a run of SPAN words can reach, and counts if SPAN equal words in a row come out.
Items of fewer than SPAN words are one window: their own whole length takes the
place of both numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import ALNUM_TABLE, Words, give_back, grams, inside, signed, text_bytes, text_slices, winnow
from larder.session import materialize, ship_package

SPAN, KGRAM = 10, 5
#: Size of the bitmap that tells documents' tasks which k-grams no item has; fixed, whatever the items.
FILTER_BITS = 1 << 24
#: Characters of a word after A-Z are lowered.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The text's words, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"({_WORD})"), F.lit(1))


def filter_of(hashes: DataFrame) -> np.ndarray:
    """Bitmap of FILTER_BITS bits, one set for each of ``hashes(hash)``; at most FILTER_BITS / 64 rows come to the driver."""
    at = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    found = (hashes.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast((hash & {63}) as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in found:
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def anchors(texts: DataFrame, lengths: list[int], span: int = SPAN, k: int = KGRAM, only: np.ndarray | None = None) -> DataFrame:
    """Rows ``(key columns, n_words, len, pos, hash, lead, around)`` of ``texts(keys..., text)``.

    One row for each text, with ``len`` NULL; then one for each selected k-gram, with ``span`` as ``len`` for the
    winnowed ones and each of ``lengths`` for the runs of exactly so many words. ``around``: the words from ``lead``
    words before the k-gram, as far as a run of ``span`` words with it can reach. ``only``: a bitmap as ``filter_of``
    makes; k-grams whose bit is not set are left out.
    """
    spark = texts.sparkSession
    ship_package(spark)
    keys = [c for c in texts.columns if c != "text"]
    held = spark.sparkContext.broadcast(only)  # FILTER_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                w = Words(text_bytes(part), ALNUM_TABLE)
                h, n = w.hashes(), len(w.start)
                of = np.repeat(np.arange(part.num_rows), w.counts)

                def rows(row, size, at, value, lead, around, part=part, w=w):
                    return pa.RecordBatch.from_arrays(
                        [*(part.column(c).take(pa.array(row)) for c in keys), pa.array(w.counts[row]), pa.array(size, pa.int32()), pa.array(at, pa.int32()),
                         pa.array(value, pa.int64()), pa.array(lead, pa.int32()), pa.array(around, pa.binary()).cast(pa.string())],
                        names=[*keys, "n_words", "len", "pos", "hash", "lead", "around"])

                none = [None] * part.num_rows
                yield rows(np.arange(part.num_rows), none, none, none, none, none)
                gram = grams(h, k)
                pick = np.unique(winnow(gram, span - k + 1)[inside(w.first, n, span)])
                found = [(pick, gram[pick], span, k, span - k)]
                for size in lengths:
                    at = np.flatnonzero(inside(w.first, n, size))
                    found.append((at, grams(h, size)[at], size, size, 0))
                for at, value, size, width, reach in found:
                    if held.value is not None:
                        bit = value & np.uint64(FILTER_BITS - 1)
                        hit = (held.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                        at, value = at[hit], value[hit]
                    row = of[at]
                    begin, end = np.maximum(at - reach, w.first[row]), np.minimum(at + width + reach, w.first[row + 1])
                    around = [b" ".join(w.text(i, j).split()) for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
                    if len(at):
                        yield rows(row, np.full(len(at), size), at - w.first[row], signed(value), at - begin, around)
        give_back()

    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keys)
    return texts.mapInArrow(run, f"{kinds}, n_words long, len int, pos int, hash long, lead int, around string")


def _parts(span: int, k: int) -> Column:
    """Struct of a row's k-gram and the words before (nearest first) and after it."""
    size = F.when(F.col("len") == span, F.lit(k)).otherwise(F.col("len"))

    def cut(w: Column) -> Column:
        return F.struct(F.slice(w, F.col("lead") + 1, size).alias("gram"), F.reverse(F.slice(w, F.lit(1), F.col("lead"))).alias("left"),
                        F.slice(w, F.col("lead") + size + 1, F.lit(span)).alias("right"))

    return F.transform(F.array(F.split("around", " ")), cut)[0]


def _run_of_equal(a: Column, b: Column) -> Column:
    """How many leading elements two arrays have in common."""
    same = F.zip_with(a, b, lambda x, y: x == y)
    first = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    return F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1).cast("int")


def hits(marks: DataFrame, items: DataFrame, span: int = SPAN, k: int = KGRAM) -> DataFrame:
    """``(doc_id, th, item_id, from, to)``: runs of document words (positions from to before to) equal to item words.

    ``marks``: the documents' anchors, ``items``: the items'; every run of ``span`` words, and every whole shorter
    item, is inside one. Words are compared, not hashes.
    """
    gram_size = F.when(F.col("len") == span, F.lit(k)).otherwise(F.col("len"))
    left = marks.select("doc_id", "th", "len", "hash", "pos", _parts(span, k).alias("x"))
    right = items.select("item_id", "len", "hash", _parts(span, k).alias("y")).distinct()
    met = (left.join(right, ["len", "hash"]).where("x.gram = y.gram")
           .withColumn("back", _run_of_equal(F.col("x.left"), F.col("y.left")))
           .withColumn("on", _run_of_equal(F.col("x.right"), F.col("y.right")))
           .where(F.col("back") + gram_size + F.col("on") >= F.col("len")))
    return met.select("doc_id", "th", "item_id", (F.col("pos") - F.col("back")).alias("from"),
                      (F.col("pos") + gram_size + F.col("on")).alias("to"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = KGRAM) -> DataFrame:
    """``doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated`` for every document row.

    NULL and wordless texts have no words and no hits; items without words occur
    nowhere, items with NULL id hit words but are not counted as items; repeated
    documents repeat their result, repeated items count once; empty tables give no
    rows or no hits; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    bench = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    # less than span distinct values
    lengths = sorted(r[0] for r in bench.select(F.size(words(F.col("text"))).alias("n")).where((F.col("n") > 0) & (F.col("n") < span)).distinct().collect())
    known = materialize(anchors(bench, lengths, span, k).where(F.col("len") == F.least("n_words", F.lit(span))), "winnowing")
    seen = materialize(anchors(rows, lengths, span, k, filter_of(known)), "winnowing")
    found = materialize(hits(seen.where("len is not null"), known, span, k), "winnowing")
    covered = (found.select("doc_id", "th", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("at")).distinct()
               .groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n_hit")))
    listed = (found.select("doc_id", "th", F.col("item_id").cast("string").alias("item")).distinct()
              .groupBy("doc_id", "th").agg(F.count("item").alias("n_items"), F.sort_array(F.collect_list("item")).alias("items")))
    same = covered.doc_id.eqNullSafe(listed.doc_id) & (covered.th == listed.th)
    marked = covered.join(listed, same).select(covered.doc_id.alias("d"), covered.th.alias("t"), "n_hit", "n_items", "items")
    counted = seen.where("len is null").select("doc_id", "th", "n_words")
    return (counted.join(marked, counted.doc_id.eqNullSafe(marked.d) & (counted.th == marked.t), "left")
            .select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))
