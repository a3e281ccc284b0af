"""Importance resampling towards a target distribution, weighed by bit-sliced aggregation.

A document's features are its runs of words, hashed into BUCKETS buckets. The
gain of a bucket says how much more often it occurs in the target than in the
documents; a document's weight is the sum of its features' gains, which a
seeded Gumbel draw turns into a score. The highest scores are drawn.

Weights are sums over bit planes: bit i of a document's bucket counts is a
plane of BUCKETS bits, bit j of the gains (two's complement) is another. The
bits that both have set, times 2^(i+j), add up to the exact weight; the gains'
sign plane counts negatively.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import ALNUM_TABLE, Words, give_back, inside, partitions, text_bytes, text_slices
from larder.llm.histogram_sort import MAX_PARTS, part_of, splitters
from larder.session import materialize, ship_package

BUCKETS = 10_000
#: Features are runs of 1 to RUNS words.
RUNS = 1
SEED = 2024
#: Per cent of the documents with MIN_WORDS words or more that are drawn.
PERCENT, MIN_WORDS = 10, 20
#: Rows of a range that one task ranks, and copies of one row that one task writes, at most.
RANGE_ROWS = 1_000_000
#: Words of more bytes are hashed one by one.
_LONG = 64
#: A NULL id stands after all others.
_LAST = (1 << 63) - 2


def _crc_table() -> np.ndarray:
    """Remainders of the 256 bytes for the reflected CRC-32 polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _crc_words(state: np.ndarray, w: Words, first: int) -> np.ndarray:
    """CRC states after the words from number ``first`` on have been added to ``state``."""
    at, end = w.start[first:].copy(), w.end[first:]
    out = state.copy()
    for i in np.flatnonzero(end - at > _LONG).tolist():
        out[i] = zlib.crc32(w.buf[at[i]: end[i]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        at[i] = end[i]
    live = np.flatnonzero(at < end)
    while len(live):
        s = out[live]
        out[live] = _CRC[(s ^ w.buf[at[live]]) & 0xFF] ^ (s >> 8)
        at[live] += 1
        live = live[at[live] < end[live]]
    return out


def features(w: Words, runs: int = RUNS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each run of 1 to ``runs`` words, joined by single spaces: CRC-32 modulo ``buckets``."""
    n = len(w.start)
    of = np.repeat(np.arange(len(w.first) - 1), w.counts)
    state, texts, found = np.full(n, 0xFFFFFFFF, dtype=np.uint32), [], []
    for r in range(min(runs, n)):
        if r:
            state = _CRC[(state[:-1] ^ 32) & 0xFF] ^ (state[:-1] >> 8)
        state = _crc_words(state, w, r)
        ok = inside(w.first, n, r + 1)
        texts.append(of[: n - r][ok])
        found.append((state[ok] ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % buckets)
    if not texts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(texts), np.concatenate(found)


def bucket_counts(texts: DataFrame, text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> list[int]:
    """Features of all ``texts`` in each bucket; ``buckets`` numbers come to the driver."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in text_slices(batch):
                total += np.bincount(features(Words(text_bytes(part), ALNUM_TABLE), runs, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
        give_back()

    found = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * buckets
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(own: list[int], target: list[int]) -> list[int]:
    """A bucket's gain: 1000 times the logarithm of how much more likely the target has it, both counts raised by one; floored."""
    n, s, t = len(own), sum(own), sum(target)
    return [math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(own, target, strict=True)]


def gain_planes(gain: list[int]) -> list[np.ndarray]:
    """Bit planes of the gains in two's complement, 64 buckets a word; the last is the sign's."""
    g = np.array(gain, dtype=np.int64)
    bits = max(int(abs(v)).bit_length() for v in [*gain, 1]) + 1
    words = -(-len(g) // 64)
    out = []
    for j in range(bits):
        plane = np.zeros(words * 64, dtype=np.uint8)
        plane[: len(g)] = (g >> j) & 1
        out.append(np.packbits(plane, bitorder="little").view("<u8"))
    return out


def weights(of: np.ndarray, bucket: np.ndarray, n_texts: int, planes: list[np.ndarray]) -> np.ndarray:
    """Sum of the gains of each text's features, from the planes of its counts and of the gains.

    Of a count plane only words that hold a set bit are kept.
    """
    out = np.zeros(n_texts, dtype=np.int64)
    wide = len(planes[0]) * 64
    key, count = np.unique(of * wide + bucket, return_counts=True)
    i = 0
    while len(key):
        on = (count >> i) & 1 == 1
        if on.any():
            word = key[on] >> 6
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            held = np.bitwise_or.reduceat(np.uint64(1) << (key[on] & 63).astype(np.uint64), first)
            text, at = np.divmod(word[first], len(planes[0]))
            add = np.zeros(len(held), dtype=np.int64)
            for j, plane in enumerate(planes):
                both = np.bitwise_count(held & plane[at]).astype(np.int64) << (i + j)
                add += -both if j == len(planes) - 1 else both
            np.add.at(out, text, add)
        i += 1
        more = count >> i > 0
        key, count = key[more], count[more]
    return out


def weigh(rows: DataFrame, gain: list[int], runs: int = RUNS) -> DataFrame:
    """``rows`` without ``text`` and with ``n_words``, ``n_features`` and ``weight``."""
    spark = rows.sparkSession
    ship_package(spark)
    keys = [f for f in rows.schema.fields if f.name != "text"]
    held = spark.sparkContext.broadcast(gain_planes(gain))  # a few bits for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = held.value
        for batch in batches:
            for part in text_slices(batch):
                w = Words(text_bytes(part), ALNUM_TABLE)
                of, bucket = features(w, runs, len(gain))
                n = np.bincount(of, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in keys), pa.array(w.counts), pa.array(n), pa.array(weights(of, bucket, part.num_rows, planes))],
                    names=[*(f.name for f in keys), "n_words", "n_features", "weight"])
        give_back()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    return rows.mapInArrow(run, f"{kinds}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel draw, floored, that seed and id decide (a NULL id as the empty text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, want: int) -> DataFrame:
    """``rows(doc_id, score, n, ...)`` with ``before``: the copies ahead of each by (score downwards, doc_id, other columns), or NULL from ``want`` on.

    A row stands for ``n`` copies. Exact counts cut the order into ranges; ranges that begin before ``want`` are sorted, each in a task.
    """
    spark = rows.sparkSession
    keyed = rows.withColumns({"key": -F.col("score"), "tie": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))})
    keys = keyed.select("key", "tie", F.col("n").alias("size"))
    total = keys.count()
    parts = min(max(partitions(spark), -(-total // RANGE_ROWS)), MAX_PARTS)
    bounds, _, _ = splitters(keys, parts, tolerance=0.1)
    below = [0] + [b.bytes for b in bounds]
    reach = F.expr("part.offset") < want
    placed = keyed.withColumn("part", part_of(bounds, below)("key", "tie"))
    order = Window.partitionBy("part").orderBy("key", "tie", *[c for c in rows.columns if c not in ("doc_id", "score")])
    sorted_rows = (placed.where(reach).select(*rows.columns, "key", "tie", F.col("part.part").alias("part"), F.col("part.offset").alias("offset"))
                   .withColumn("before", F.col("offset") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")))
    return (sorted_rows.select(*rows.columns, F.when(F.col("before") < want, F.col("before")).alias("before"))
            .unionByName(placed.where(~reach).select(*rows.columns, F.lit(None).cast("long").alias("before"))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             percent: int = PERCENT, min_words: int = MIN_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, th, n_words, n_features, weight, score, rank`` for every row of ``docs``; ``th`` is the text's hash, ``rank`` NULL where not drawn.

    Of the rows with ``min_words`` words or more, ``percent`` per cent (floored) with the highest scores are drawn, ties to
    the smaller integer id (NULL last), then by words, features, weight and text hash; repeated rows are drawn one by one and get ranks that
    follow one another. NULL, empty and wordless texts have no features and weight 0; an empty target or table gives
    the counts 0 that the formula takes; other columns are ignored. Counts are taken over all texts.
    """
    gain = gains(bucket_counts(docs, text_col, runs, buckets), bucket_counts(target, target_text_col, runs, buckets))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    own = ["doc_id", "th", "n_words", "n_features", "weight"]
    scored = materialize(weigh(rows, gain, runs).groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
                         .withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance")
    enough = F.col("n_words") >= min_words
    many = scored.where(enough).agg(F.sum("n")).first()[0] or 0
    want = percent * many // 100
    placed = ranked(scored.where(enough), want).unionByName(scored.where(~enough).withColumn("before", F.lit(None).cast("long")))
    return copies(placed, want).select(*own, "score", "rank")


def copies(placed: DataFrame, want: int, most: int = RANGE_ROWS) -> DataFrame:
    """Each row ``n`` times, with ``rank`` from ``before`` on and up to ``want``; over ``most`` copies are dealt to more tasks."""
    few = placed.where(F.col("n") <= most).withColumns({"low": F.lit(0).cast("long"), "high": F.col("n") - 1})
    many = (placed.where(F.col("n") > most).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long"))))
            .withColumn("high", F.least(F.col("low") + (most - 1), F.col("n") - 1)).repartition(partitions(placed.sparkSession), "before", "low"))
    rank = F.col("before") + F.col("i") + 1
    return (few.unionByName(many).withColumn("i", F.explode(F.sequence("low", "high")))
            .withColumn("rank", F.when(rank <= want, rank)))


def oracle(docs: str = "documents", target: str = "benchmark") -> str:
    """DuckDB text of the query's result over the tables (runs of one word)."""
    words = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        with table_ as (
          select list(c order by i) as t from (
            select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
            from range(256) r(i))),
        d as materialized (select doc_id, {words.format(t="coalesce(text, '')")} as w from {docs}),
        b as materialized (select unnest({words.format(t="coalesce(text, '')")}) as w from {target}),
        u as materialized (select doc_id, w, count(*) as n from (select doc_id, unnest(w) as w from d) group by doc_id, w),
        vocabulary as (select distinct w from (select w from u union all select w from b)),
        hashed as materialized (
          select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))),
                 lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket
          from vocabulary, table_),
        own as (select bucket, sum(n) as n from u join hashed using (w) group by bucket),
        aim as (select bucket, count(*) as n from b join hashed using (w) group by bucket),
        gain as (
          select r.bucket, floor(1000 * ln((coalesce(aim.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from own) + {BUCKETS})::double
                 / ((coalesce(own.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from aim) + {BUCKETS})::double)))::bigint as g
          from range({BUCKETS}) r(bucket) left join own on own.bucket = r.bucket left join aim on aim.bucket = r.bucket),
        weight as (select doc_id, sum(n * g) as weight from u join hashed using (w) join gain using (bucket) group by doc_id),
        scored as (
          select d.doc_id, len(d.w) as n_features, coalesce(weight, 0)::bigint as weight, coalesce(weight, 0)::bigint
                 + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
          from d left join weight using (doc_id)),
        drawn as (
          select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= {MIN_WORDS}
          qualify rank <= (select {PERCENT} * count(*) // 100 from scored where n_features >= {MIN_WORDS}))
        select s.doc_id, s.n_features::bigint as n_features, s.weight, s.score, drawn.rank from scored s left join drawn using (doc_id)"""
