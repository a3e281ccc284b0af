"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers are runs of K words, each numbered by its earlier occurrences
(``occurrence``). For each of M signature parts, L orders each select the
minimal numbered k-mer; the selected ones are put in text order and the tuple
is hashed. Two texts agree on a part if the selected k-mers are the same and
stand in the same order, so the share of equal parts falls with the edit
distance, also when words only change places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import free_shuffles, partitions
from larder.session import materialize

K, M, L = 2, 32, 2
#: Tasks per shuffle partition for the k-mer rows, which are many times the text's size.
SPREAD = 4
_POS = (1 << 31) - 1
#: Stands for the NULL id.
_NULL = -(1 << 63)
_WS = " \t\n\x0b\f\r"


def _kmers(text: Column, k: int) -> Column:
    """Hash of each k-mer in text order; fewer than ``k`` words are one k-mer, none give an empty array."""
    words = F.split(F.btrim(text, F.lit(_WS)), "[ \\t-\\r]+")

    def hashed(w: Column) -> Column:
        if k == 2:
            several = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.xxhash64(a, b))
        else:
            several = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(k))))
        return (F.when((F.size(w) == 1) & (w[0] == ""), F.array().cast("array<bigint>"))
                .when(F.size(w) < k, F.array(F.xxhash64(w))).otherwise(several))

    return F.transform(F.array(words), hashed)[0]  # the split text is bound once


def signatures(texts: DataFrame, keys: list[str], text_cols: list[str], k: int = K, m: int = M, l: int = L) -> DataFrame:  # noqa: E741
    """``keys`` and for each text column ``c`` its signature ``c_sig`` (``m`` numbers of 31 bits).

    One row per key; partition ``texts`` by keys (or part of them) beforehand and
    the k-mer rows move no further: numbering and minima run where they are made.
    """
    which = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), _kmers(F.col(c), k).alias("t")) for v, c in enumerate(text_cols)]))
    rows = (texts.select(*keys, which.alias("x")).select(*keys, "x.v", F.posexplode_outer("x.t").alias("pos", "kmer")))
    same = Window.partitionBy("kmer", *keys, "v").orderBy("pos")
    numbered = rows.withColumn("one", F.xxhash64("kmer", F.row_number().over(same)))
    # an order's value of a k-mer: 33 bits of hash, then the 31 of its place
    value = [F.xxhash64("one", F.lit(j)).bitwiseAND(F.lit(~_POS)).bitwiseOR(F.col("pos").cast("long")) for j in range(m * l)]
    least = [F.min(F.when(F.col("kmer").isNotNull(), v)).alias(f"m{j}") for j, v in enumerate(value)]
    found = numbered.groupBy(*keys, "v").agg(*least)

    def part(i: int) -> Column:
        picked = F.sort_array(F.array(*[
            F.struct(F.col(f"m{j}").bitwiseAND(F.lit(_POS)).alias("at"), F.lit(s).alias("s"), F.shiftright(f"m{j}", 31).alias("h"))
            for s, j in enumerate(range(i * l, i * l + l))]))
        return F.shiftrightunsigned(F.xxhash64(F.transform(picked, lambda x: F.struct(x["s"], x["h"]))), 33).cast("int").alias(f"p{i}")

    sig = found.select(*keys, "v", F.array(*[part(i) for i in range(m)]).alias("sig"))
    return sig.groupBy(*keys).agg(*[F.first(F.when(F.col("v") == v, F.col("sig")), ignorenulls=True).alias(f"{c}_sig")
                                    for v, c in enumerate(text_cols)])


def likeness(a: Column, b: Column, l: int = L) -> Column:  # noqa: E741
    """The ``l``-th root of the share of equal parts: a part is equal if ``l`` k-mers are, so the
    root estimates the share of numbered k-mers in common (less where their order differs)."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.pow(equal.cast("double") / F.size(a), F.lit(1.0 / l))


def to_hex(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def following(docs: DataFrame) -> DataFrame:
    """``(did, th, need, next_id, next_th)`` for each distinct text of each id: the next id in descending
    order (after the last, the first) and the smallest text hash there, and how many of that text's
    characters are needed."""
    texts = materialize(docs.groupBy("did", "th").agg(F.max(F.expr("char_length(text) div 3").cast("int")).alias("need")), "order-minhash")
    ids = texts.groupBy("did").agg(F.min("th").alias("least"))
    ranged = materialize(ids.repartitionByRange(partitions(docs.sparkSession), F.col("did").desc())
                         .withColumn("p", F.spark_partition_id()), "order-minhash")
    # one row per partition of the step before
    before = ranged.groupBy("p").count().withColumn("before", F.sum("count").over(
        Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))).select("p", F.coalesce("before", F.lit(0)).alias("before"))
    total = ranged.count()
    at = (ranged.join(F.broadcast(before), "p")
          .withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy(F.col("did").desc())) - 1))
    after = at.select(F.col("did").alias("next_id"), F.col("least").alias("next_th"), F.pmod(F.col("at") - 1, F.lit(max(total, 1))).alias("at"))
    return texts.join(at.join(after, "at").select("did", "next_id", "next_th"), "did").select("did", "th", "need", "next_id", "next_th")


def edited(docs: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """``(did, th, text, copies, edited)``: the last third of each text replaced by the start of the next id's text.

    Rows equal in id and text are one row with their number in ``copies``; of an id's several
    texts, the one with the smallest hash is what the id before it takes from. Partitioned by
    ``did`` and ``th``: whole texts are exchanged once, and the starts taken from them once.
    """
    rows = (docs.repartition(parts, "did", "th").groupBy("did", "th")
            .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")))
    take = pairs.select(F.col("did").alias("to_id"), F.col("th").alias("to_th"), "need", F.col("next_id").alias("did"), F.col("next_th").alias("th"))
    starts = (take.repartition(parts, "did", "th").join(rows, ["did", "th"])
              .select(F.col("to_id").alias("did"), F.col("to_th").alias("th"), F.expr("substring(text, 1, need)").alias("start"))
              .repartition(parts, "did", "th"))
    kept = F.substring("text", F.lit(1), F.char_length("text") - F.expr("char_length(text) div 3").cast("int"))
    return rows.join(starts, ["did", "th"]).select("did", "th", "text", "copies", F.concat(kept, "start").alias("edited"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M, l: int = L) -> DataFrame:  # noqa: E741
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next`` for every row. Ids are integers, NULL is the smallest. NULL
    texts count as empty; texts without words share one fingerprint; one document alone is
    its own next; repeated rows repeat their result; an id's rows with different texts all
    have the next smaller id's text (of several, that with the smallest hash) as next; no
    rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = (docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .select("did", F.xxhash64("text").alias("th"), "text"))
    pairs = materialize(following(rows), "order-minhash")
    both = edited(rows, pairs, SPREAD * partitions(spark))
    facts = both.select("did", "th", "copies", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    # both sides lie by did and th already
    found = materialize(facts.join(signatures(both, ["did", "th"], ["text", "edited"], k, m, l), ["did", "th"]), "order-minhash")
    free_shuffles(spark)
    own = found.join(pairs, ["did", "th"])
    ahead = found.select(F.col("did").alias("next_id"), F.col("th").alias("next_th"), F.col("text_sig").alias("next_sig"))
    return (own.join(ahead, ["next_id", "next_th"])
            .select(F.nullif("did", F.lit(_NULL)).alias("doc_id"), "n_chars", "edited_sha256", to_hex(F.col("text_sig")).alias("fingerprint"),
                    to_hex(F.col("edited_sig")).alias("edited_fingerprint"),
                    likeness(F.col("text_sig"), F.col("edited_sig"), l).alias("near_edited"),
                    likeness(F.col("text_sig"), F.col("next_sig"), l).alias("near_next"),
                    F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")).drop("_copy"))
