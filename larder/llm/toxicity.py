"""Toxicity by a counterfactually regularised classifier.

Features are a text's words and the first PREFIXES bytes of its words, present
or not. Labelled texts in which identity terms stand are repeated with the
terms of their group swapped; the training loss is the logistic loss, a
quadratic penalty, and ``fairness`` times the squared change of the logit under
the swap. So what a text says decides, and naming a group does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import ALNUM_TABLE, Words, give_back, mix, text_bytes, text_slices
from larder.session import materialize, ship_package

#: Most labelled rows that the classifier is fitted on: those with the smallest hash of the id.
SAMPLE = 20_000
#: Features with most evidence (chi-squared against the label) that get a weight; all identity terms get one.
FEATURES = 4_096
#: A feature stands in at least so many texts of the sample.
MIN_TEXTS = 3
PREFIXES = (4, 5, 6)
FAIRNESS, RIDGE = 1.0, 1e-3
#: Groups of identity terms, swapped for one another.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist"), ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("black", "white", "asian", "latino", "arab"), ("african", "european", "american"),
    ("gay", "straight", "lesbian", "bisexual"), ("immigrant", "refugee", "native"), ("immigrants", "refugees", "natives"),
    ("disabled", "blind", "deaf"), ("old", "young"), ("transgender", "cisgender"),
)


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all words and prefixes, each once."""
    row = np.repeat(np.arange(len(words.first) - 1), words.counts)
    whole = words.hashes()
    size = words.end - words.start
    eight = np.ndarray(shape=(len(words.buf) - 7,), dtype="<u8", buffer=words.buf, strides=(1,))[words.start]
    rows, found = [row], [mix(whole)]
    for p in PREFIXES:
        long = size > p
        rows.append(row[long])
        found.append(mix((eight[long] & np.uint64((1 << (8 * p)) - 1)) + np.uint64(p)))
    return np.concatenate(rows), np.concatenate(found)


def _each_once(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])])[: len(row)]
    return row[new], feature[new]


def _terms(groups) -> dict[bytes, bytes]:
    """Each identity term and the next one of its group."""
    return {a.encode(): b.encode() for g in groups for a, b in zip(g, (*g[1:], g[0]), strict=True)}


def swap_terms(text: bytes, swaps: dict[bytes, bytes]) -> bytes | None:
    """The text's words with identity terms swapped; None if it has none."""
    words = text.translate(ALNUM_TABLE).split()
    if swaps.keys().isdisjoint(words):
        return None
    return b" ".join(swaps.get(w, w) for w in words)


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``(doc_id, text, toxic)`` of at most ``sample`` labelled ids, one row each: of an id's texts the one with the smallest hash, NULL if it has no other."""
    chosen = (labels.where("toxic is not null and doc_id is not null")
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.join(F.broadcast(chosen.withColumnRenamed("doc_id", "_l")), docs.doc_id == F.col("_l"))
    return rows.groupBy(docs.doc_id, "toxic").agg(F.min_by("text", F.when(F.col("text").isNotNull(), F.xxhash64("text"))).alias("text")).select("doc_id", "text", "toxic")


def _chosen(rows: DataFrame, identity: np.ndarray, features: int) -> np.ndarray:
    """The features to weigh, sorted."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                row, feature = _each_once(*_features(Words(text_bytes(part), ALNUM_TABLE)))
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)[row]
                each, at = np.unique(feature, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(np.bincount(at, minlength=len(each))), pa.array(np.bincount(at, weights=toxic, minlength=len(each)).astype(np.int64))], names=["feature", "n", "toxic"])

    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = whole["n"], whole["toxic"] or 0
    if not n or toxic in (0, n):
        return np.unique(identity)
    a, b = F.col("toxic"), F.col("n")
    expected = b * (toxic / n)
    evidence = (a - expected) * (a - expected) / (expected * (n - b + 1))
    best = (rows.select("text", "toxic").mapInArrow(count, "feature long, n long, toxic long")
            .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= MIN_TEXTS)
            .orderBy(evidence.desc(), "feature").limit(features).select("feature").collect())  # a documented bound
    return np.unique(np.concatenate([np.array([r[0] for r in best], dtype=np.int64).view(np.uint64), identity]))


def _rows_of(rows: DataFrame, vocabulary: np.ndarray, swaps: dict[bytes, bytes]) -> list:
    """(toxic, features, features after the swap or NULL) of each sampled row, features as places in the vocabulary."""
    def known(texts: list[bytes | None]) -> list[np.ndarray]:
        row, feature = _each_once(*_features(Words(texts, ALNUM_TABLE)))
        at = np.minimum(np.searchsorted(vocabulary, feature), len(vocabulary) - 1)
        hit = vocabulary[at] == feature if len(vocabulary) else np.zeros(len(feature), dtype=bool)
        return np.split(at[hit], np.searchsorted(row[hit], np.arange(1, len(texts))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts = text_bytes(part)
                swapped = [swap_terms(t or b"", swaps) for t in texts]
                other = known([s or b"" for s in swapped])
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic").cast(pa.int32()), pa.array([x.tolist() for x in known(texts)], pa.list_(pa.int32())),
                     pa.array([x.tolist() if s is not None else None for x, s in zip(other, swapped, strict=True)], pa.list_(pa.int32()))], names=["toxic", "x", "swapped"])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, x array<int>, swapped array<int>").collect()  # at most SAMPLE rows


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    size = [len(x) for x in lists]
    return np.repeat(np.arange(len(lists)), size), np.fromiter((i for x in lists for i in x), dtype=np.int64, count=sum(size))


def _descend(data: list, n_features: int, fairness: float, ridge: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the bounded sample."""
    y = np.array([r["toxic"] for r in data], dtype=float)
    n = len(y)
    w, bias = np.zeros(n_features), 0.0
    if not n or y.min() == y.max():
        return w, (8.0 if n and y.min() == 1 else -8.0)
    row, col = _flat([r["x"] for r in data])
    pairs = [(r["x"], r["swapped"]) for r in data if r["swapped"] is not None]
    r1, c1 = _flat([p[0] for p in pairs])
    r2, c2 = _flat([p[1] for p in pairs])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5  # halfway to balanced classes
    bias = float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    # each weight is stepped by its own bound of the curvature
    at = np.bincount(row, minlength=n)
    bound = np.bincount(col, weights=(weight * (at + 1))[row] * 0.25 / n, minlength=n_features) + ridge + 1e-9
    if pairs:
        wide = np.bincount(r1, minlength=len(pairs)) + np.bincount(r2, minlength=len(pairs))
        bound += 2 * fairness / n * (np.bincount(c1, weights=wide[r1], minlength=n_features) + np.bincount(c2, weights=wide[r2], minlength=n_features))
    bias_bound = float((weight * (at + 1)).mean() * 0.25)
    v, vb = w.copy(), bias
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=v[col], minlength=n) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.bincount(col, weights=g[row], minlength=n_features) + ridge * v
        if pairs:
            change = np.bincount(r1, weights=v[c1], minlength=len(pairs)) - np.bincount(r2, weights=v[c2], minlength=len(pairs))
            change *= 2 * fairness / n
            grad += np.bincount(c1, weights=change[r1], minlength=n_features) - np.bincount(c2, weights=change[r2], minlength=n_features)
        new, new_bias = v - grad / bound, vb - g.sum() / bias_bound
        pace = (step - 1) / (step + 2)
        v, vb = new + pace * (new - w), new_bias + pace * (new_bias - bias)
        w, bias = new, new_bias
    return w, bias


class Classifier:
    """Fitted weights: sorted feature hashes, their weights, the bias."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, bias: float):
        used = np.abs(weights) > 1e-9
        self.vocabulary, self.weights, self.bias = vocabulary[used], weights[used], bias
        # most features have no weight: their low bits tell so at once
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[self.vocabulary & np.uint64(0xFFFF)] = True

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        row, feature = _features(Words(texts, ALNUM_TABLE))
        if len(self.vocabulary):
            maybe = self.maybe[feature & np.uint64(0xFFFF)]
            row, feature = row[maybe], feature[maybe]
            at = np.minimum(np.searchsorted(self.vocabulary, feature), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == feature
            row, at = _each_once(row[hit], at[hit])
            z += np.bincount(row, weights=self.weights[at], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, groups=IDENTITY_TERMS, sample: int = SAMPLE, features: int = FEATURES,
        fairness: float = FAIRNESS, ridge: float = RIDGE) -> Classifier:
    """Classifier of ``docs(doc_id, text)`` after ``labels(doc_id, toxic)``, fitted on at most ``sample`` labelled rows.

    Ids that are NULL or without a label or document are not learnt from; of several labels of
    one id, toxic holds, of several texts the one with the smallest hash. With one class only, or none, the score is constant.
    """
    ship_package(docs.sparkSession)
    swaps = _terms(groups)
    identity = np.unique(mix(Words(sorted(swaps)).hashes())) if swaps else np.zeros(0, dtype=np.uint64)
    rows = materialize(_sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), sample), "toxicity")
    vocabulary = _chosen(rows, identity, features)
    weights, bias = _descend(_rows_of(rows, vocabulary, swaps), len(vocabulary), fairness, ridge)
    return Classifier(vocabulary, weights, bias)


def score(docs: DataFrame, model: Classifier, name: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity after its columns; NULL texts score as empty ones.

    A column of ``docs`` called ``name`` gives way.
    """
    ship_package(docs.sparkSession)
    spark: SparkSession = docs.sparkSession
    given = docs.drop(name)
    held = spark.sparkContext.broadcast(model)  # at most FEATURES weights and the identity terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held.value.scores(text_bytes(part)))], names=[*part.schema.names, name])
        give_back()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    return given.mapInArrow(run, f"{kinds}, {name} double")
