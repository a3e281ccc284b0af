"""Importance resampling, Jaccard join and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import importance, jaccard_join, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def buckets(text, runs, n):
    w = words(text)
    return [zlib.crc32(" ".join(w[i: i + r]).encode()) % n for r in range(1, runs + 1) for i in range(len(w) - r + 1)]


def resampled(rows, target, percent, min_words, runs, n):
    """(doc_id, th, text) rows -> multiset of (doc_id, n_features, weight, score, rank)."""
    own, aim = Counter(), Counter()
    for _, _, t in rows:
        own.update(buckets(t, runs, n))
    for t in target:
        aim.update(buckets(t, runs, n))
    s, t = sum(own.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + n) / ((own[b] + 1) * (t + n)))) for b in range(n)]
    out = []
    for i, th, text in rows:
        found = buckets(text, runs, n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([len(words(text)), i, th, len(found), weight, score])
    enough = sorted((r for r in out if r[0] >= min_words), key=lambda r: (-r[5], r[1] is None, r[1] or 0, r[0], r[3], r[4], r[2]))
    want = percent * len(enough) // 100
    drawn = [(*r[1:2], *r[3:], k + 1) for k, r in enumerate(enough[:want])]
    rest = [(*r[1:2], *r[3:], None) for r in enough[want:] + [r for r in out if r[0] < min_words]]
    return Counter(drawn + rest)


@pytest.mark.parametrize("runs,percent,min_words", [(1, 10, 20), (2, 50, 3), (1, 100, 0)])
def test_resampling_equals_brute_force(spark, messy, runs, percent, min_words):
    target = spark.createDataFrame([("The cat 42 été",), (None,), ("x1 dog " * 30,)], "text string")
    got = importance.resample(messy, target, percent=percent, min_words=min_words, runs=runs, buckets=500)
    rows = [tuple(r) for r in messy.select("doc_id", F.xxhash64("text"), "text").collect()]
    want = resampled(rows, [r[0] for r in target.collect()], percent, min_words, runs, 500)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == want


def test_resampling_of_empty_tables(spark, messy):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, messy).count() == 0
    rows = [tuple(r) for r in messy.select("doc_id", F.xxhash64("text"), "text").collect()]
    got = importance.resample(messy, none)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == resampled(rows, [], 10, 20, 1, 10_000)


def test_copies_are_ranked_one_by_one(spark):
    placed = spark.createDataFrame([(1, 7, 3), (2, 1, 10), (3, 2, None)], "doc_id long, n long, before long")
    for most in (2, 100):
        got = importance.copies(placed, 9, most).select("doc_id", "rank").collect()
        assert Counter(tuple(r) for r in got) == Counter([(1, k) for k in (4, 5, 6, 7, 8, 9)] + [(1, None), (2, None), (3, None), (3, None)])


def test_bit_planes_give_exact_weights():
    rnd = np.random.default_rng(3)
    gain = [int(v) for v in rnd.integers(-9000, 9000, 130)] + [0, -1, 1, -(1 << 20), 1 << 20]
    of = np.sort(rnd.integers(0, 7, 20_000))
    bucket = rnd.integers(0, len(gain), 20_000) // rnd.integers(1, 60, 20_000)
    want = [sum(gain[b] for b in bucket[of == i]) for i in range(9)]
    assert importance.weights(of, bucket, 9, importance.gain_planes(gain)).tolist() == want


def test_long_words_and_table_of_remainders():
    from larder.llm.common import ALNUM_TABLE, Words
    texts = [b"a" * 1000, b"", None, b"b" * 64 + b" " + b"c" * 65 + "é".encode() * 40, b"x"]
    of, found = importance.features(Words(texts, ALNUM_TABLE), 2)
    got = sorted(zip(of.tolist(), found.tolist(), strict=True))
    assert got == sorted((i, b) for i, t in enumerate(texts) for b in buckets((t or b"").decode(), 2, 10_000))


# --- Jaccard join -----------------------------------------------------------------------------

def shingles(text, k=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    return frozenset(tuple(w[i: i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def joined(rows, percent, k=3):
    """(doc_id, text) rows -> multiset of (doc_id, n_shingles, component_id)."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return Counter((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def family(rnd, copies, n, edits, vocabulary):
    base = [rnd.choice(vocabulary) for _ in range(n)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rnd.randint(0, edits)):
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        yield " ".join(text)


@pytest.mark.parametrize("percent,how", [(90, {}), (90, {"frequent": (2, 5), "part_sets": 7, "part_tokens": 900}), (80, {"frequent": (1, 3), "levels": ((40, 3), (90, 2))}),
                                         (100, {"frequent": (2, 4)})])
def test_join_equals_brute_force(spark, percent, how):
    rnd = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "the", "A", "a"]
    texts = [t for n, edits, copies in ((8, 1, 6), (12, 1, 12), (40, 1, 25), (60, 2, 30), (110, 4, 20), (300, 9, 12)) for t in family(rnd, copies, n, edits, vocabulary)]
    texts += [texts[50] + " " + t for t in texts[:20]] + [texts[45]] * 5 + ["", None, " \n", "one", "One", "one two", "two one"]
    rows = [(i * 7 % 1000 if i % 19 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.classes(docs, percent=percent, **how).select("doc_id", "n_shingles", "component_id")
    assert Counter(tuple(r) for r in got.collect()) == joined(rows, percent)


def test_classes_of_shared_tokens_follow_their_holders(spark):
    """Texts of a common body and own tails: their shingles are of every class, met by broadcast and by shuffle."""
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{body} tail{i % 7}") for i in range(40)] + [(100 + i, f"own{i} text{i} of{i} row{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frequent in ((1, 3), (64, 4096)):
        got = jaccard_join.classes(docs, frequent=frequent).select("doc_id", "n_shingles", "component_id").collect()
        assert Counter(tuple(r) for r in got) == joined(rows, 90)


def test_join_of_messy_and_empty_rows(spark, messy):
    rows = [tuple(r) for r in messy.select("doc_id", "text").collect()]
    got = jaccard_join.classes(messy).select("doc_id", "n_shingles", "component_id")
    assert Counter(tuple(r) for r in got.collect()) == joined(rows, 90)
    assert jaccard_join.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        jaccard_join.classes(messy, percent=79)


def test_bitmaps_never_rule_out_a_link():
    rnd = np.random.default_rng(1)
    for size in (9, 130, 700, 2500):
        base = rnd.integers(0, 1 << 63, size * 2).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[:size], base[size: size + e]])[int(e * 0.4):]) for e in range(0, size // 8 + 1, max(1, size // 60))]
        sets.sort(key=len)
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        bits, n = jaccard_join.bitmaps(np.concatenate(sets), bounds), np.diff(bounds)
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                near = jaccard_join._Bitmaps(n, pa.array(bits, pa.binary()), 90).near(np.array([i]), np.array([j]))
                both = len(np.intersect1d(sets[i], sets[j]))
                assert near[0] or 100 * both < 90 * (n[i] + n[j] - both)


# --- vector codes -----------------------------------------------------------------------------

def codes(rows, parts, entries, rounds):
    """(vec_id, vector, label) rows -> codebooks and multiset of (vec_id, label, code, error, label_error)."""
    rows = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in rows), default=0) // parts)
    rows = [(i, v + [0] * (parts * width - len(v)), lab) for i, v, lab in rows]
    cut = [[tuple(v[p * width: (p + 1) * width]) for p in range(parts)] for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, rows[r][1]))[:entries]
    book = [[cut[r][p] for r in first] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(near(p, c[p])[1], []).append(c[p])
            book[p] = [tuple(sum(x) // len(x) for x in zip(*held[e], strict=True)) if e in held else c for e, c in enumerate(book[p])]
    out = []
    for (i, _, lab), c in zip(rows, cut, strict=True):
        best = [near(p, c[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in best), min(sum(d for d, _ in best), (1 << 63) - 1)))
    total = Counter()
    for r in out:
        total[r[1]] += r[3]
    return book, Counter((*r, min(total[r[1]], (1 << 63) - 1)) for r in out)


def check_codes(spark, rows, parts=4, entries=8, rounds=4):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, code string, n string").repartition(3)
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    got, book = vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    want_book, want = codes(rows, parts, entries, rounds)
    assert [[tuple(e) for e in p] for p in book] == want_book
    assert Counter(tuple(r) for r in got.select("vec_id", "label", "code", "error", "label_error").collect()) == want
    return got


@pytest.mark.parametrize("spread", [1.0, 0.003])
def test_codes_equal_brute_force(spark, spread):
    rnd = random.Random(4)
    rows = [(k * 13 % 300, [rnd.gauss(0, spread) for _ in range(12)], rnd.choice([0, 1, 1, 1, None])) for k in range(250)]
    rows += [rows[3], rows[3], (None, [0.5] * 12, 1), (400, None, 1), (401, [0.1] * 11 + [None], 1), (402, [float("nan")] * 12, None), (403, [float("-inf")] * 12, 0)]
    check_codes(spark, rows, entries=70)


def test_codes_of_odd_vectors(spark):
    check_codes(spark, [(1, [0.5, 1.5, -2.5], 1), (2, [], 1), (3, [1.0] * 9, None), (4, [0.25] * 4, 2)])
    check_codes(spark, [(1, [3e38, -3e38, 1.0, 0.0], 1), (2, [2e20, 1.0, 1.0, 1.0], 1), (3, [0.0] * 4, 1), (3, [1e-40, 0.0, 0.0, -1e-40], 1)], entries=2)
    check_codes(spark, [(1, [], None), (2, [], 5)])
    empty, book = vector_codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert empty.count() == 0 and vector_codes.codebooks_sha256(book) == hashlib.sha256(b"").hexdigest()


def test_nearest_entries_are_exact_with_ties():
    rnd = np.random.default_rng(2)
    for k, d, top in ((256, 16, 5), (130, 3, 50), (64, 1, 9), (1, 4, 3)):
        entries, x = rnd.integers(-top, top, (k, d)), rnd.integers(-top, top, (3000, d))
        index, far = vector_codes.Codebook(entries).nearest(x)
        dist = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (index == dist.argmin(axis=1)).all() and (far == dist.min(axis=1)).all()
