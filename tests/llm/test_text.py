"""Toxicity, BPE, Order MinHash and decontamination against brute force, the tokenizers library, or held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm import bpe, order_minhash, queries, toxicity, winnowing

LIBRARY = Tokenizer.from_file(bpe.word_bpe_path())


# --- BPE
def strings(n, seed):
    rnd = random.Random(seed)
    odd = [*range(0x300, 0x3FF), *range(0x400, 0x52F), *range(0x5D0, 0x5EA), *range(0xAC00, 0xAD00), *range(0x2000, 0x2070), *range(0x3000, 0x30FF), *range(0x1F300, 0x1F700)]
    own = ["<|endoftext|>", "<|startoftext|>", " ", "\n", "'s", "'LL", "Σ", "İ", "aaaa", "\xa0", "\x85", "\x1c", "0", "½", "ſ", "ﬁ", "é"]
    make = [lambda: chr(rnd.randint(32, 126)), lambda: chr(rnd.randint(0, 0x2FF)), lambda: chr(rnd.choice(odd)), lambda: rnd.choice(own)]
    return ["".join(f() for f in rnd.choices(make, [5, 2, 2, 2], k=rnd.randint(0, 60))) for _ in range(n)] + ["", "a", "a" * 999, "<|endoftext|>"]


def test_encoder_equals_library_on_every_code_point():
    own, points = bpe.Bpe(bpe.word_bpe_path()), [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    rnd = random.Random(9)
    texts = points + [f"a{c}b" for c in points] + ["".join(rnd.choices(points, k=rnd.randint(1, 20))) for _ in range(10_000)]
    for at in range(0, len(texts), 50_000):
        part = texts[at: at + 50_000]
        ids, ends = own.encode([t.encode() for t in part])
        want = LIBRARY.encode_batch(part, add_special_tokens=False)
        assert [t for k, t in enumerate(part) if ids[ends[k]: ends[k + 1]].tolist() != want[k].ids] == []


def test_encoder_equals_library(monkeypatch):
    for cap in (bpe.CHUNKS, 50):
        monkeypatch.setattr(bpe, "CHUNKS", cap)
        own, texts = bpe.Bpe(bpe.word_bpe_path()), strings(2000, 1)
        for at in range(0, len(texts), 97):
            part = texts[at: at + 97]
            ids, ends = own.encode([t.encode() for t in part])
            decoded = own.decode(ids, ends).to_pylist()
            for k, t in enumerate(part):
                want = LIBRARY.encode(t, add_special_tokens=False).ids
                assert ids[ends[k]: ends[k + 1]].tolist() == want, t
                assert decoded[k] == LIBRARY.decode(want, skip_special_tokens=False)


def test_pieces_and_chunks_are_merged_once(monkeypatch):
    """Chunks stay known from one slice to the next, and of the new ones' pieces each distinct one is merged once."""
    own, merged = bpe.Bpe(bpe.word_bpe_path()), []
    merge = own.merge
    monkeypatch.setattr(own, "merge", lambda raw, size: merged.append(int((size > 0).sum())) or merge(raw, size))
    texts = ["alpha, alpha. (alpha) beta, beta!", "alpha, gamma. beta!"]
    for t in texts:
        assert own.encode([t.encode()])[0].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids
    assert merged == [7, 2]    # alpha beta , . ( ) !, then gamma .


def test_known_chunks_and_pairs_are_found_by_hash(monkeypatch):
    """Nothing is built over all known chunks for a slice; chunks of one hash and pairs of one slot stay apart."""
    monkeypatch.setattr(bpe.pc, "index_in", lambda *a, **k: pytest.fail("looks through all known chunks"))
    texts = strings(200, 3) + ["alpha beta", "beta alpha gamma", "gamma alpha <|endoftext|> é", "alpha, éa beta"]
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(bpe, "hashes", lambda buf, start, end: (end - start).astype(np.uint64) % np.uint64(3))
            monkeypatch.setattr(bpe, "_SLOT_BITS", 6)
        own = bpe.Bpe(bpe.word_bpe_path())
        for i in range(0, len(texts), 17):
            part = texts[i: i + 17]
            ids, at = own.encode([t.encode() for t in part])
            for k, t in enumerate(part):
                assert ids[at[k]: at[k + 1]].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_merge_one_at_a_time_equals_merge_of_all():
    own = bpe.Bpe(bpe.word_bpe_path())
    texts = [t.encode() for t in strings(300, 2)]
    ids, ends = own.encode(texts)
    other = bpe.Bpe(bpe.word_bpe_path())
    other._whole = False
    again, ends2 = other.encode(texts)
    assert (ids == again).all() and (ends == ends2).all()


def test_encode_and_decode_rows(messy, documents):
    for docs in (messy, documents, documents.limit(0)):
        got = bpe.encode(docs, decoded=True).collect()
        want = [(r.doc_id, LIBRARY.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
        assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(want, key=str)
        assert sorted((LIBRARY.decode(i, skip_special_tokens=False) for _, i in want)) == sorted(r.decoded for r in got)
        apart = bpe.decode(bpe.encode(docs)).collect()
        assert sorted(map(str, ((r.doc_id, r.decoded) for r in got))) == sorted(map(str, map(tuple, apart)))


def test_decode_of_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, 320, 99_999, -5, 321]), (None, [49407])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(rows).collect()}
    assert got == {1: "", 2: "", 3: LIBRARY.decode([320, 321]), None: "<|endoftext|>"}


# --- Order MinHash
def test_edited_texts_and_fingerprints(messy, documents):
    for docs in (documents, messy.where("doc_id is not null").dropDuplicates(["doc_id"]), documents.limit(1), documents.limit(0)):
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
        want = {}
        for k, (i, t) in enumerate(rows):
            cut = len(t) // 3
            want[i] = (len(t), hashlib.sha256((t[: len(t) - cut] + rows[(k + 1) % len(rows)][1][:cut]).encode()).hexdigest())
        got = order_minhash.compare(docs).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want and len(got) == len(rows)
        text, prints = dict(rows), defaultdict(set)
        for r in got:
            prints[text[r.doc_id]].add(r.fingerprint)
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert all(len(p) == 1 for p in prints.values())


def test_order_minhash_of_repeated_rows(messy):
    got = order_minhash.compare(messy).collect()
    assert len(got) == messy.count()
    once = {(r.doc_id, r.n_chars): r for r in order_minhash.compare(messy.dropDuplicates(["doc_id", "text"])).collect()}
    assert all(once[r.doc_id, r.n_chars].fingerprint == r.fingerprint for r in got)


def test_texts_of_one_id_are_spread_over_tasks(spark):
    """A third of all rows has no id: their texts lie in many tasks, and each takes from the next id's text with the smallest hash."""
    rnd = random.Random(12)
    prose = lambda: " ".join(f"w{rnd.randint(0, 80)}" for _ in range(rnd.randint(0, 40)))
    rows = [(None if i % 3 == 0 else i, prose()) for i in range(240)] + [(500, prose()), (500, prose()), (500, "the same"), (500, "the same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    keyed = docs.select(F.coalesce("doc_id", F.lit(order_minhash._NULL)).alias("did"), "th", "text")
    lie = order_minhash.edited(keyed, order_minhash.following(keyed), 8).withColumn("p", F.spark_partition_id())
    assert lie.where(F.col("did") == order_minhash._NULL).select("p").distinct().count() == 8
    first = {}
    for r in docs.collect():
        first.setdefault(r.doc_id, []).append((r.th, r.text))
    order = sorted(first, key=lambda i: (i is not None, i or 0), reverse=True)
    ahead = {i: min(first[order[(k + 1) % len(order)]])[1] for k, i in enumerate(order)}
    want = [(i, len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + ahead[i][: len(t) // 3]).encode()).hexdigest()) for i, t in rows]
    got = order_minhash.compare(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)


def test_likeness_falls_with_edits_and_order(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(600)]
    swapped = base[300:] + base[:300]
    light = [x if rnd.random() > 0.03 else "edit" for x in base]
    heavy = [x if rnd.random() > 0.4 else "edit" for x in base]
    rows = spark.createDataFrame([(0, " ".join(base), " ".join(base)), (1, " ".join(base), " ".join(light)), (2, " ".join(base), " ".join(swapped)), (3, " ".join(base), " ".join(heavy)),
                                  (4, "", " \n"), (5, "", "x")], "k long, a string, b string")
    got = {r.k: r.x for r in order_minhash.signatures(rows, ["k"], ["a", "b"], m=128).select("k", order_minhash.likeness(F.col("a_sig"), F.col("b_sig")).alias("x")).collect()}
    assert got[0] == got[4] == 1 and got[5] == 0
    assert 1 > got[1] > got[2] > got[3]
    # a k-mer set would call the swapped text nearly equal
    assert got[2] < 0.85


def test_likeness_at_the_registered_setting(spark):
    """M parts of L: the mean share of equal parts is J to the power of L, J the share of numbered k-mers in common."""
    rnd = random.Random(6)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(300)] for _ in range(150)]
    third = [x[:200] + base[i - 1][:100] for i, x in enumerate(base)]
    light = [[w if rnd.random() > 0.03 else "edit" for w in x] for x in base]
    heavy = [[w if rnd.random() > 0.4 else "edit" for w in x] for x in base]
    kinds = {"same": base, "light": light, "third": third, "swapped": [x[150:] + x[:150] for x in base], "heavy": heavy, "other": [*base[1:], base[0]]}
    rows = [(name, i, " ".join(a), " ".join(b)) for name, texts in kinds.items() for i, (a, b) in enumerate(zip(base, texts, strict=True))]
    sigs = order_minhash.signatures(spark.createDataFrame(rows, "kind string, i long, a string, b string").repartition(8), ["kind", "i"], ["a", "b"])
    found = defaultdict(list)
    for r in sigs.select("kind", F.size("a_sig").alias("m"), order_minhash.likeness(F.col("a_sig"), F.col("b_sig")).alias("x")).collect():
        assert r.m == order_minhash.M
        found[r.kind].append(r.x ** order_minhash.L)
    mean = {name: sum(x) / len(x) for name, x in found.items()}

    def common(a, b):
        a, b = (Counter(zip(x, x[1:], strict=False)) for x in (a, b))
        return (a & b).total() / (a | b).total()

    want = {name: sum(common(a, b) ** order_minhash.L for a, b in zip(base, kinds[name], strict=True)) / len(base) for name in kinds}
    assert mean["same"] == 1 and mean["other"] < 0.01
    assert 1 > mean["light"] > mean["third"] > mean["heavy"] > mean["other"]
    assert all(abs(mean[name] - want[name]) < 0.03 for name in ("light", "third", "heavy"))
    assert mean["swapped"] < want["swapped"] - 0.2  # a k-mer set would call it nearly equal


def test_occurrences_count(spark):
    rows = spark.createDataFrame([(0, "a b " * 50, "a b " * 100)], "k long, a string, b string")
    got = order_minhash.signatures(rows, ["k"], ["a", "b"], m=128).select(order_minhash.likeness(F.col("a_sig"), F.col("b_sig"))).first()[0]
    assert 0.3 < got < 0.7  # the same k-mers, half as often


# --- winnowing
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[p:p + n])].add(i)
    sizes, out = {len(x) for x in windows}, []
    for i, t in docs:
        w, hit, found = bench_words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p:p + n])) in windows:
                    hit.update(range(p, p + n))
                    found |= {y for y in windows[x] if y is not None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination(spark, messy, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    odd = [(r.doc_id, " ".join((r.text or "").split()[3:3 + n])) for n, r in zip([1, 2, 5, 9, 10, 11, 25, 40] * 3, messy.collect(), strict=False)]
    odd += [(None, "menu footer"), (500, None), (501, ""), (502, "..."), (500, "the cat")]
    items = spark.createDataFrame(odd, "item_id long, text string").withColumn("th", F.lit("x"))
    for docs, of in ((documents, bench), (messy, items), (messy, items.limit(0)), (documents.limit(0), items), (documents, items)):
        got = winnowing.contamination(docs, of).drop("th").collect()
        assert sorted(map(tuple, got), key=str) == brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in of.collect()])


@pytest.mark.parametrize("span,k", [(10, 5), (6, 2), (12, 12)])
def test_every_shared_span_is_found(spark, span, k):
    """Few distinct words, so runs tie and overlap."""
    rnd = random.Random(7)
    text = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(60)]
    items = [(i, text(rnd.randint(span, 25))) for i in range(20)]
    windows = {tuple(t.split()[p:p + span]) for _, t in items for p in range(len(t.split()) - span + 1)}
    want = {i: len({q for p in range(len(t.split()) - span + 1) if tuple(t.split()[p:p + span]) in windows for q in range(p, p + span)}) for i, t in docs}
    got = winnowing.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), span=span, k=k)
    assert {r.doc_id: r.n_hit for r in got.collect()} == want


# --- toxicity
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.toxic_scores(spark, docs, d).join(labels, "doc_id").select("doc_id", "score", "toxic").toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    toxic, clean = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert (toxic[:, None] > clean[None, :]).mean() > 0.97
    assert (toxic >= 0.5).mean() > 0.8 and (clean >= 0.5).mean() < 0.01


def test_swaps_lower_the_weight_of_identity_terms(spark):
    """Most toxic texts of the sample name one group; only the plain classifier learns that the name is toxic."""
    rnd = random.Random(8)
    neutral = [f"n{i}" for i in range(200)]
    rows = []
    for i in range(1500):
        bad = i % 3 == 0
        words = rnd.sample(neutral, 12) + (["insult"] if bad and rnd.random() < 0.6 else [])
        if rnd.random() < (0.8 if bad else 0.1):
            words.append("muslim")
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    texts = [b"n1 n2 n3 muslim n4 n5", b"n1 n2 n3 christian n4 n5", b"n1 n2 n3 n4 n5 insult"]
    plain, fair = (toxicity.fit(docs, labels, fairness=f).scores(texts) for f in (0.0, 30.0))
    assert plain[0] - plain[1] > 0.2
    assert abs(fair[0] - fair[1]) < 0.25 * (plain[0] - plain[1])
    assert fair[0] < 0.5 < fair[2]


def test_swap_terms():
    swaps = toxicity._terms((("women", "men"), ("a", "b", "c")))
    assert toxicity.swap_terms(b"Women, and MEN: a c", swaps) == b"men and women b a"
    assert toxicity.swap_terms(b"nobody", swaps) is None


def test_scores_of_messy_rows(spark, messy):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 101, 3)] + [(None, 1), (5000, 1), (3, None), (3, 1), (3, 0)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    for some in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = toxicity.fit(messy, some)
        out = toxicity.score(messy, model)
        rows = out.collect()
        assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
        assert out.columns == [c for c in messy.columns if c != "score"] + ["score"]
        empty = {r.score for r in rows if not (r.text or "").strip()}
        assert len(empty) == 1
    assert toxicity.score(messy.limit(0), model).count() == 0


def test_one_text_of_each_labelled_id_is_learnt_from(spark):
    docs = spark.createDataFrame([(i % 4, f"t{i} x") for i in range(200)] + [(i, None) for i in (0, 0, 7, 7)] + 5 * [(8, "same")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in (0, 1, 2, 3, 7, 8)], "doc_id long, toxic int")
    least = {}
    for r in docs.where("text is not null").withColumn("h", F.xxhash64("text")).collect():
        least[r.doc_id] = min(least.get(r.doc_id, (r.h, r.text)), (r.h, r.text))
    want = sorted((i, least[i][1] if i in least else None, i % 2) for i in (0, 1, 2, 3, 7, 8))
    got = list(map(tuple, toxicity._sample(docs, labels, 100).select("doc_id", "text", "toxic").collect()))
    assert len(got) == len(want)
    assert sorted(got) == want
    few = list(map(tuple, toxicity._sample(docs, labels, 3).collect()))
    assert len(few) == 3 and set(few) < set(want)


def test_scores_are_the_same_for_equal_texts(spark, messy):
    labels = spark.createDataFrame([(i, i % 2) for i in range(101)], "doc_id long, toxic int")
    by = defaultdict(set)
    for r in toxicity.score(messy, toxicity.fit(messy, labels)).collect():
        by[r.text or ""].add(round(r.score, 12))
    assert all(len(s) == 1 for s in by.values()) and np.isfinite([x for s in by.values() for x in s]).all()
