"""Line dedup, SimHash near-dedup and substring dedup against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from larder.llm import components, line_dedup, simhash_trie, substring_dedup

WS = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in WS.split(t or "") if w]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# --- line dedup
def brute_lines(rows, ratio, least):
    total, seen = Counter(s for _, _, s in rows), Counter()
    bare = lambda x: x.strip(" \t\r")
    for _, t, s in rows:
        seen.update((s, b) for b in {bare(x) for x in (t or "").split("\n")} if b)
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not (bare(x) and seen[s, bare(x)] >= least and seen[s, bare(x)] / total[s] > ratio)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("ratio,least", [(0.1, 5), (0.0, 1)])
def test_line_dedup(spark, messy, documents, ratio, least):
    for docs in (messy, documents, documents.limit(0)):
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        got = line_dedup.clean(docs, max_ratio=ratio, min_pages=least).select("doc_id", "text", "n_lines", "n_dropped").collect()
        assert sorted(map(tuple, got), key=str) == brute_lines(rows, ratio, least)


def test_line_dedup_keeps_columns(messy):
    out = line_dedup.clean(messy, counts=("_a", "_b"))
    assert out.columns == [*messy.columns, "_a", "_b"]
    assert sorted(out.select("doc_id", "fp").collect(), key=str) == sorted(messy.select("doc_id", "fp").collect(), key=str)


# --- SimHash
def brute_fingerprint(t):
    w = words(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_near(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    near = [[j for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 4] for i in range(len(rows))]
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return sorted(((i, format(f, "016x"), least.get(x)) for (i, _), f, x in zip(rows, fp, label, strict=True)), key=str)


@pytest.mark.parametrize("group_rows", [simhash_trie.GROUP_ROWS, 2])
def test_near_duplicates(messy, documents, group_rows):
    for docs in (messy, documents, documents.limit(0)):
        got = simhash_trie.near_duplicates(docs, group_rows=group_rows).drop("th").collect()
        assert sorted(map(tuple, got), key=str) == brute_near([(r.doc_id, r.text) for r in docs.collect()])


def test_keep_one(messy):
    """One row of each group, also where an id stands in two groups (the pipeline's test compares the groups)."""
    docs = messy.where("doc_id is not null").dropDuplicates(["doc_id"])
    found = brute_near([(r.doc_id, r.text) for r in docs.collect()])
    kept = simhash_trie.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in found})


def test_trie_pairs_equal_all_pairs():
    rng = np.random.default_rng(3)
    fp = np.repeat(rng.integers(0, 2**63, 40).astype(np.uint64), 25)
    for _ in range(3):
        fp ^= np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
    fp = np.unique(fp)
    for bits in (0, 1, 4, 7):
        got = [p for i, j in simhash_trie.trie_pairs(fp, np.array([[0, len(fp), 0, len(fp)]]), bits) for p in zip(i.tolist(), j.tolist(), strict=True)]
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= bits
        assert sorted(got) == sorted((i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j)
        half = len(fp) // 2
        got = {p for i, j in simhash_trie.trie_pairs(np.concatenate([fp[:half], fp[half:]]), np.array([[0, half, half, len(fp)]]), bits) for p in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < half <= j}


def test_components_of_path_star_and_random(spark):
    rnd = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000 + int(a), 5000 + int(b)) for a, b in rnd.integers(0, 300, (250, 2))]
    links += [(None, 3), (7, 7), (1, 0)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in parent)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- substring dedup
def brute_substrings(rows, span):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    seen, done, out = set(), set(), []
    for i, t, th in order:
        w, gone = words(t), set()
        if (i, th) in done:
            gone = set(range(len(w))) if len(w) >= span else set()
        else:
            for p in range(len(w) - span + 1):
                x = tuple(w[p:p + span])
                if x in seen:
                    gone.update(range(p, p + span))
                seen.add(x)
        done.add((i, th))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot,cut", [(8, substring_dedup.SLICE), (1, 3000)])
def test_substring_dedup(messy, documents, hot, cut, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(substring_dedup, "SLICE", cut)
    for docs in (messy, documents, documents.limit(0)):
        rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()]
        got = substring_dedup.dedup(docs, hot=hot).collect()
        assert sorted(map(tuple, got), key=str) == brute_substrings(rows, 20)


def test_substring_dedup_of_few_words(spark):
    """Few distinct words: windows overlap themselves and repeat everywhere."""
    rnd = np.random.default_rng(9)
    rows = [(i, " ".join("ab"[x] for x in rnd.integers(0, 2, int(n)))) for i, n in enumerate(rnd.integers(0, 90, 60))] + [(99, "a " * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (1, 100):
        got = substring_dedup.dedup(docs, span=8, k=4, hot=hot).collect()
        assert sorted(map(tuple, got), key=str) == brute_substrings([(i, t, 0) for i, t in rows], 8)


@pytest.mark.parametrize("hot", [1, 3, 100])
@pytest.mark.parametrize("parts", [1, 4])
def test_one_of_repeated_rows_keeps_its_text(spark, hot, parts, monkeypatch):
    """Rows repeated in a slice and across slices, also with NULL ids, whose text stands nowhere else or partly elsewhere."""
    monkeypatch.setattr(substring_dedup, "SLICE", 700)
    alone = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    shared = alone("s", 45)
    rows = [(7, alone("a", 24)), (7, alone("a", 24)), (None, alone("b", 70)), (None, alone("b", 70)), (None, alone("c", 20)), (None, "few words"), (None, "few words")]
    rows += [(i, f"{alone(f'x{i}y', 9)} {shared} {alone(f'z{i}y', 9)}") for i in (20, 21, 21, 22)]
    rows += [(30, shared), (30, shared), (30, shared[:-4] + " end")]
    rows += [(40 + i // 2, f"{alone(f'q{i // 2}y', 4)} {shared[20:150]} {alone(f'r{i // 2}y', 4)}") for i in range(8)]
    rnd = np.random.default_rng(2)
    rows += [(60 + int(i), " ".join("ab"[int(x)] for x in np.random.default_rng(int(i)).integers(0, 2, 40))) for i in rnd.integers(0, 6, 20)]
    # the copies of a row lie apart: in one slice each, or in different tasks
    rows = rows + rows[::-1]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    th = {r.text: r.th for r in docs.selectExpr("text", "xxhash64(text) as th").distinct().collect()}
    got = sorted(map(tuple, substring_dedup.dedup(docs, hot=hot).collect()), key=str)
    assert got == brute_substrings([(i, t, th[t]) for i, t in rows], 20)
    assert [r[2:] for r in got if r[0] == 7] == [(0, alone("a", 24))] + 3 * [(24, "")]


def test_passages_in_a_third_of_all_rows_send_few_rows(spark):
    """A passage that many documents share reaches the exchange as a few rows a slice."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{' '.join(f'u{i}x{j}' for j in range(30))} {passage if i % 3 == 0 else ''} {' '.join(f'v{i}x{j}' for j in range(30))}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup(docs).collect()}
    assert all(got[i] == (60 if i % 3 == 0 and i else 0) for i, _ in rows)
    per = defaultdict(int)
    import pyarrow as pa

    part = pa.RecordBatch.from_pydict({"did": [r[0] for r in rows], "th": list(range(600)), "text": [r[1] for r in rows]})
    for b in substring_dedup._stretches(part, 20, 8, 8):
        for k, p in zip(b.column("k1").to_pylist(), b.column("pack").to_pylist(), strict=True):
            if p & 3:
                per[k] += 1
    assert max(per.values()) <= 8
