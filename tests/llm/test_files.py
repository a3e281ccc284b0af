"""Sharding, WARC archives and token files: laws, round trips, damage."""

import base64
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm import archive, histogram_sort, rans, warc
from larder.llm.bpe import word_bpe_path
from larder.session import scratch_path

LIBRARY = Tokenizer.from_file(word_bpe_path())


def test_shards_have_near_equal_bytes(messy, documents):
    for docs in (messy, documents):
        rows = histogram_sort.shard(docs).collect()
        assert sorted((r.doc_id, r.size) for r in rows if r.doc_id is not None) == sorted((r.doc_id, len((r.text or "").encode()) + 8) for r in docs.collect() if r.doc_id is not None)
        ideal, biggest = sum(r.size for r in rows) / 24, max(r.size for r in rows)
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
        for s, of in by.items():
            assert 0 <= s < 24 and sorted(r.slot for r in of) == list(range(len(of)))
            assert abs(sum(r.size for r in of) - ideal) <= biggest
        order = [(-1 if r.doc_id is None else r.doc_id) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
        assert order == sorted(order)


def test_shards_of_one_hot_key_and_of_nothing(spark, documents):
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") * 10**12).alias("doc_id"),
                                    F.repeat(F.lit("x"), (F.col("id") % 37).cast("int")).alias("text"))
    for run_rows in (10**6, 40):
        got = histogram_sort.shard(docs, run_rows=run_rows).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
        assert len(got) == 24 and all(r.n == r.m + 1 == r.d for r in got)
        assert max(r.b for r in got) - min(r.b for r in got) <= 2 * 45
    assert histogram_sort.shard(documents.limit(0)).count() == 0
    assert histogram_sort.shard(docs.limit(3)).count() == 3


@pytest.mark.parametrize("probes", [1, 1 << 16])
def test_many_splitters_stay_exact(spark, monkeypatch, probes):
    """Many ranges, few probes a round: every splitter has the rows and bytes below it, and lies as near as rows allow."""
    monkeypatch.setattr(histogram_sort, "ROUND_PROBES", probes)
    rnd = np.random.default_rng(2)
    key = np.concatenate([rnd.integers(-(1 << 63), 1 << 62, 2000), np.full(1000, 5), np.arange(100)])
    size = rnd.integers(1, 400, len(key))
    rows = spark.createDataFrame([(int(k), i, int(b)) for i, (k, b) in enumerate(zip(key, size, strict=True))], "key long, tie long, size long").repartition(4)
    found, n, total = histogram_sort.splitters(rows, 300, tolerance=0)
    assert (n, total) == (len(key), size.sum()) and len(found) == 299
    order = np.lexsort((np.arange(len(key)), key))
    ends = np.concatenate([[0], np.cumsum(size[order])])
    places = [(int(key[i]), int(i)) for i in order]
    for i, s in enumerate(found):
        below = sum(p < s.at for p in places)
        assert (s.rows, s.bytes) == (below, ends[below])
        goal = total * (i + 1) / 300
        assert abs(s.bytes - goal) == np.abs(ends - goal).min()


def test_ranges_are_bounded(spark, pages, documents, monkeypatch):
    """At the most ranges allowed they grow instead, and nothing is lost."""
    for module in (histogram_sort, warc, rans):
        monkeypatch.setattr(module, "MAX_PARTS", 26)
    got = histogram_sort.shard(documents, run_rows=1).collect()
    assert len(got) == documents.count() and {r.shard for r in got} == set(range(24))
    root = scratch_path(spark, "t")
    assert {r.shard for r in warc.write(pages, root, shard_bytes=100).collect()} <= set(range(26))
    assert warc.read(spark, root).count() == pages.count()
    root = scratch_path(spark, "t")
    rans.write(documents, root, part_bytes=100)
    assert rans.read(spark, root).count() == documents.count()


def brute_pages(rows):
    by = defaultdict(list)
    for i, h in rows:
        by[h or ""].append(i)
    out = []
    for i, h in rows:
        data = (h or "").encode()
        best = max((x for x in by[h or ""] if x is not None), default=None)
        again = best is not None and (i is None or i < best)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i if i % 7 else None, f"http://a/{i}\r\nb" if i % 3 else None, [None, "", "same", "é" * 500, f"u{i}"][i % 5], "x") for i in range(200)]
    return spark.createDataFrame(rows + [(999, None, "same", None)] * 3 + [(1000, "u", "long " * 40_000, "y")], "page_id long, url string, html string, records string").repartition(4)


FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_warc_round_trip_is_deterministic(spark, pages):
    roots = [scratch_path(spark, "t") for _ in range(2)]
    sets = [sorted(map(tuple, warc.write(p, r, shard_bytes=9000, file_bytes=3000).collect())) for p, r in zip((pages, pages.repartition(2)), roots, strict=True)]
    assert sets[0] == sets[1] and len(sets[0]) > 5
    store, path = archive.filesystem(roots[0])
    for file, _, _, size, sha in sets[0]:
        data = store.open_input_file(f"{path}/{file}").read()
        assert len(data) == size and hashlib.sha256(data).hexdigest() == sha
    got = warc.read(spark, roots[0])
    assert sorted(map(tuple, got.select(*FIELDS).collect()), key=str) == brute_pages([(r.page_id, r.html) for r in pages.collect()])
    for r in got.where("record_type = 'response'").collect():
        assert r.payload_digest == warc.digest(r.payload.encode())
    ids = [warc.parse(m)[0]["WARC-Record-ID"] for f in sets[0] for m in warc._members(store.open_input_file(f"{path}/{f[0]}"))]
    assert len(ids) == len(set(ids))


def test_warc_least_size_and_no_pages(spark, pages):
    root = scratch_path(spark, "t")
    warc.write(pages, root, least=5)
    got = {(r.record_type) for r in warc.read(spark, root).where("payload_bytes < 5").collect()}
    assert got == {"response"}
    root = scratch_path(spark, "t")
    assert warc.write(pages.limit(0), root).count() == 0 and warc.read(spark, root).count() == 0


def test_files_of_lost_attempts_do_not_count(spark, pages):
    root = scratch_path(spark, "t")
    warc.write(pages, root)
    lost = archive.TempFile(root)
    lost.write(b"half a record")
    lost.close()
    assert warc.read(spark, root).count() == pages.count()


def test_warc_reader_finds_damage(spark, pages):
    root = scratch_path(spark, "t")
    file = warc.write(pages, root).first().file
    _, path = archive.filesystem(root)
    with open(f"{path}/{file}", "r+b") as f:
        f.truncate(os.path.getsize(f"{path}/{file}") - 30)
    with pytest.raises(Exception, match="ends inside|digest|records|broken"):
        warc.read(spark, root).collect()


@pytest.mark.parametrize("lanes", [1, 7, 1024])
def test_rans_blocks(lanes):
    rng = np.random.default_rng(2)
    counts = np.bincount((rng.pareto(0.7, 50_000) * 3).astype(int).clip(0, 49_000), minlength=49_408)
    table = rans.Table(counts)
    assert int(table.freq.sum()) == 1 << rans.SCALE and ((counts > 0) == (table.freq > 0)).all()
    known = np.flatnonzero(counts)
    for n in (0, 1, 2, 1023, 1024, 1025, 30_000):
        ids = rng.choice(known, n, p=counts[known] / counts.sum()).astype(np.uint32)
        state, words = table.encode(ids, lanes)
        assert (table.decode(state, words, n) == ids).all()
    one = rans.Table(np.array([0, 5, 0]))
    assert (one.decode(*one.encode(np.ones(100, dtype=np.uint32), 8), 100) == 1).all()


@pytest.mark.parametrize("small", [True, False])
def test_token_files(spark, messy, documents, small):
    how = {"part_bytes": 20_000, "file_bytes": 3000, "block": 1000, "lanes": 64} if small else {}
    for docs in (messy, documents, documents.limit(0)):
        root = scratch_path(spark, "t")
        rans.write(docs, root, **how)
        rows = rans.read(spark, root).orderBy("start").collect()
        at = 0
        for r in rows:
            assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.n_tokens
        want = [(r.doc_id, LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
        assert sorted(((r.doc_id, r.ids) for r in rows), key=str) == sorted(want, key=str)
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x or 0))


def test_token_reader_finds_damage(spark, documents):
    root = scratch_path(spark, "t")
    file = rans.write(documents, root).first().file
    _, path = archive.filesystem(root)
    with open(f"{path}/{file}", "r+b") as f:
        f.seek(20_000)
        f.write(b"\x55\xaa")
    with pytest.raises(Exception, match="broken"):
        rans.read(spark, root).collect()


def test_equal_rows_are_parted(spark):
    """A third of all rows equal: no shard or part has more than twice the mean, and a second run gives the same files."""
    rows = [(i, f"text {i} " * 8) for i in range(2000)] + [(None, "")] * 500 + [(7, "again " * 10)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    sets, root = [], None
    for _ in range(2):
        root = scratch_path(spark, "t")
        sets.append(sorted(map(tuple, warc.write(pages, root, shard_bytes=150_000).collect())))
    assert sets[0] == sets[1]
    per = Counter()
    for _, shard, records, *_ in sets[0]:
        per[shard] += records
    assert sum(per.values()) == 3000 and len(per) >= 8 and max(per.values()) <= 2 * 3000 / len(per)
    assert sorted(map(tuple, warc.read(spark, root).select(*FIELDS).collect()), key=str) == brute_pages(rows)
    parts = [r["count"] for r in rans.tokens(docs, word_bpe_path(), 2, 30_000).groupBy("part").count().collect()]
    assert len(parts) >= 8 and max(parts) <= 2 * 3000 / len(parts)
