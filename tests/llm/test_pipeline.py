"""The pipeline's stages against brute force, on messy rows and on whole small tables."""

import hashlib
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from larder.llm import bpe, queries, toxicity
from larder.session import scratch_path

LIBRARY = Tokenizer.from_file(bpe.word_bpe_path())
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def without_boilerplate(rows):
    total, seen, out = Counter(r["source"] for r in rows), Counter(), []
    for r in rows:
        seen.update((r["source"], b) for b in {x.strip(" \t\r") for x in (r["text"] or "").split("\n")} if b)
    for r in rows:
        if r["text"] is not None:
            bad = lambda x, s=r["source"]: x.strip(" \t\r") and seen[s, x.strip(" \t\r")] >= 5 and seen[s, x.strip(" \t\r")] / total[s] > 0.1
            kept = [x for x in r["text"].split("\n") if not bad(x)]
            if len(kept) < len(r["text"].split("\n")):
                r = r | {"text": "\n".join(kept), "n_chars": len("\n".join(kept))}
        out.append(r)
    return out


def fingerprint(t):
    w = lower(t).encode().split()
    h = [xxhash.xxh64(b" ".join(w[i:i + 4]).decode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(rows):
    fp = [fingerprint(r["text"]) for r in rows]
    label = list(range(len(rows)))
    near = [[j for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 4] for i in range(len(rows))]
    while (new := [min(label[j] for j in near[i]) for i in range(len(rows))]) != label:
        label = new
    return label


def contaminated(rows, items):
    windows = set()
    for t in items:
        w = WORD.findall(lower(t))
        n = min(10, len(w))
        windows |= {tuple(w[p:p + n]) for p in range(len(w) - n + 1)} if w else set()
    sizes = {len(x) for x in windows}
    has = lambda w: any(tuple(w[p:p + n]) in windows for n in sizes for p in range(len(w) - n + 1))
    return [has(WORD.findall(lower(r["text"]))) for r in rows]


def as_rows(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


@pytest.fixture(scope="module", params=["messy", "documents"])
def folder(request, spark):
    docs = request.getfixturevalue(request.param)
    if request.param == "documents":
        return "/root/testdata/sf0.001"
    d = scratch_path(spark, "messy-tables")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, 101, 3)] + [(None, 1), (5000, None)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    some = [r.text for r in docs.where("length(text) > 200").limit(2).collect()]
    spark.createDataFrame([(1, " ".join(some[0].split()[2:20])), (None, None), (2, ""), (3, "footer menu naïve")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_each_stage_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        out = P.materialize(stage(spark, docs, folder), "test")
        before = as_rows(docs)
        if name != "BPE encoding and decoding":
            assert out.columns == columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{folder}/labels.parquet").where(~queries.held_out(F.col("doc_id")))
            model = toxicity.fit(docs, labels)
            score = model.scores([(r["text"] or "").encode() for r in before])
            assert as_rows(out) == [r for r, s in zip(before, score, strict=True) if s < 0.5]
        elif name == "line dedup":
            assert as_rows(out) == sorted(without_boilerplate(before), key=str)
        elif name == "SimHash near-dedup":
            groups = {}
            for r, g in zip(before, near_groups(before), strict=True):
                groups.setdefault(g, []).append(r)
            left = as_rows(out)
            assert len(left) == len(groups)
            for of in groups.values():
                least = min((r["doc_id"] for r in of if r["doc_id"] is not None), default=None)
                kept = [r for r in left if r in of]
                assert kept and all(r["doc_id"] == least for r in kept)
        elif name == "benchmark decontamination":
            assert as_rows(out) == [r for r, bad in zip(before, contaminated(before, items), strict=True) if not bad]
        else:
            want = []
            for r in before:
                ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
                want.append({"doc_id": r["doc_id"], "n_tokens": len(ids), "ids": ids,
                             "decoded_sha256": hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()})
            assert as_rows(out) == sorted(want, key=str)
        docs = out


def test_run_and_no_documents(spark, messy):
    assert [n for n, _ in P.STAGES][0] == "toxicity" and len(P.STAGES) == 5
    assert P.run(spark, "/root/testdata/sf0.001").count() > 50
    none = messy.limit(0)
    for _, stage in P.STAGES:
        none = P.materialize(stage(spark, none, "/root/testdata/sf0.001"), "test")
        assert none.count() == 0
