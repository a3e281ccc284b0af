"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints sorted as unsigned numbers are the leaves of a binary trie; a node
is a range of that order. Pairs of nodes are taken down together, one bit at a
time: the differing bits so far are added up and a pair of nodes goes as soon
as they exceed the budget.

Across tasks: two fingerprints with at most ``bits`` differing bits agree on
one of ``bits + 1`` blocks of their bits. A trie is built for each (block,
value); the pairs of a trie's root have that block in common. A (block, value)
held by more than GROUP_ROWS fingerprints is dealt into parts by hash, and each
pair of its parts is a task of its own, so no task holds more than two parts
and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import free_shuffles, give_back, own_names, partitions, text_bytes, text_slices
from larder.llm.components import connected_components
from larder.session import materialize, ship_package

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Most fingerprints of one part of a (block, value).
GROUP_ROWS = 20_000
#: Node pairs expanded at once.
_FRONT = 1 << 16
#: Leaf pairs compared at once.
_LEAVES = 1 << 18
#: Node pairs with so few leaf pairs are compared leaf by leaf.
_LEAF_PAIRS = 32


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """64-bit SimHash of the text's k-word shingles; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    if len(words) > k:
        spans = zip(start[: len(words) - k + 1].tolist(), end[k - 1:].tolist(), strict=True)
    else:
        spans = [(0, len(joined))]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at: at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``(doc_id, th, fp)`` for every row: th the text's hash, fp the SimHash as a long (its 64 bits)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                fp = np.array([fingerprint(t, k) for t in text_bytes(part)], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(fp)], names=["doc_id", "th", "fp"])
        give_back()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, th long, fp long")


def trie_pairs(fp: np.ndarray, roots: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) within ``bits`` differing bits, from the pairs of root nodes ``roots``.

    fp: uint64, ascending within each root range. roots: rows (alo, ahi, blo, bhi);
    a pair of a range with itself yields i < j only.
    """
    ones: dict[int, np.ndarray] = {}

    def ones_before(depth: int) -> np.ndarray:
        if depth not in ones:
            bit = (fp >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        return ones[depth]

    stack = [(0, roots.astype(np.int64), np.zeros(len(roots), dtype=np.int8))]
    while stack:
        depth, nodes, diff = stack.pop()
        if len(nodes) > _FRONT:
            stack.append((depth, nodes[_FRONT:], diff[_FRONT:]))
            nodes, diff = nodes[:_FRONT], diff[:_FRONT]
        na, nb = nodes[:, 1] - nodes[:, 0], nodes[:, 3] - nodes[:, 2]
        small = (na * nb <= _LEAF_PAIRS) | (depth == 64)
        if small.any():
            yield from _leaves(fp, nodes[small], bits)
            nodes, diff = nodes[~small], diff[~small]
        if not len(nodes):
            continue
        alo, ahi, blo, bhi = nodes.T
        before = ones_before(depth)
        amid, bmid = ahi - (before[ahi] - before[alo]), bhi - (before[bhi] - before[blo])
        same = (alo == blo) & (ahi == bhi)
        down = [
            (np.stack([alo, amid, blo, bmid], 1), diff, None),
            (np.stack([amid, ahi, bmid, bhi], 1), diff, None),
            (np.stack([alo, amid, bmid, bhi], 1), diff + 1, None),
            (np.stack([amid, ahi, blo, bmid], 1), diff + 1, ~same),
        ]
        keep_nodes, keep_diff = [], []
        for child, d, only in down:
            ok = (child[:, 0] < child[:, 1]) & (child[:, 2] < child[:, 3]) & (d <= bits)
            if only is not None:
                ok &= only
            keep_nodes.append(child[ok])
            keep_diff.append(d[ok].astype(np.int8))
        nodes = np.concatenate(keep_nodes)
        if len(nodes):
            stack.append((depth + 1, nodes, np.concatenate(keep_diff)))


def _leaves(fp: np.ndarray, nodes: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs of small node pairs, in bounded blocks."""
    alo, ahi, blo, bhi = nodes.T
    nb, total = bhi - blo, (ahi - alo) * (bhi - blo)
    ends, at = np.cumsum(total), 0
    while at < len(nodes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _LEAVES, side="right")))
        which = np.repeat(np.arange(at, stop), total[at:stop])
        k = np.arange(len(which)) - np.repeat(ends[at:stop] - total[at:stop] - (ends[at - 1] if at else 0), total[at:stop])
        i, j = alo[which] + k // nb[which], blo[which] + k % nb[which]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= bits
        near &= ~((alo[which] == blo[which]) & (ahi[which] == bhi[which]) & (i >= j))
        yield i[near], j[near]
        at = stop


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the classes of i and j; afterwards label[x] is the smallest index of x's class."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _task_links(task: np.ndarray, side: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that connect what the tries of these tasks connect; rows sorted by task, side, fp."""
    new = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
    end = np.concatenate([new[1:], [len(task)]])
    ones = np.concatenate([[0], np.cumsum(side)])
    mid = end - (ones[end] - ones[new])
    two = mid < end
    roots = np.stack([new, mid, np.where(two, mid, new), np.where(two, end, mid)], 1)
    roots = roots[roots[:, 0] < roots[:, 1]]
    label = np.arange(len(fp))
    for i, j in trie_pairs(fp, roots, bits):
        _join(label, i, j)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def trie_links(nodes: DataFrame, bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links ``(u, v)`` between the distinct fingerprints ``nodes(fp)``: their components are those of
    all pairs within ``bits`` differing bits (each task gives a spanning set of its pairs)."""
    spark = nodes.sparkSession
    ship_package(spark)
    edges = np.linspace(0, 64, bits + 2).round().astype(int).tolist()
    blocks = F.array(*[
        F.struct(F.lit(b).alias("b"),
                 F.shiftrightunsigned("fp", 64 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("v"))
        for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])
    members = nodes.select("fp", F.explode(blocks).alias("g")).select("fp", "g.b", "g.v")
    # at most (bits + 1) * 2^(widest block) rows: 40,960 for the default four bits
    large = (members.groupBy("b", "v").count().where(F.col("count") > group_rows)
             .select("b", "v", F.ceil(F.col("count") / group_rows).cast("int").alias("parts")))
    if bits >= 3:
        large = F.broadcast(large)
    dealt = (members.join(large, ["b", "v"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("b", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     (F.col("own") > F.col("other")).cast("int").alias("side"), "fp"))
    sorted_rows = (dealt.repartition(partitions(spark), "b", "v", "i", "j")
                   .sortWithinPartitions("b", "v", "i", "j", "side", "fp"))
    sign = np.uint64(1 << 63)  # signed order is the unsigned order of the flipped numbers; distances stay

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count, last = 0, None

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                task = np.concatenate([h[0] for h in held])
                u, v = _task_links(task, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), bits)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array((u ^ sign).view(np.int64)), pa.array((v ^ sign).view(np.int64))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("b", "v", "i", "j")])
            step = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            begins = last is None or (keys[:, 0] != last).any()
            task = count + int(begins) + np.concatenate([[0], np.cumsum(step)])
            side = batch.column("side").to_numpy(zero_copy_only=False).astype(np.int64)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64) ^ sign
            cut = int(np.searchsorted(task, task[-1]))  # the last task may go on in the next batch
            if cut or begins:
                held.append((task[:cut], side[:cut], fp[:cut]))
                yield from out()
                held = []
            held.append((task[cut:], side[cut:], fp[cut:]))
            count, last = int(task[-1]), keys[:, -1]
        yield from out()
        give_back()

    return sorted_rows.mapInArrow(run, "u long, v long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
            bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(doc_id, th, fp, root, component_id)`` for every row; ``root``, the component's smallest fingerprint
    (as a signed number), names it also where ids repeat or are NULL."""
    spark = docs.sparkSession
    rows = materialize(fingerprints(docs, id_col, text_col, k), "simhash")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash")
    found = connected_components(materialize(trie_links(nodes.select("fp"), bits, group_rows), "simhash"))
    own = nodes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left")
    least = own.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    labels = materialize(own.join(least, "component", "left")
                         .select("fp", F.coalesce("component", "fp").alias("root"),
                                 F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id")),
                         "simhash")
    free_shuffles(spark)
    return rows.join(labels, "fp").select("doc_id", "th", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``(doc_id, th, fingerprint, component_id)`` for every row of ``docs``.

    Fingerprints link at ``bits`` or fewer differing bits; component_id is the
    smallest id reachable (NULL ids count as none: a component of NULL ids has
    NULL). NULL, empty and blank texts have fingerprint zero and link like any
    other; repeated rows and tied texts share their fingerprint; an empty table
    gives no rows; other columns of ``docs`` are ignored.
    """
    return classes(docs, id_col, text_col, **how).select(
        "doc_id", "th", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id
    (NULL last, then by text hash) stays, once."""
    own_id, own_th = own_names(docs, "_keep_id", "_keep_th")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    stay = (classes(docs, id_col, text_col, **how).groupBy("root").agg(F.min(first).alias("row"))
            .select(F.col("row.doc_id").alias(own_id), F.col("row.th").alias(own_th)).distinct())
    mine = docs.join(stay, docs[id_col].eqNullSafe(stay[own_id]) & (F.xxhash64(docs[text_col]) == stay[own_th]))
    once = mine.dropDuplicates([own_id, own_th])
    return once.select(*[docs[c] for c in docs.columns])
