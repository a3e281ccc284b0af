"""Token files by a static range asymmetric numeral system (rANS).

All files share one table of token frequencies, counted over the whole corpus.
A block is coded by LANES independent states, interleaved: token i belongs to
lane i modulo LANES, and numpy steps all lanes at once. Each block has its
states, words and checksums of its own; the manifest's checkpoints name the
blocks that begin with a document, from which tasks decode in parallel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.archive import TempFile, filesystem, manifest, open_file, publish
from larder.llm.bpe import SLICE, loaded, word_bpe_path
from larder.llm.common import free_shuffles, partitions, text_bytes, text_slices, tie
from larder.llm.histogram_sort import MAX_PARTS, part_of, splitters
from larder.session import materialize, scratch_path, ship_package

END_ID = 2
#: Frequencies add up to 2 ** SCALE; states lie in [LOW, LOW << 32).
SCALE = 20
LOW = 1 << 31
LANES, BLOCK = 1024, 1 << 18
#: Text bytes of a sorted part, and compressed bytes at which a file ends.
PART_BYTES, FILE_BYTES = 32 << 20, 64 << 20
_MAGIC = b"RANSTOK1"
_HEAD = struct.Struct("<4sIIIIIII")  # mark, documents, tokens, lanes, words, continued, crc of body, crc of ids


class Table:
    """Quantised frequencies: every counted symbol keeps at least one of 2 ** SCALE slots."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, dtype=np.int64)
        total, slots = max(1, int(counts.sum())), 1 << SCALE
        freq = np.where(counts > 0, np.maximum(1, (counts.astype(float) * slots / total).astype(np.int64)), 0)
        order = np.argsort(-counts, kind="stable")
        over = int(freq.sum()) - slots
        if over < 0 and counts.any():
            freq[order[0]] -= over
        for s in order if over > 0 else ():
            take = min(over, int(freq[s]) - 1) if over > 0 else 0
            freq[s] -= max(0, take)
            over -= max(0, take)
            if over <= 0:
                break
        if over > 0:
            raise ValueError("more symbols than slots")
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else freq.astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
        """Final states and 32-bit words of a block of tokens."""
        lanes = max(1, min(lanes, len(ids)))
        state = np.full(lanes, LOW, dtype=np.uint64)
        freq, start = self.freq[ids], self.start[ids]
        words: list[np.ndarray] = []
        shift, full = np.uint64(SCALE), np.uint64(32)
        limit = freq << np.uint64(63 - SCALE)
        for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes) if len(ids) else ():
            f, c = freq[at: at + lanes], start[at: at + lanes]
            x = state[: len(f)]
            out = x >= limit[at: at + lanes]
            words.append(x[out].astype(np.uint32))
            x = np.where(out, x >> full, x)
            q = x // f
            state[: len(f)] = (q << shift) + (x - q * f) + c
        return state, np.concatenate([*words[::-1], np.zeros(0, dtype=np.uint32)])

    def decode(self, state: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` tokens of a block; states and words must come out used up."""
        lanes, at, state = len(state), 0, state.copy()
        ids = np.empty(n, dtype=np.uint32)
        mask, shift, full, low = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32), np.uint64(LOW)
        words = words.astype(np.uint64)
        for i in range(0, n, lanes):
            x = state[: min(lanes, n - i)]
            slot = x & mask
            s = self.symbol[slot]
            ids[i: i + len(x)] = s
            x = self.freq[s] * (x >> shift) + slot - self.start[s]
            need = np.flatnonzero(x < low)
            x[need] = (x[need] << full) | words[at: at + len(need)]
            at += len(need)
            state[: len(x)] = x
        if at != len(words) or (state != low).any():
            raise ValueError("the block does not end where its words do")
        return ids


def pack_block(table: Table, ids: np.ndarray, doc_ids: list[int | None], sizes: list[int], continued: bool, lanes: int = LANES) -> bytes:
    """A block: documents that begin in it (id, NULL or not, all their tokens), states, words, checksums."""
    state, words = table.encode(ids, lanes)
    body = (np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()
            + np.array(sizes, dtype="<i8").tobytes() + state.astype("<u8").tobytes() + words.astype("<u4").tobytes())
    return _HEAD.pack(b"BLK1", len(doc_ids), len(ids), len(state), len(words), continued, zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def unpack_block(table: Table, stream) -> tuple[np.ndarray, list[int | None], np.ndarray, bool]:
    """The next block's ids, documents that begin in it, their token counts, and whether it goes on with one."""
    mark, docs, n, lanes, n_words, continued, crc, ids_crc = _HEAD.unpack(stream.read(_HEAD.size))
    body = stream.read(17 * docs + 8 * lanes + 4 * n_words)
    if mark != b"BLK1" or zlib.crc32(body) != crc:
        raise ValueError("broken block")
    doc_ids, none, sizes = (np.frombuffer(body, t, docs, at) for t, at in (("<i8", 0), ("u1", 8 * docs), ("<i8", 9 * docs)))
    state = np.frombuffer(body, "<u8", lanes, 17 * docs)
    ids = table.decode(state, np.frombuffer(body, "<u4", n_words, 17 * docs + 8 * lanes), n)
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise ValueError("broken ids")
    return ids, [None if x else int(d) for d, x in zip(doc_ids.tolist(), none.tolist(), strict=True)], sizes, bool(continued)


def _save_table(root: str, counts: np.ndarray) -> None:
    store, path = filesystem(root)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/table.bin") as f:
        f.write(counts.astype("<i8").tobytes())


def load_table(root: str) -> Table:
    with open_file(root, "table.bin") as f:
        return Table(np.frombuffer(f.read(), "<i8"))


_TABLES: dict[str, Table] = {}


def _table(root: str) -> Table:
    """The worker's copy of the shared table."""
    if root not in _TABLES:
        _TABLES.clear()
        _TABLES[root] = load_table(root)
    return _TABLES[root]


def tokens(docs: DataFrame, path: str, end_id: int, part_bytes: int) -> DataFrame:
    """Sorted parts of ``docs(doc_id, text)`` as token ids: ``part, at, before, doc_id, n, ids``.

    ``at``: the row's place in its part, ``before``: the part's tokens before it, ``ids``: 32-bit little-endian.
    """
    ship_package(docs.sparkSession)
    keyed = docs.withColumns({"_key": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), "_tie": tie(F.xxhash64("text"))})
    keys = materialize(keyed.select(F.col("_key").alias("key"), F.col("_tie").alias("tie"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("size")), "rans")
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, min(-(-total // part_bytes), MAX_PARTS))
    bounds, _, _ = splitters(keys, parts, tolerance=0.01)
    place = part_of(bounds, [0] * parts)
    ordered = keyed.withColumn("part", place("_key", "_tie")["part"]).repartitionById(parts, "part").sortWithinPartitions("part", "_key", "_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, row, before = loaded(path), None, 0, 0
        for batch in batches:
            for piece in text_slices(batch, limit=SLICE):
                ids, at = bpe.encode(text_bytes(piece))
                n = np.diff(at) + 1
                flat = np.insert(ids.astype("<u4"), at[1:], end_id)
                bounds = np.concatenate([[0], np.cumsum(n)])
                rows, first = [], []
                for p in piece.column("part").to_pylist():
                    if p != part:
                        part, row, before = p, 0, 0
                    rows.append(row)
                    first.append(before)
                    before += int(n[len(rows) - 1])
                    row += 1
                data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([piece.column("part"), pa.array(rows, pa.int64()), pa.array(first, pa.int64()), piece.column("doc_id"), pa.array(n, pa.int64()), data],
                                                 names=["part", "at", "before", "doc_id", "n", "ids"])

    rows = ordered.select("part", "doc_id", "text").mapInArrow(run, "part int, at long, before long, doc_id long, n long, ids binary")
    where = scratch_path(docs.sparkSession, "rans")
    rows.write.option("compression", "zstd").parquet(where)
    return docs.sparkSession.read.parquet(where)


def counts(rows: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each of ``size`` token ids in ``rows(ids)``; at most ``size`` rows come to the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            ids = batch.column("ids")
            data = np.frombuffer(ids.buffers()[2], np.uint8) if ids.buffers()[2] else np.zeros(0, np.uint8)
            begin, end = np.frombuffer(ids.buffers()[1], np.int32)[[ids.offset, ids.offset + len(ids)]] if len(ids) else (0, 0)
            total += np.bincount(data[begin:end].view("<u4"), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write(docs: DataFrame, root: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
          part_bytes: int = PART_BYTES, file_bytes: int = FILE_BYTES, block: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """Write the tokens of every row, ``end_id`` after each document, in ascending id order under the shared folder ``root``.

    Returns the manifest of checkpoints: ``file, offset, bytes, first_token, tokens, documents``. Ids are integers,
    NULL ids come first, rows of one id by text hash; NULL and empty texts are just ``end_id``; repeated rows are
    written each; no rows write no files; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = path or word_bpe_path()
    rows = tokens(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), path, end_id, part_bytes)
    free_shuffles(spark)
    _save_table(root, counts(rows, len(loaded(path)._tokens)))
    sums = rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row a part of PART_BYTES
    base = dict(zip((r["part"] for r in sums), np.cumsum([0, *(r["n"] for r in sums)]).tolist(), strict=False))
    held = spark.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out, marks = _table(root), None, []
        waiting: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []
        count = start = 0
        expected = None

        def flush(continued: bool = False, ids: np.ndarray | None = None) -> None:
            nonlocal waiting, names, sizes, count
            whole = np.concatenate(waiting) if ids is None else ids
            data = pack_block(table, whole, names, sizes, continued, lanes)
            if continued:  # part of the checkpoint before
                marks[-1][2] += len(data)
                marks[-1][4] += len(whole)
            else:
                marks.append([None, out.bytes, len(data), start, len(whole), len(names)])
            out.write(data)
            waiting, names, sizes, count = [], [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal marks, out
            if out is None:
                return
            if names:
                flush()
            out.close()
            n, name = len(marks), f"tokens-{marks[0][3]:018d}.rans"
            yield pa.RecordBatch.from_arrays([pa.array([out.name] * n), pa.array([name] * n), *(pa.array([m[i] for m in marks], pa.int64()) for i in range(1, 6))],
                                             names=["temp", "file", "offset", "bytes", "first_token", "tokens", "documents"])
            out, marks = None, []

        for batch in batches:
            for r in range(batch.num_rows):
                part, at, before, doc_id = (batch.column(c)[r].as_py() for c in ("part", "at", "before", "doc_id"))
                ids = np.frombuffer(batch.column("ids")[r].as_buffer(), "<u4")
                if expected != (part, at) or out is not None and out.bytes >= file_bytes and not names:
                    yield from close()
                expected = (part, at + 1)
                if out is None:
                    out = TempFile(root)
                    out.write(_MAGIC + struct.pack("<I", table.crc))
                if names and count + len(ids) > block:
                    flush()
                if not names:
                    start = held.value[part] + before
                names.append(doc_id)
                sizes.append(len(ids))
                waiting.append(ids[:block])
                count += len(waiting[-1])
                if len(ids) > block:
                    flush()
                    for i in range(block, len(ids), block):
                        flush(True, ids[i: i + block])
        yield from close()

    return publish(rows.select("part", "at", "before", "doc_id", "ids").mapInArrow(
        run, "temp string, file string, offset long, bytes long, first_token long, tokens long, documents long"), root)


def read(spark: SparkSession, root: str, ids: bool = True) -> DataFrame:
    """Documents of the files that the manifest names, decoded from its checkpoints in parallel:
    ``doc_id, start, n_tokens, ids_crc32`` and ``ids``. Checksums of blocks, ids and the table must hold."""
    ship_package(spark)
    marks = manifest(spark, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(root)
        for batch in batches:
            for m in batch.to_pylist():
                with open_file(root, m["file"]) as f:
                    if f.read(12) != _MAGIC + struct.pack("<I", table.crc):
                        raise ValueError(f"{m['file']}: not a token file of this table")
                    f.seek(m["offset"])
                    got, doc_ids, sizes, continued = unpack_block(table, f)
                    if continued:
                        raise ValueError(f"{m['file']}: no checkpoint at {m['offset']}")
                    pieces, total = [got], len(got)
                    while total < m["tokens"]:
                        pieces.append(unpack_block(table, f)[0])
                        total += len(pieces[-1])
                    if f.tell() != m["offset"] + m["bytes"] or total != m["tokens"] or sizes.sum() != total:
                        raise ValueError(f"{m['file']}: checkpoint at {m['offset']}")
                ends = np.cumsum(sizes)
                if len(pieces) > 1:  # one document over several blocks
                    crc = 0
                    for p in pieces:
                        crc = zlib.crc32(p.tobytes(), crc)
                    crcs, flat = [crc], np.concatenate(pieces) if ids else None
                else:
                    flat = pieces[0]
                    crcs = [zlib.crc32(x.tobytes()) for x in np.split(flat, ends[:-1])]
                out = [pa.array(doc_ids, pa.int64()), pa.array(m["first_token"] + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + ids])

    tasks = max(1, min(n := marks.count(), max(partitions(spark), min(n // 16, MAX_PARTS))))
    return marks.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
