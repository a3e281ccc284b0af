"""Deterministic sharded WARC writer, and its reader.

Records are range-sorted by page id into shards of near equal bytes (exact
splitters). A shard's task writes its records in order, one gzip member each,
with headers and digests made anew, and begins another file when the next
member would pass ``file_bytes`` compressed. Same pages and parameters give the
same files, byte for byte. Names and manifest: ``archive``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.archive import TempFile, manifest, open_file, publish
from larder.llm.common import tie, tie_range
from larder.llm.histogram_sort import MAX_PARTS, part_of, splitters
from larder.session import materialize, ship_package

SHARD_BYTES, FILE_BYTES = 64 << 20, 16 << 20
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
#: Parts into which the pages of one payload are dealt where they meet its response.
SALT = 32
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()

#: Bytes of a record besides its payload, about.
_HEAD = 512


def record_id(page_id: int | None, payload_digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}:{nth}')}>"


def _member(fields: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)  # 31: gzip, without time or name
    return pack.compress(f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def _uri(url: str | None) -> str | None:
    """The URL with line breaks and other control characters percent-encoded."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, nth: int, date: str = DATE, level: int = LEVEL) -> bytes:
    """The page's response or, with ``refers_to``, revisit record as a gzip member."""
    of = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    return _member([
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, of, nth)), ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{of}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Profile", None if refers_to is None else REVISIT_PROFILE), ("WARC-Refers-To", None if refers_to is None else record_id(refers_to, of, 0)),
        ("Page-ID", page_id), ("Refers-To-Page-ID", refers_to), ("Content-Type", "application/http; msgtype=response")], block, level)


def _info(name: str, date: str, level: int) -> bytes:
    block = f"format: {VERSION}\r\nfilename: {name}\r\n".encode()
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date),
                    ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/warc-fields")], block, level)


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``(_key, _hash, refers_to)`` of pages whose payload, of ``least`` bytes or more, a page with a larger id has too.

    ``pages(_key, _hash, page_id, payload)``, ``_hash`` of the rest; pages tied for the largest id are all responses, NULL is the smallest.
    """
    sums = pages.where(F.octet_length("payload") >= least).select("_key", "_hash", "page_id", F.unhex(F.sha2("payload", 256)).alias("sum"))
    best = sums.groupBy("sum").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    dealt = best.select("sum", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s"))
    return (sums.withColumn("s", F.pmod(F.xxhash64("_key", "_hash"), F.lit(SALT)).cast("int")).join(dealt, ["sum", "s"])
            .where("page_id is null or page_id < refers_to").select("_key", "_hash", "refers_to"))


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0,
          shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE, level: int = LEVEL) -> DataFrame:
    """Write every row as a record under the shared folder ``root``; returns the manifest ``(file, shard, records, bytes, sha256)``.

    Ids are integers, NULL ids come first and are never referred to; NULL html is the empty payload, NULL
    URLs have no target; equal rows are a record each (ids numbered); no rows write no files; other columns are ignored.
    """
    spark = pages.sparkSession
    ship_package(spark)
    rows = (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
            .withColumns({"_key": F.coalesce("page_id", F.lit(-(1 << 63))), "_hash": F.xxhash64("url", "payload")}).withColumn("_tie", tie(F.col("_hash"))))
    keys = materialize(rows.select(F.col("_key").alias("key"), F.col("_tie").alias("tie"), (F.octet_length("payload") + _HEAD).cast("long").alias("size")), "warc")
    total, low_tie = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.min("tie")).first()
    shards = max(1, min(-(-total // shard_bytes), MAX_PARTS))
    bounds, _, _ = splitters(keys, shards, tolerance=0.01)
    goes_on = {i + 1: b.at[0] for i, b in enumerate(bounds) if total and b.at[1] > low_tie}  # key whose rows began in a shard before
    part = part_of(bounds, [0] * shards)
    # a revisit's row comes just before its page's, in each shard that has copies of the page's row: one exchange carries both
    ends = [part("_key", t)["part"] for t in tie_range(F.col("_hash"))]
    marks = (revisits(rows, least).distinct().withColumn("shard", F.explode(F.sequence(*ends)))
             .select("shard", "_key", "_hash", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"),
                     F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "refers_to"))
    whole = rows.select(part("_key", "_tie")["part"].alias("shard"), "_key", "_hash", F.lit(1).alias("kind"), "page_id", "url", "payload",
                        F.lit(None).cast("long").alias("refers_to"))
    placed = whole.unionByName(marks).repartitionById(shards, "shard").sortWithinPartitions("shard", "_key", "_hash", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = out = None
        refers: dict[tuple, int] = {}
        last, nth, number, records, check = (), 0, 0, 0, hashlib.sha256()

        def name() -> str:
            return f"shard-{shard:06d}-{number:05d}.warc.gz"

        def put(data: bytes) -> None:
            out.write(data)
            check.update(data)

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (out.name, name(), shard, records, out.bytes, check.hexdigest())],
                                                 schema=pa.schema([("temp", pa.string()), ("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

        for batch in batches:
            for r in range(batch.num_rows):
                kind, page_id, refers_to = (batch.column(c)[r].as_py() for c in ("kind", "page_id", "refers_to"))
                key = batch.column("_key")[r].as_py(), batch.column("_hash")[r].as_py()
                if kind == 0:
                    refers = {key: refers_to}
                    continue
                at, payload = batch.column("shard")[r].as_py(), batch.column("payload")[r].as_buffer().to_pybytes()
                nth = nth + 1 if last == (page_id, at) else at << 32 if goes_on.get(at) == key[0] else 0
                last = (page_id, at)
                data = page_record(page_id, batch.column("url")[r].as_py(), payload, refers.get(key), nth, date, level)
                if at != shard or out.bytes + len(data) > file_bytes and records:
                    yield from close()
                    number = number + 1 if at == shard else 0
                    shard, out, records, check = at, TempFile(root), 0, hashlib.sha256()
                    put(_info(name(), date, level))
                put(data)
                records += 1
        yield from close()

    return publish(placed.mapInArrow(run, "temp string, file string, shard int, records long, bytes long, sha256 string"), root)


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked, one at a time."""
    rest = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if parts:
                    raise EOFError("the archive ends inside a record")
                return
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; lengths and the block's digest must be right."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != VERSION or rest[len(block):] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    return fields, block


def read(spark: SparkSession, root: str, payload: bool = True) -> DataFrame:
    """Page records of the archives that the manifest names, read file by file in tasks:
    ``page_id, url, record_type, payload_bytes, payload_digest, refers_to`` and ``payload`` (NULL for revisits)."""
    ship_package(spark)
    files = manifest(spark, root).select("file", "records")
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload string" * payload

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()][: 6 + payload]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, records in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with open_file(root, file) as f:
                    for member in _members(f):
                        fields, block = parse(member)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, body = block.partition(b"\r\n\r\n")
                        revisit = fields["WARC-Type"] == "revisit"
                        of = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        if not revisit and (digest(body) != of or len(body) != length):
                            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
                        number = [int(x) if (x := fields.get(k)) is not None else None for k in ("Page-ID", "Refers-To-Page-ID")]
                        rows.append((number[0], fields.get("WARC-Target-URI"), fields["WARC-Type"], length, of, number[1], None if revisit else body.decode()))
                        size, seen = size + len(block), seen + 1
                        if len(rows) >= 4096 or size >= 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if seen != records:
                    raise ValueError(f"{file}: {seen} of {records} records")
                if rows:
                    yield batch_of(rows)

    return files.repartition(max(1, min(files.count(), MAX_PARTS))).mapInArrow(run, schema)
