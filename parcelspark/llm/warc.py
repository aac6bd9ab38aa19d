"""WARC archives: a deterministic sharded writer, and the reader of what it wrote.

Records are put in order of page id and cut into shards by bounds that depend on the data alone; a shard's task writes
its records to files that roll when their compressed size reaches a limit. Every record is its own gzip member with
headers and digests made anew. Files are written under temporary names and then named; the manifest, written last,
lists the finished files with their sizes and digests, and readers go by it.

Of records with equal payloads (same length and SHA-1) of at least ``least_bytes``, that of the smallest id is the
response, the others are revisits that name it. The choice is made on digests alone, before any payload is moved.

Defined cases: null html is an empty payload; a null url becomes ``urn:page:<id>``; rows that repeat id, url and html
are one record; rows that share an id only are kept apart, in order of their content's hash; null ids come first, and
count as the smallest. An empty table writes no files. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.shards import bounds, filesystem, new_folder, published, shard_of
from parcelspark.llm.textkit import chunks
from parcelspark.session import cut

SHARD_BYTES = 64 << 20  # of payload
FILE_BYTES = 16 << 20  # compressed
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of addresses


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: object, tie: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, json.dumps([key, tie]))}>"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; its bytes depend on the record only."""
    lines = [*headers, ("Content-Length", str(len(block))), ("WARC-Block-Digest", f"sha1:{digest32(block)}")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines) + "\r\n"
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress(head.encode("utf-8", "replace") + block + b"\r\n\r\n") + press.flush()


def _headers(kind: str, key: object, tie: int, url: str | None, size: int, digest: str) -> list[tuple[str, str]]:
    return [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(key, tie)), ("WARC-Date", DATE), ("WARC-Target-URI", url or f"urn:page:{key}"),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", json.dumps(key)), ("X-Payload-Length", str(size)),
    ]


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def response(key: object, tie: int, url: str | None, payload: bytes) -> bytes:
    return member(_headers("response", key, tie, url, len(payload), digest32(payload)), _http(len(payload)) + payload)


def revisit(key: object, tie: int, url: str | None, size: int, digest: str, first: object, first_tie: int) -> bytes:
    more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, first_tie)), ("X-Refers-To-Page", json.dumps(first))]
    return member(_headers("revisit", key, tie, url, size, digest) + more, _http(size))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "html"):
            payloads = [(h or "").encode("utf-8", "surrogatepass") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("tie"), batch.column("url"), pa.array([len(p) for p in payloads], pa.int64()), pa.array([digest32(p) for p in payloads])],
                names=["key", "tie", "url", "size", "digest"],
            )


_DEALT = ["shard", "key", "tie", "part", "record"]


def _responses(batches: Iterator[pa.RecordBatch], starts) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "html"):
            keys, ties = batch.column("key").to_pylist(), batch.column("tie").to_pylist()
            shards = [shard_of(starts.value, k, t) for k, t in zip(keys, ties, strict=True)]
            records = [response(k, t, u, (h or "").encode("utf-8", "surrogatepass")) for k, t, u, h in zip(keys, ties, batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), batch.column("key"), batch.column("tie"), pa.array([1] * len(keys), pa.int32()), pa.array(records, pa.binary())], names=_DEALT)


def _revisits(batches: Iterator[pa.RecordBatch], starts) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        shards = [shard_of(starts.value, r["key"], r["tie"]) for r in rows]
        records = [revisit(r["key"], r["tie"], r["url"], r["size"], r["digest"], r["first"]["key"], r["first"]["tie"]) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), batch.column("key"), batch.column("tie"), pa.array([0] * len(rows), pa.int32()), pa.array(records, pa.binary())], names=_DEALT)


_MANIFEST = "file string, n_records bigint, n_bytes bigint, sha1 string"


def _written(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (shard, key, tie, part): a revisit stands before, and instead of, its row's response."""
    columns = ("shard", "key", "tie", "record")
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns[:3]), b.column("record"), strict=True))
    row, last, shard, part = next(rows, None), None, None, 0
    while row is not None:
        part, shard = (part + 1 if row[0] == shard else 0), row[0]
        name, n, sha = f"pages-{shard:06d}-{part:04d}.warc.gz", 0, hashlib.sha1()
        with published(folder, name) as out:
            info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            out.write(info)
            sha.update(info)
            while row is not None and row[0] == shard and (n == 0 or out.tell() < file_bytes):
                if row[:3] != last:
                    record = row[3].as_py()
                    out.write(record)
                    sha.update(record)
                    n += 1
                last = row[:3]
                row = next(rows, None)
            size = out.tell()
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "sha1": [sha.hexdigest()]})


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and return the manifest, a row for each file."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select(F.col("page_id").alias("key"), F.xxhash64("url", "html").alias("tie"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    narrow = cut(rows.mapInArrow(_digests, f"key {kind}, tie bigint, url string, size bigint, digest string"))
    starts = spark.sparkContext.broadcast(bounds(narrow, F.col("size") + 512, shard_bytes))
    firsts = narrow.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min(F.struct("key", "tie")).alias("first"))
    later = narrow.join(firsts, ["digest", "size"]).where(~(F.col("key").eqNullSafe(F.col("first.key")) & (F.col("tie") == F.col("first.tie"))))
    dealt = f"shard int, key {kind}, tie bigint, part int, record binary"
    both = rows.mapInArrow(lambda it: _responses(it, starts), dealt).unionByName(later.select("key", "tie", "url", "size", "digest", "first").mapInArrow(lambda it: _revisits(it, starts), dealt))
    placed = both.repartition(max(1, len(starts.value)), "shard").sortWithinPartitions("shard", "key", "tie", "part")
    return cut(placed.mapInArrow(lambda it: _written(it, folder, file_bytes), _MANIFEST))


def records(stream, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream of gzip members."""
    held = b""
    while True:
        held = held or stream.read(size)
        if not held:
            return
        opened, parts = zlib.decompressobj(31), []
        while not opened.eof:
            parts.append(opened.decompress(held))
            held = b""
            if not opened.eof:
                held = stream.read(size)
                if not held:
                    raise ValueError("a record is cut off")
        held = opened.unused_data
        content = b"".join(parts)
        head, _, rest = content.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:] if ": " in line)
        block = rest[: int(headers["Content-Length"])]
        if headers["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
            raise ValueError(f"a block is damaged: {headers['WARC-Record-ID']}")
        yield headers, block


def _read(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("file").to_pylist():
            fs, name = filesystem(path)
            out: list[list] = [[], [], [], [], [], []]
            with fs.open_input_stream(name, compression=None) as stream:
                for headers, block in records(stream):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    full = headers["WARC-Type"] == "response"
                    digest = digest32(payload) if full else headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f"sha1:{digest}" != headers["WARC-Payload-Digest"]:
                        raise ValueError(f"a payload is damaged: {headers['WARC-Record-ID']}")
                    row = (json.loads(headers["X-Page-Id"]), len(payload) if full else int(headers["X-Payload-Length"]), digest, headers["WARC-Type"],
                           None if full else json.loads(headers["X-Refers-To-Page"]), payload if full else None)
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                    if len(out[0]) >= 500:
                        yield _rows(out, kind)
            yield _rows(out, kind)


def _rows(out: list[list], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.string(), kind, pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    for c in out:
        c.clear()
    return batch


def read(manifest: DataFrame, kind: str = "bigint") -> DataFrame:
    """Every record of the manifest's files, block and payload digests checked; a revisit has no payload of its own."""
    arrow = pa.int64() if kind == "bigint" else pa.string() if kind == "string" else pa.int32()
    files = manifest.select("file").repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(lambda it: _read(it, arrow), f"page_id {kind}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}, payload binary")
