"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever it is one less than a multiple of the block size; each chunk gives
one character. The block size doubles from a least size until a text has about ``SPAN`` chunks at most, and a fingerprint
has the chunk strings at that size and at twice it, so texts of nearby lengths share a block size. Two fingerprints are
compared at the block sizes both have: one minus the edit distance of the chunk strings over their joint length. Runs
of more than three equal characters count as three, and strings of eight or more without a common run of three are
unlike.

Defined cases: null and empty texts have the fingerprint ``3::``, and are like one another only. Equal texts have
equal fingerprints and likeness 1. ``with_next`` orders rows by (doc_id, text's hash), null ids first; in a table of
one row that row is its own next. Rows that repeat id and text are each followed by the next of them, the last by the
next other row; they are dealt and worked out once with their number. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.shards import bounds, place, shard_of
from parcelspark.llm.textkit import chunks, mix, powers

LEAST_BLOCK = 3
SPAN = 64
SHARD_BYTES = 16 << 20
COPIES = 10_000  # repeats that one row stands for
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_ROLL = mix(np.arange(256, dtype=np.uint64) + np.uint64(1000))
_CHUNK = mix(np.arange(256, dtype=np.uint64) + np.uint64(5000))
_EMPTY = f"{LEAST_BLOCK}::"


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the seven bytes that end at each place (fewer at the start)."""
    h = np.zeros(len(data), dtype=np.uint32)
    rolled = (_ROLL[data] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for j in range(min(7, len(data))):
        h[j:] += (rolled[: len(data) - j] << np.uint32(3 * j)) | (rolled[: len(data) - j] >> np.uint32(32 - 3 * j)) if j else rolled
    return h


def fingerprint(text: bytes) -> str:
    if not text:
        return _EMPTY
    data = np.frombuffer(text, dtype=np.uint8)
    h = rolling(data)
    block = LEAST_BLOCK
    while block * SPAN < len(data):
        block *= 2
    up, down = powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_CHUNK[data] * up[:-1], dtype=np.uint64)))

    def chunk_string(size: int, ends: np.ndarray) -> str:
        ends = np.append(ends, len(data)) if not len(ends) or ends[-1] != len(data) else ends
        begin = np.concatenate(([0], ends[:-1]))
        value = mix((total[ends] - total[begin]) * down[begin])
        return _LETTERS[(value >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    ends = np.flatnonzero(h % np.uint32(block) == block - 1) + 1
    while block > LEAST_BLOCK and len(ends) < SPAN // 2:
        block //= 2
        ends = np.flatnonzero(h % np.uint32(block) == block - 1) + 1
    double = ends[h[ends - 1] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{chunk_string(block, ends)}:{chunk_string(2 * block, double)}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, one word of bits for a whole column of the table."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = mask, 0, len(a)
    for c in b:
        eq = places.get(c, 0)
        x = eq | minus
        zero = (((eq & plus) + plus) ^ plus) | x
        gain, loss = minus | (~(zero | plus) & mask), plus & zero
        distance += bool(gain & top) - bool(loss & top)
        gain = (gain << 1 | 1) & mask
        plus, minus = ((loss << 1) & mask) | (~(zero | gain) & mask), gain & zero
    return distance


def _string_likeness(a: str, b: str) -> float:
    a, b = (re.sub(r"(.)\1{3,}", r"\1\1\1", x) for x in (a, b))
    if a == b:
        return 1.0 if a else 0.0
    if len(a) >= 8 and len(b) >= 8:
        runs = {a[i : i + 3] for i in range(len(a) - 2)}
        if not any(b[i : i + 3] in runs for i in range(len(b) - 2)):
            return 0.0
    return 1 - edit_distance(a, b) / max(len(a), len(b), 1)


def likeness(a: str, b: str) -> float:
    """0 to 1: the best likeness at the block sizes that both fingerprints have."""
    if a == b:
        return 1.0
    (p, a1, a2), (q, b1, b2) = a.split(":"), b.split(":")
    p, q = int(p), int(q)
    if _EMPTY in (a, b):
        return 0.0
    if p == q:
        found = max(_string_likeness(a1, b1), _string_likeness(a2, b2))
    elif p == 2 * q:
        found = _string_likeness(a1, b2)
    elif q == 2 * p:
        found = _string_likeness(a2, b1)
    else:
        return 0.0
    return min(found, 0.999)  # not one unless the fingerprints are equal


def _dealt(batches: Iterator[pa.RecordBatch], starts) -> Iterator[pa.RecordBatch]:
    """Rows with their shard; a shard's first row also goes, as a look ahead, to the end of the shard before (the first to the last).

    Rows of a batch that repeat id and text are one with their number.
    """
    begin = starts.value
    number = {s: i for i, s in enumerate(begin)}
    press = zstandard.ZstdCompressor(3)
    for whole in batches:
        first: dict[tuple, int] = {}
        copies = [0] * whole.num_rows
        for i, row in enumerate(zip(*(whole.column(c).to_pylist() for c in ("key", "tie", "text")), strict=True)):
            copies[first.setdefault(row, i)] += 1
        once = whole.take(pa.array(first.values(), pa.int64()))
        once = once.append_column("copies", pa.array([n for n in copies if n], pa.int64()))
        for batch in chunks(once, "text"):
            shard, ahead, take, packed = [], [], [], []
            texts = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            for i, (k, t) in enumerate(zip(batch.column("key").to_pylist(), batch.column("tie").to_pylist(), strict=True)):
                at = place(k, t)
                rows = [(shard_of(begin, k, t), False)]
                if at in number:
                    rows.append(((number[at] - 1) % len(begin), True))
                for s, a in rows:
                    shard.append(s)
                    ahead.append(a)
                    take.append(i)
                    packed.append(texts[i])
            take = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(ahead, pa.bool_()), batch.column("key").take(take), batch.column("tie").take(take), pa.array(packed, pa.binary()), batch.column("copies").take(take)],
                names=["shard", "ahead", "key", "tie", "packed", "copies"],
            )


_RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_COPIED = [*_RESULT, "copies"]


def _compared(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (shard, ahead, key, tie, packed): each row against the one behind it, and the number of its copies."""
    opened = zstandard.ZstdDecompressor()
    out: list[list] = [[] for _ in _COPIED]
    before, last = None, None

    def result(key: object, text: str, own: str, copies: int, following: str, next_fp: str) -> None:
        if copies > 1:
            again(key, text, own, copies - 1)
        add(key, text, own, following, next_fp, 1)

    def again(key: object, text: str, own: str, copies: int) -> None:
        """Rows that their own repeat follows."""
        add(key, text, own, text, own, min(copies, COPIES))
        row = [c[-1] for c in out[:-1]]
        for left in range(copies - COPIES, 0, -COPIES):
            for column, v in zip(out, [*row, min(left, COPIES)], strict=True):
                column.append(v)

    def add(key: object, text: str, own: str, following: str, next_fp: str, copies: int) -> None:
        n = len(text) // 4
        edited = ((text[: len(text) - n] + following[:n]) if n else text).encode("utf-8", "surrogatepass")
        edited_fp = fingerprint(edited)
        row = (key, len(text), hashlib.sha256(edited).hexdigest(), own, edited_fp, likeness(own, edited_fp), likeness(own, next_fp), copies)
        for column, v in zip(out, row, strict=True):
            column.append(v)

    def done() -> pa.RecordBatch:
        types = [kind, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=_COPIED)
        for c in out:
            c.clear()
        return batch

    seen_ahead = None
    for batch in batches:
        for shard, ahead, key, packed, copies in zip(*(batch.column(c) for c in ("shard", "ahead", "key", "packed", "copies")), strict=True):
            shard, ahead, copies = shard.as_py(), ahead.as_py(), copies.as_py()
            if ahead and seen_ahead == shard:
                continue  # the first row of a shard that has exact repeats
            if not ahead and last == (shard, key, packed):
                before = (*before[:-1], before[-1] + copies)  # repeats from another batch
                continue
            text = opened.decompress(packed.as_py()).decode("utf-8", "surrogatepass")
            own = fingerprint(text.encode("utf-8", "surrogatepass"))
            if before is not None and before[0] == shard:
                result(*before[1:], text, own)
            before = None if ahead else (shard, key.as_py(), text, own, copies)
            last = None if ahead else (shard, key, packed)
            seen_ahead = shard if ahead else None
        yield done()


def with_next(documents: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their and the next document's likeness."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    distinct = texts.groupBy("key", "tie").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("size"))
    starts = spark.sparkContext.broadcast(bounds(distinct, F.col("size"), shard_bytes))
    kind = dict(documents.dtypes)["doc_id"]
    dealt = texts.mapInArrow(lambda it: _dealt(it, starts), f"shard int, ahead boolean, key {kind}, tie bigint, packed binary, copies bigint")
    placed = dealt.repartition(max(1, len(starts.value)), "shard").sortWithinPartitions("shard", "ahead", "key", "tie", "packed")
    arrow = pa.int64() if kind == "bigint" else pa.string() if kind == "string" else pa.int32()
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    compared = placed.mapInArrow(lambda it: _compared(it, arrow), f"{schema}, copies bigint")
    return compared.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*_RESULT)
