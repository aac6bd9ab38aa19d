"""Token ids in binary shards: independent zstandard frames, a trailing seek table and a checksum for each frame.

A shard holds the documents of one range of ids, in order. Its frames hold whole documents' ids (little-endian unsigned
32-bit) up to about ``FRAME_BYTES``. Behind them come two skippable frames: the documents' index (id, frame, place in
the frame, tokens) and the seek table of the public seekable format: compressed size, size and the lower 32 bits of the
XXH64 of each frame's content, number of frames, flags and magic number. A reader takes the table from the end of the
file and reads and decompresses only the frames of the documents it wants, each checked.

Defined cases: null and empty texts have the end id alone. Rows that repeat an id are kept apart, in order of their
text's hash; null ids come first. An empty table gives no shards. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm.shards import bounds, filesystem, new_folder, published, shard_of
from parcelspark.llm.textkit import chunks
from parcelspark.session import cut

SHARD_BYTES = 64 << 20  # of text
FRAME_BYTES = 256 << 10
KEPT = 300_000  # words whose ids a worker remembers, twice
# fixed values of the seekable format
SKIP_INDEX, SKIP_TABLE, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


# fixed value: the splitting pattern under which letters, marks and blanks never share a token
_LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]*)")


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordEncoder:
    """Ids of whole texts. A tokenizer that lower-cases and splits letters, marks and blanks apart never joins words across
    a blank, so each word is encoded once: one of Latin letters and marks behind them as these two parts, straight by the
    tokenizer's model. Words are remembered in two generations of ``KEPT``. Any other tokenizer encodes texts whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.ids, self.old, self.parts, self.old_parts = tokenizer, {}, {}, {}, {}
        own = json.loads(tokenizer.to_str())
        kinds = [n["type"] for n in (own["normalizer"] or {}).get("normalizers", [])]
        split = (own["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.apart = kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": _LETTERS_APART}
        self.symbols = _byte_symbols()

    def part(self, word: str) -> bytes:
        """Ids of lower-cased letters alone, or of marks alone."""
        found = self.parts.get(word)
        if found is None:
            found = self.old_parts.get(word)
            if found is None:
                symbols = self.symbols  # ASCII letters and marks stand for themselves
                spelt = word if word.isascii() else "".join([symbols[b] for b in word.encode()])
                found = array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()
            if len(self.parts) >= KEPT:
                self.old_parts, self.parts = self.parts, {}
            self.parts[word] = found
        return found

    def learn(self, words: set[str]) -> None:
        """Put the ids of new words among those remembered."""
        ids, old, rest, part = self.ids, self.old, [], self.part
        for w in words:
            found = old.get(w)
            if found is None:
                if w.isascii() and w.isalpha():
                    found = part(w.lower())
                elif m := _LATIN.fullmatch(w):
                    letters, marks = m.groups()
                    found = part(letters.lower()) + part(marks) if marks else part(letters.lower())
            if found is None:
                rest.append(w)
            else:
                ids[w] = found
        if rest:
            for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
                ids[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out = []
        for text in texts:
            if len(self.ids) >= KEPT:
                self.old, self.ids = self.ids, {}
            words, ids = text.replace("\n", " ").split(" "), self.ids
            new = set(words).difference(ids)
            if new:
                self.learn(new)
            out.append(b"".join(map(ids.__getitem__, words)))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(definition: str) -> WordEncoder:
    key = str(zlib.crc32(definition.encode()))
    if key not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _encoders[key] = WordEncoder(Tokenizer.from_str(definition))
    return _encoders[key]


def _encoded(batches: Iterator[pa.RecordBatch], definition, starts, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(definition.value).encode
    last = np.array([end_id], dtype="<u4").tobytes()
    press = zstandard.ZstdCompressor(1)
    for whole in batches:
        for batch in chunks(whole, "text"):
            keys, ties = batch.column("key").to_pylist(), batch.column("tie").to_pylist()
            ids = encode([t or "" for t in batch.column("text").to_pylist()])
            shards = [shard_of(starts.value, k, t) for k, t in zip(keys, ties, strict=True)]
            packed = [press.compress(i + last) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), batch.column("key"), batch.column("tie"), pa.array(packed, pa.binary())], names=["shard", "key", "tie", "packed"])


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class ShardWriter:
    """Writes one shard to a stream; ``close`` returns how many documents and tokens it has."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes, self.press = out, frame_bytes, zstandard.ZstdCompressor(level)
        self.held, self.size, self.table, self.index, self.tokens = [], 0, [], [], 0

    def add(self, key: object, ids: bytes) -> None:
        self.index.append((key, len(self.table), self.size // 4, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        self.tokens += len(ids) // 4
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            content = b"".join(self.held)
            frame = self.press.compress(content)
            self.table.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            self.out.write(frame)
            self.held, self.size = [], 0

    def close(self) -> tuple[int, int]:
        self.flush()
        self.out.write(skippable(SKIP_INDEX, (index := self.press.compress(json.dumps(self.index).encode())) + struct.pack("<I", len(index))))
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        self.out.write(skippable(SKIP_TABLE, rows + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEK_MAGIC)))
        return len(self.index), self.tokens


class ShardReader:
    """Random access to one shard."""

    def __init__(self, file, size: int):
        self.file = file
        self.open = zstandard.ZstdDecompressor()
        n, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums")
        begin = size - 9 - 12 * n
        table = np.frombuffer(self._at(begin, 12 * n), dtype="<u4").reshape(n, 3)
        self.sizes, self.sums = table[:, :2].astype(np.int64), table[:, 2]
        self.starts = np.concatenate(([0], np.cumsum(self.sizes[:, 0])))
        tail = begin - 8
        (length,) = struct.unpack("<I", self._at(tail - 4, 4))
        self.index = json.loads(self.open.decompress(self._at(tail - 4 - length, length)))

    def _at(self, offset: int, size: int) -> bytes:
        return bytes(self.file.read_at(size, offset))

    def frame(self, i: int) -> bytes:
        content = self.open.decompress(self._at(int(self.starts[i]), int(self.sizes[i, 0])), max_output_size=int(self.sizes[i, 1]))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != int(self.sums[i]):
            raise ValueError(f"frame {i} is damaged")
        return content

    def documents(self, wanted: Iterable | None = None) -> Iterator[tuple[object, bytes]]:
        """(id, ids) of the wanted documents (None: all); only their frames are read."""
        keep = None if wanted is None else set(wanted)
        held, content = -1, b""
        for key, frame, at, n in self.index:
            if keep is None or key in keep:
                if frame != held:
                    held, content = frame, self.frame(frame)
                yield key, content[4 * at : 4 * (at + n)]


_MANIFEST = "shard int, file string, n_docs bigint, n_tokens bigint, n_bytes bigint"


def _written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (shard, key, tie): a file for each shard, and its line of the manifest."""
    opened = zstandard.ZstdDecompressor()
    rows = ((s, k, p) for b in batches for s, k, p in zip(b.column("shard").to_pylist(), b.column("key").to_pylist(), b.column("packed"), strict=True))
    row = next(rows, None)
    while row is not None:
        shard, name = row[0], f"tokens-{row[0]:06d}.bin"
        with published(folder, name) as out:
            writer = ShardWriter(out)
            while row is not None and row[0] == shard:
                writer.add(row[1], opened.decompress(row[2].as_py()))
                row = next(rows, None)
            n_docs, n_tokens = writer.close()
            n_bytes = out.tell()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [f"{folder}/{name}"], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_bytes": [n_bytes]})


def write(documents: DataFrame, definition: str, end_id: int, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode and write ``documents`` (doc_id, text); returns the manifest, a row for each shard with its first token's number.

    The manifest is written last and names finished files only.
    """
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "tokens")
    texts = documents.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    starts = spark.sparkContext.broadcast(bounds(texts, F.coalesce(F.octet_length("text"), F.lit(0)) + 8, shard_bytes))
    shared = spark.sparkContext.broadcast(definition)
    kind = dict(documents.dtypes)["doc_id"]
    coded = texts.mapInArrow(lambda it: _encoded(it, shared, starts, end_id), f"shard int, key {kind}, tie bigint, packed binary")
    placed = coded.repartition(max(1, len(starts.value)), "shard").sortWithinPartitions("shard", "key", "tie")
    manifest = cut(placed.mapInArrow(lambda it: _written(it, folder), _MANIFEST))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch], wanted: list | None, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            fs, name = filesystem(path)
            with fs.open_input_file(name) as file:
                reader = ShardReader(file, file.size())
                begin = np.concatenate(([0], np.cumsum([n for *_, n in reader.index]))) + start
                at = {id(row): int(b) for row, b in zip(reader.index, begin, strict=False)}
                keep = None if wanted is None else set(wanted)
                rows = [r for r in reader.index if keep is None or r[0] in keep]
                for i in range(0, len(rows), 256):
                    part = rows[i : i + 256]
                    held, content, ids = -1, b"", []
                    for _, frame, place, n in part:
                        if frame != held:
                            held, content = frame, reader.frame(frame)
                        ids.append(content[4 * place : 4 * (place + n)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in part], kind), pa.array([at[id(r)] for r in part], pa.int64()), pa.array([r[3] for r in part], pa.int64()), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )


def read(manifest: DataFrame, kind: str = "bigint", wanted: list | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of the wanted ids; ``ids`` are the bytes as written."""
    files = manifest.select("file", "start").repartition(max(1, manifest.count()), "file")
    arrow = pa.int64() if kind == "bigint" else pa.string() if kind == "string" else pa.int32()
    return files.mapInArrow(lambda it: _read(it, wanted, arrow), f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")
