"""Fill-in-middle transformation over seekable compressed text.

``store`` keeps each text as independent zstandard frames of about ``FRAME_BYTES`` with the cumulative numbers of units
(tokens of blanks before a word, or blanks at the end), characters, bytes and compressed bytes behind each. A unit ends
where a word does and at the end of the text, which one byte and the next tell, so units are counted for a whole Arrow
batch of bytes at once. A frame ends at the last unit that fits, or inside a unit longer than a frame, between characters.

``plan`` decides form and cuts from the id's hash and the number of units alone, as columns. ``forms`` then finds each
cut's frame in the cumulative counts and decompresses that frame to find the place in it; the output and its digest are
streamed frame by frame in the order of the form, and the text is rebuilt from the output and the form alone.

Defined cases: a null text is empty, an empty one plain, with no units. A null id is hashed as the empty text. Every row
has a result, repeated ids and rows included. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.textkit import NOT_SPACE, chunks, flat

FRAME_BYTES = 64 << 10
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = {"plain": (), "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
_ENDS = ("unit_ends", "char_ends", "byte_ends", "frame_ends")


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in ``data`` just behind each unit of the texts that begin at ``offsets``."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    word = NOT_SPACE[data]
    last = np.zeros(len(data), dtype=bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    ends = last.copy()
    ends[:-1] |= word[:-1] & ~word[1:]
    return np.flatnonzero(ends) + 1


def frame_cuts(data: np.ndarray, ends: np.ndarray, size: int) -> list[int]:
    """Where the frames of one text end: at the last unit within ``size`` bytes, or inside a longer unit between characters."""
    cuts, at = [], 0
    while len(data) - at > size:
        i = int(np.searchsorted(ends, at + size, "right")) - 1
        end = int(ends[i]) if i >= 0 and ends[i] > at else at + size
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        cuts.append(end if end > at else at + size)
        at = cuts[-1]
    return [*cuts, len(data)] if len(data) > at else cuts


def _stored(batches: Iterator[pa.RecordBatch], frame_bytes: int) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(3).compress
    for whole in batches:
        for batch in chunks(whole, "text"):
            data, offsets = flat(batch.column("text"))
            ends = unit_ends(data, offsets)
            of_text = np.searchsorted(ends, offsets, "right")
            chars = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))
            rows, content = {k: [] for k in _ENDS}, []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                own = ends[of_text[i] : of_text[i + 1]] - a
                cuts = [b - a] if 0 < b - a <= frame_bytes else frame_cuts(data[a:b], own, frame_bytes)
                frames = [press(data[a + s : a + e].tobytes()) for s, e in zip([0, *cuts], cuts, strict=False)]
                content.append(b"".join(frames))
                rows["unit_ends"].append(np.searchsorted(own, cuts, "right"))
                rows["char_ends"].append(chars[np.array(cuts, dtype=np.int64) + a] - chars[a])
                rows["byte_ends"].append(cuts)
                rows["frame_ends"].append(np.cumsum([len(f) for f in frames], dtype=np.int64))
            counts = [pa.array(rows[k], pa.list_(pa.int64())) for k in _ENDS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("marked"), *counts, pa.array(content, pa.binary())], names=["doc_id", "marked", *_ENDS, "frames"])


def store(documents: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """A row of frames and cumulative counts for each row of ``documents``; ``marked`` tells that the text has one of the marks."""
    text = F.col("text").cast("string")
    marked = F.coalesce(text.contains(PREFIX.decode()) | text.contains(SUFFIX.decode()) | text.contains(MIDDLE.decode()), F.lit(False))
    kind = dict(documents.dtypes)["doc_id"]
    counts = ", ".join(f"{k} array<bigint>" for k in _ENDS)
    rows = documents.select("doc_id", marked.alias("marked"), text.alias("text"))
    return rows.mapInArrow(lambda it: _stored(it, frame_bytes), f"doc_id {kind}, marked boolean, {counts}, frames binary")


def plan(stored: DataFrame, seed: int = 42, plain_from: int = 50, psm_from: int = 80) -> DataFrame:
    """Adds n (units), form, and first and second, the units before the two cuts."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    n: Column = F.coalesce(F.try_element_at("unit_ends", F.lit(-1)), F.lit(0))
    form = F.when((n == 0) | F.col("marked") | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < psm_from, "spm").otherwise("psm")
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return stored.select("*", n.alias("n"), form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


class Frames:
    """One stored text."""

    def __init__(self, content: bytes, ends: dict[str, np.ndarray], opener: zstandard.ZstdDecompressor):
        self.content, self.ends, self.open = content, ends, opener

    def frame(self, i: int) -> bytes:
        starts, sizes = self.ends["frame_ends"], self.ends["byte_ends"]
        begin, size = (int(starts[i - 1]), int(sizes[i] - sizes[i - 1])) if i else (0, int(sizes[0]))
        return self.open.decompress(memoryview(self.content)[begin : int(starts[i])], max_output_size=size)

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, characters) before the end of the ``units``-th unit; only the frame it ends in is opened."""
        counts = self.ends["unit_ends"]
        if units == 0:
            return 0, 0
        if units == counts[-1]:
            return int(self.ends["byte_ends"][-1]), int(self.ends["char_ends"][-1])
        i = int(np.searchsorted(counts, units))
        before = {k: int(self.ends[k][i - 1]) if i else 0 for k in _ENDS}
        data = np.frombuffer(self.frame(i), dtype=np.uint8)
        word = NOT_SPACE[data]
        inner = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        k = units - before["unit_ends"] - 1
        end = int(inner[k]) if k < len(inner) else len(data)
        return before["byte_ends"] + end, before["char_ends"] + int(np.count_nonzero(data[:end] & 0xC0 != 0x80))

    def stream(self, begin: int, end: int) -> Iterator[bytes]:
        """Bytes ``begin`` to ``end``, a frame at a time."""
        ends = self.ends["byte_ends"]
        i = int(np.searchsorted(ends, begin, "right"))
        while begin < end:
            start = int(ends[i - 1]) if i else 0
            yield self.frame(i)[begin - start : end - start]
            begin, i = int(ends[i]), i + 1

    def output(self, form: str, first: int, second: int) -> Iterator[bytes]:
        """The transformed text; ``first`` and ``second`` are the cuts in bytes."""
        size = int(self.ends["byte_ends"][-1]) if len(self.ends["byte_ends"]) else 0
        spans = ((0, first), (first, second), (second, size))
        if form == "plain":
            yield from self.stream(0, size)
        for mark, part in FORMS[form]:
            yield mark
            yield from self.stream(*spans[part])


def restored(output: bytes, form: str) -> list[memoryview]:
    """The pieces of the text that was transformed into ``output``.

    No part has a mark in it, and a mark cannot begin inside another, so the first place of each mark is its own.
    """
    view = memoryview(output)
    if form == "plain":
        return [view]
    marks = [m for m, _ in FORMS[form]]
    places, at = [], 0
    for m in marks:
        places.append(output.index(m, at))
        at = places[-1] + len(m)
    parts = {part: view[p + 3 : q] for (_, part), p, q in zip(FORMS[form], places, [*places[1:], len(output)], strict=True)}
    return [parts[0], parts[1], parts[2]]


_OUT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"


def _formed(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    opener = zstandard.ZstdDecompressor()
    for whole in batches:
        for batch in chunks(whole, "frames", 1 << 19):
            lists = {k: (batch.column(k).flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(batch.column(k).value_lengths().to_numpy(zero_copy_only=False))))) for k in _ENDS}
            forms, first, second = (batch.column(k).to_pylist() for k in ("form", "first", "second"))
            prefix, middle, made, back, outputs = [], [], [], [], []
            for i, form in enumerate(forms):
                doc = Frames(batch.column("frames")[i].as_py(), {k: v[o[i] : o[i + 1]] for k, (v, o) in lists.items()}, opener)
                (a, chars_a), (b, chars_b) = (doc.cut(first[i]), doc.cut(second[i])) if form != "plain" else ((0, None), (0, None))
                prefix.append(chars_a)
                middle.append(None if chars_a is None else chars_b - chars_a)
                pieces, digest, again = [], hashlib.sha256(), hashlib.sha256()
                for piece in doc.output(form, a, b):
                    digest.update(piece)
                    pieces.append(piece)
                output = b"".join(pieces)
                for piece in restored(output, form):
                    again.update(piece)
                made.append(digest.hexdigest())
                back.append(again.hexdigest())
                if texts:
                    outputs.append(output)
            columns = [batch.column("doc_id"), batch.column("n"), batch.column("form"), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(made), pa.array(back)]
            names = ["doc_id", *(c.split()[0] for c in _OUT.split(", "))]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(outputs, pa.binary()).cast(pa.string())] if texts else [])], names=[*names, *(["output"] if texts else [])])


def forms(planned: DataFrame, texts: bool = False) -> DataFrame:
    """Form, sizes and digests of each planned row; with ``texts`` the transformed text too."""
    kind = dict(planned.dtypes)["doc_id"]
    rows = planned.select("doc_id", "n", "form", "first", "second", *_ENDS, "frames")
    return rows.mapInArrow(lambda it: _formed(it, texts), f"doc_id {kind}, {_OUT}" + (", output string" if texts else ""))
