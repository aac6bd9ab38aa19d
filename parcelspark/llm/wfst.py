"""SentencePiece encoding and decoding with a weighted finite-state transducer over the tropical semiring.

The model file is compiled to a transducer whose states remember the last piece:

* normaliser: a space becomes the space mark, and one is put in front where the model asks for it;
* pieces: an arc from a state reads a piece's characters, writes its id and leads to that piece's state. In a unigram
  model its weight is minus the piece's score. In a merge (BPE) model it weighs nothing if the two pieces can stand side
  by side, which is whether merging their joined text gives just these two, and is infinite if not;
* byte fallback: a character that is in no piece is read by one arc that writes its bytes' ids.

A text is composed with it one segment at a time and the path of least weight is taken. In a merge model exactly one
path has a finite weight, and it is what greedy merging gives: any sequence of which each neighbouring pair is stable is
stable as a whole, because the first merge across a border would have been made in that pair alone as well. Segments
end where no piece has the two characters side by side, so paths never depend on what lies beyond.

Defined cases: null text has null ids; empty text has none. Extra columns are kept, `ids` and its companions replace
columns of those names. Characters that are the space mark itself decode to spaces. Models with an own character map
are refused when the file is read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parcelspark.llm.textkit import chunks

MARK = "▁"
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in the model file
_ONE = (1,)
KEPT = 350_000  # segments and pairs that a worker remembers, twice; what is forgotten is worked out again


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces and settings of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.prefix, self.squeeze, self.unknown = UNIGRAM, True, True, 0
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]), f.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("the model has a character map; only identity normalisation is compiled")
                self.prefix, self.squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))


class Transducer:
    def __init__(self, model: Model):
        self.model = model
        self.id = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, UNUSED)}
        self.score = {p: model.pieces[i][1] for p, i in self.id.items()}
        self.bytes = [0] * 256
        self.byte_of = {}
        for i, (p, _, kind) in enumerate(model.pieces):
            if kind == BYTE:
                self.bytes[int(p[3:5], 16)] = i
                self.byte_of[i] = bytes([int(p[3:5], 16)])
        # what the inverse writes for each id
        self.raw = [self.byte_of[i] if i in self.byte_of else b"" if kind == CONTROL else p.encode() for i, (p, _, kind) in enumerate(model.pieces)]
        self.unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
        self.longest = max(map(len, self.id), default=1)
        self.side_by_side = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        known = {c for p in self.id for c in p} - {MARK}
        joined = any(MARK in p.lstrip(MARK) for p in self.id)  # a piece with the mark after other characters
        mixed = any(p[0].isalpha() and not p[1].isalpha() for p in self.side_by_side)
        letters, others = ("".join(re.escape(c) for c in sorted(known) if c.isalpha() == kind) for kind in (True, False))
        every = letters + others
        # segments that no piece crosses: cut at marks and, where the pieces allow it, behind letters
        inside = f"[{every}{MARK}]+" if joined else f"{MARK}*[{every}]+|{MARK}+" if mixed else f"{MARK}*[{others}]*[{letters}]+|{MARK}*[{others}]+|{MARK}+"
        self.rough = re.compile(f"{inside}|[^{every}{MARK}]")
        # lengths of the pieces that end with the same two characters, the longest first
        tails: dict[str, set[int]] = {}
        for p in self.id:
            tails.setdefault(p[-2:], {1}).add(len(p))
        self.sizes = {t: tuple(sorted(n, reverse=True)) for t, n in tails.items()}
        self.made: dict[str, list[tuple[float, str, str]] | None] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.old_pairs: dict[tuple[str | None, str], bool] = {}
        self.segments: dict[str, tuple[int, ...]] = {}
        self.old_segments: dict[str, tuple[int, ...]] = {}

    # compile: normaliser
    def normalised(self, text: str) -> str:
        if self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.model.prefix and text:
            text = " " + text
        return text.replace(" ", MARK)

    # compile: arcs between piece states of a merge model
    def merging(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """Greedy merging (the best-scored neighbouring pair first, of equal ones the leftmost) of a text alone.

        Returns its pieces, and for each merge its score and the first and last symbol before it; the last entry, of
        score minus infinity, has them at the end.
        """
        parts, steps, score = list(text), [], self.score
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (at < 0 or s > best):
                    best, at = s, i
            steps.append((best, parts[0], parts[-1]))
            if at < 0:
                return parts, steps
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def steps(self, piece: str) -> list[tuple[float, str, str]] | None:
        """Merges that make the piece, None if merging does not give it."""
        if piece not in self.made:
            parts, steps = self.merging(piece)
            self.made[piece] = steps if len(parts) == 1 else None
        return self.made[piece]

    def stable(self, before: str | None, piece: str) -> bool:
        """Whether the arc from the state of ``before`` over ``piece`` has a finite weight.

        Side by side the two go through their own merges, the better one first, until a merge across their border is
        better than both (or as good as the right one's, being further left).
        """
        found = self.pairs.get((before, piece))
        if found is None:
            found = self.old_pairs.get((before, piece))
            if found is None:
                found = self.steps(piece) is not None and (before is None or self._apart(self.steps(before), self.steps(piece)))
            self.pairs[before, piece] = found
        return found

    def _apart(self, left: list[tuple[float, str, str]], right: list[tuple[float, str, str]]) -> bool:
        i = j = 0
        score = self.score
        while True:
            (a, _, last), (b, first, _) = left[i], right[j]
            across = score.get(last + first)
            if across is not None and across > a and across >= b:
                return False
            if a == b == -np.inf:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    def shortest(self, segment: str) -> list[str]:
        """Pieces (or single characters that are in none) on the path of least weight."""
        n, longest, ids = len(segment), self.longest, self.id
        if self.model.kind == MERGES:
            if segment in ids and self.stable(None, segment):
                return [segment]
            last: list[str | None] = [None] * (n + 1)
            pairs, stable, sizes = self.pairs, self.stable, self.sizes
            for end in range(1, n + 1):
                for size in sizes.get(segment[end - 2 : end] if end > 1 else segment[0], _ONE):
                    if size > end:
                        continue
                    piece = segment[end - size : end]
                    if size == 1 or piece in ids:
                        before = last[end - size]
                        ok = pairs.get((before, piece))
                        if ok or ok is None and stable(before, piece):
                            last[end] = piece
                            break
            path, at = [], n
            while at:
                path.append(last[at])
                at -= len(last[at])
            return path[::-1]
        least, back = [0.0] + [np.inf] * n, [0] * (n + 1)
        lowest = min(self.score.values(), default=0.0) - 10.0
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                piece = segment[start:end]
                weight = -self.score[piece] if piece in ids else -lowest if end - start == 1 else np.inf
                if least[start] + weight < least[end]:
                    least[end], back[end] = least[start] + weight, start
        path, at = [], n
        while at:
            path.append(segment[back[at] : at])
            at = back[at]
        return path[::-1]

    def ids_of(self, segment: str) -> tuple[int, ...]:
        found = self.old_segments.get(segment)
        if found is None:
            ids, out = self.id, []
            cuts = [i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in self.side_by_side]
            for begin, end in zip([0, *cuts], [*cuts, len(segment)], strict=True):
                for piece in self.shortest(segment[begin:end]):
                    i = ids.get(piece)
                    if i is not None:
                        out.append(i)
                    elif self.byte_of:
                        out += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
                    else:
                        out.append(self.unknown)
            found = tuple(out)
        if len(segment) <= 64:
            self.segments[segment] = found
        return found

    def encode(self, text: str) -> list[int]:
        if len(self.segments) >= KEPT:
            self.old_segments, self.segments = self.segments, {}
        if len(self.pairs) >= KEPT:
            self.old_pairs, self.pairs = self.pairs, {}
        out: list[int] = []
        get, slow = self.segments.get, self.ids_of
        for segment in self.rough.findall(self.normalised(text)):
            out += get(segment) or slow(segment)
        return out

    def decode(self, ids: list[int]) -> str:
        """The inverse transducer: marks become spaces, the one put in front is taken off, runs of bytes are UTF-8."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


_compiled: dict[int, Transducer] = {}


def transducer(model: bytes) -> Transducer:
    """The compiled transducer of a model file; a worker compiles each once."""
    key = zlib.crc32(model)
    if key not in _compiled:
        _compiled[key] = Transducer(Model(model))
    return _compiled[key]


def _encoded(batches: Iterator[pa.RecordBatch], model, names: list[str]) -> Iterator[pa.RecordBatch]:
    machine = transducer(model.value)
    for whole in batches:
        for batch in chunks(whole, "text"):
            ids, same, digest = [], [], []
            for text in batch.column("text").to_pylist():
                own = None if text is None else machine.encode(text)
                back = None if own is None else machine.decode(own)
                ids.append(own)
                same.append(None if own is None else back == text)
                digest.append(None if own is None else hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
            n = [None if x is None else len(x) for x in ids]
            own_columns = [pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(same, pa.bool_()), pa.array(digest)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *own_columns], names=[*names, "ids", "n_ids", "round_trip", "decoded_sha256"])


def model_bytes(path: str) -> bytes:
    """A model file, read once on the driver: a vocabulary, whose size does not depend on the data."""
    with open(path, "rb") as f:
        return f.read()


def encode(documents: DataFrame, model: bytes) -> DataFrame:
    """``documents`` with ids, n_ids, round_trip (decoding gives the text again) and the decoded text's SHA-256."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = [c for c in documents.columns if c not in ("ids", "n_ids", "round_trip", "decoded_sha256")]
    kept = documents.select(*names)
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
    return kept.mapInArrow(lambda it: _encoded(it, shared, names), f"{schema}, ids array<int>, n_ids bigint, round_trip boolean, decoded_sha256 string")
