"""Byte-level BPE as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

Merges apply in the order of their list, so what follows a text can change its tokens only through a chain of merges of
growing rank, each of which moves the first changed place left by its own left part. The longest such chain, found once
for a merge list by one pass over it, is the list's *sufficient lookahead*: tokens that end so many bytes before the end
of what has been read are those of the whole text, whatever follows. The transducer holds two lookaheads of bytes,
gives out the tokens that are stable and goes on from the last boundary, so its memory does not depend on the input.
Byte strings shorter than that, which nearly all words are, end before any token has to be given out early; their ids
are remembered in two generations of ``KEPT``.

Texts are cut at the tokenizer's added tokens and split by its pattern in windows that begin at blanks behind other
characters, where the pattern always splits. Where the library knows a character's class otherwise than the pattern's
engine (other versions of Unicode), the library splits that text.

Defined cases: null and empty texts have no ids and decode to the empty text. Every row has a result, repeated ids and
rows included. Columns other than id and text are not read; ids may be of any type. Bytes that are no UTF-8 decode to
U+FFFD as the library's do. Tokenizers with another pre-tokenizer, a normaliser, dropout, or merges whose parts no
earlier merge makes are refused.
"""

from __future__ import annotations

import codecs
import heapq
import json
import zlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.textkit import chunks

KEPT = 300_000  # words whose ids a worker remembers, twice
WINDOW = 1 << 16  # characters split together
TOKEN = (1 << 24) - 1  # a merge is kept as its rank above these bits and the token it makes in them
NO_MERGE = 1 << 62
# fixed values: the splitting pattern, and what does not lie in ranges whose classes no version of Unicode has changed
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_UNSETTLED = regex.compile(r"[^\x00-˿Ѐ-ӿ‐-‧ぁ-ゖァ-ヺ一-龥가-힣]")
_BOUNDARY = regex.compile(r"(?<=\P{White_Space}) ")


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others in order from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def lookahead(merges: Iterable[tuple[bytes, bytes]]) -> int:
    """Bytes behind a token's end after which nothing that follows can change the token.

    Think of a text read on in two ways. Before any merge the two differ from the end on. A merge of x and y that is made
    in only one of them moves the first difference to the start of x, where the one has x and the other xy, either of
    which later grows at its right end alone. So a later merge moves it on only if x is its right part or the first
    part (of the first part ...) of its right part. ``far`` has for each x how far left a difference can have come by
    merges up to now when it begins with x.
    """
    first: dict[bytes, bytes] = {}
    far: dict[bytes, int] = {}
    most = 0
    for x, y in merges:
        if any(len(p) > 1 and p not in first for p in (x, y)):
            raise ValueError("a merge has a part that no earlier merge makes")
        part, before = y, 0
        while part is not None:
            before = max(before, far.get(part, 0))
            part = first.get(part)
        moved = len(x) + before
        far[x] = max(far.get(x, 0), moved)
        most = max(most, moved)
        first.setdefault(x + y, x)
    return most


class Transducer:
    """Tokens of one byte string, given in pieces of any size; ``push`` and ``close`` return the ids that are final."""

    def __init__(self, single: list[int], merges: dict[tuple[int, int], int], sizes: list[int], ahead: int):
        self.single, self.merges, self.sizes, self.ahead = single, merges, sizes, ahead
        self.held = b""

    def push(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = 2 * self.ahead + 64
        if len(self.held) + len(data) <= step:
            self.held += data
            return out
        for i in range(0, len(data), step):
            self.held += data[i : i + step]
            if len(self.held) > step:
                stable, end = len(self.held) - self.ahead, 0
                for token in self.merged(self.held):
                    if end + self.sizes[token] > stable:
                        break
                    end += self.sizes[token]
                    out.append(token)
                self.held = self.held[end:]
        return out

    def close(self) -> list[int]:
        out, self.held = self.merged(self.held), b""
        return out

    def merged(self, data: bytes) -> list[int]:
        """All merges within ``data``: the least rank first, of equal ranks the leftmost."""
        ids, get = list(map(self.single.__getitem__, data)), self.merges.get
        if len(ids) > 48:
            return self._merged_long(ids)
        found = [get(pair, NO_MERGE) for pair in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) != NO_MERGE:
            i = found.index(best)
            ids[i : i + 2] = [best & TOKEN]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), NO_MERGE)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), NO_MERGE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = m & TOKEN, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (m := merges.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (m, a, ids[a], ids[b]))
        return [t for t in ids if t >= 0]


class TextDecoder:
    """Text of token ids given in pieces: the state is the bytes of at most one unfinished character."""

    def __init__(self, token_bytes: list[bytes]):
        self.token_bytes, self.state = token_bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        known, n = self.token_bytes, len(self.token_bytes)
        return self.state.decode(b"".join([known[i] for i in ids if i < n]))

    def close(self) -> str:
        return self.state.decode(b"", final=True)


class Bpe:
    """A tokenizer definition, compiled."""

    def __init__(self, definition: str):
        own = json.loads(definition)
        model, split = own["model"], own["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and (own["decoder"] or {}).get("type") == "ByteLevel"
        added = own["added_tokens"]
        if not plain or not level or own["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("only byte-level BPE without normaliser, dropout and stripping added tokens is compiled")
        symbols, vocab = byte_symbols(), model["vocab"]
        of = lambda t: bytes([symbols[c] for c in t]) if all(c in symbols for c in t) else t.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ahead = lookahead([(of(x), of(y)) for x, y in pairs])
        self.merges = {}
        for rank, (x, y) in enumerate(pairs):
            self.merges[vocab[x], vocab[y]] = rank * (TOKEN + 1) + vocab[x + y]
        names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in added}
        self.token_bytes = [of(names[i]) if i in names else b"" for i in range(max(names) + 1)]
        self.sizes = [len(t) for t in self.token_bytes]
        self.single = [0] * 256
        for symbol, b in symbols.items():
            self.single[b] = vocab[symbol]
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.apart = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if added else None
        self.definition, self.library, self.classes = definition, None, {}
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def transducer(self) -> Transducer:
        return Transducer(self.single, self.merges, self.sizes, self.ahead)

    def known_alike(self, text: str) -> bool:
        """Whether the library splits at the text's characters as the pattern does."""
        new = {c for c in _UNSETTLED.findall(text) if c not in self.classes}
        if new and self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.definition).pre_tokenizer
        for c in new:
            probe = f"a{c}1{c}.{c} {c}"
            self.classes[c] = [o for _, o in self.library.pre_tokenize_str(probe)] == [m.span() for m in _SPLIT.finditer(probe)]
        return all(self.classes[c] for c in set(_UNSETTLED.findall(text)))

    def windows(self, text: str) -> Iterator[list[str]]:
        """The text's words, a window at a time."""
        if not self.known_alike(text):
            yield [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
            return
        start = 0
        while start < len(text):
            cut = _BOUNDARY.search(text, start + WINDOW) if len(text) - start > WINDOW else None
            end = cut.start() if cut else len(text)
            yield _SPLIT.findall(text, start, end) if start or end < len(text) else _SPLIT.findall(text)
            start = end

    def learn(self, words: set[str]) -> list[str]:
        """Put the ids of new words among those remembered; returns the words too long to stay there."""
        old, machine = self.old, self.transducer()
        for w in words:
            found = old.get(w)
            self.ids[w] = array("I", machine.push(w.encode()) + machine.close()).tobytes() if found is None else found
        return [w for w in words if len(w) > self.ahead]

    def pieces(self, text: str) -> Iterator[bytes]:
        """Ids (little-endian unsigned 32-bit) of a text without added tokens."""
        for words in self.windows(text):
            if len(self.ids) >= KEPT:
                self.old, self.ids = self.ids, {}
            long = self.learn(set(words).difference(self.ids))
            yield b"".join(map(self.ids.__getitem__, words))
            for w in long:
                del self.ids[w]

    def encode(self, text: str) -> bytes:
        if self.apart is None or not self.apart.search(text):
            return b"".join(self.pieces(text))
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += [*self.pieces(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return b"".join([*out, *self.pieces(text[at:])])

    def decode(self, ids: bytes, step: int = 1 << 16) -> str:
        decoder, codes = TextDecoder(self.token_bytes), array("I", ids)
        return "".join([decoder.push(codes[i : i + step]) for i in range(0, len(codes), step)] + [decoder.close()])


_compiled: dict[int, Bpe] = {}


def compiled(definition: str) -> Bpe:
    key = zlib.crc32(definition.encode())
    if key not in _compiled:
        _compiled[key] = Bpe(definition)
    return _compiled[key]


def _encoded(batches: Iterator[pa.RecordBatch], definition) -> Iterator[pa.RecordBatch]:
    encode = compiled(definition.value).encode
    for whole in batches:
        for batch in chunks(whole, "text"):
            ids = [encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])


def encode(documents: DataFrame, definition: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of ``documents``; ``ids`` are little-endian unsigned 32-bit integers."""
    shared = documents.sparkSession.sparkContext.broadcast(definition)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda it: _encoded(it, shared), f"doc_id {dict(documents.dtypes)['doc_id']}, n_tokens bigint, ids binary")


def _decoded(batches: Iterator[pa.RecordBatch], definition) -> Iterator[pa.RecordBatch]:
    decode = compiled(definition.value).decode
    for whole in batches:
        for batch in chunks(whole, "ids"):
            texts = pa.array([decode(i or b"") for i in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=["doc_id", "n_tokens", "ids", "text"])


def decode(coded: DataFrame, definition: str) -> DataFrame:
    """The result of ``encode`` with the ``text`` that its ids stand for."""
    shared = coded.sparkSession.sparkContext.broadcast(definition)
    rows = coded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(lambda it: _decoded(it, shared), f"doc_id {dict(coded.dtypes)['doc_id']}, n_tokens bigint, ids binary, text string")
