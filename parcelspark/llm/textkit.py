"""Words and word windows of whole Arrow text columns, hashed with array operations.

Texts are looked at as UTF-8 bytes. Both word rules in use are byte rules: every byte of a non-ASCII character is at
least 0x80, so a class of bytes decides for the whole character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # texts looked at together; a longer text stands alone
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# bytes that belong to words, after lower-casing A-Z
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of those taken."""
    known, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for at, base in ((0, _BASE), (1, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, each of one text or of texts of about ``size`` bytes together, ``rows`` at most."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths) // size
    cuts = sorted({0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), *range(0, batch.num_rows, rows), batch.num_rows})
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text starts (one more entry for the end). Null is empty."""
    arr = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    if data is None or not len(arr):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(arr) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a column: byte spans, 64-bit hashes, and where each text's words start."""

    def __init__(self, column: pa.Array, member: np.ndarray):
        raw, offsets = flat(column)
        self.data = LOWER[raw]
        inside = member[self.data]
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
        after = np.concatenate((inside[1:], [False])) if len(raw) else inside
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.offsets = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.offsets)
        up, down = powers(len(raw) + 1)
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[self.data] * up[:-1], dtype=np.uint64)))
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.text_of = np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every k consecutive words of one text, and the number of its first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.text_of[:n] == self.text_of[k - 1 :])
        up, _ = powers(k + 1)
        total = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            total += self.hash[j : j + n] * up[j + 1]
        return mix(total[at] + np.uint64(k)), at

    def joined(self, first: int, k: int) -> bytes:
        """k words from word ``first`` on, with single spaces between them."""
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(first, first + k))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct k-word shingles of each text, and where each text's start.

        A text of fewer words, but not none, has its whole word sequence as its one shingle.
        """
        g, at = self.grams(k)
        owner = self.text_of[at]
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        if len(short):
            up, _ = powers(k + 1)
            whole = [np.sum(self.hash[self.offsets[i] : self.offsets[i + 1]] * up[1 : self.counts[i] + 1], dtype=np.uint64) + np.uint64(self.counts[i]) for i in short]
            g = np.concatenate((g, mix(np.array(whole, dtype=np.uint64))))
            owner = np.concatenate((owner, short))
        order = np.lexsort((g, owner))
        g, owner = g[order], owner[order]
        keep = np.ones(len(g), dtype=bool)
        keep[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        g, owner = g[keep], owner[keep]
        return g, np.searchsorted(owner, np.arange(len(self.counts) + 1))
