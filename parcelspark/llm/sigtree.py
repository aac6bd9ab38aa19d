"""N-gram Jaccard join with signature trees: exact links at 75 %, returned as components.

1. Equal shingle sets are one class. Each class has a bitmap of its shingles, its signature: a power of two of bits,
   twice the set's size at least, but no more than ``SIGNATURE_BITS``.
2. Two linked sets share a shingle among the first quarter of each in any order that all sets use. Shingles that a
   sketch of fixed size has found frequent come last in that order, so shared boilerplate seldom brings sets together.
   A bucket is the classes that have a shingle in that first quarter.
   Buckets of the same members are one bucket; a bucket in order of size is cut where neighbours' sizes rule a link out.
3. Every bucket is a signature tree. Members in order of size are cut into leaves; nodes hold the OR of their bitmaps
   and their ranges of size and component. A dual traversal from the root drops pairs of nodes whose largest possible
   overlap is too small, or that are one component already; members of the leaves that stay are held against each other
   the same way, and the pairs that pass are compared exactly, on the texts.
4. The trees are used several times. At first every class enters one bucket a turn, its largest, then its rarest, then
   others in turn, and is compared with one other only, the one of another component for which the bound on the overlap is best,
   in turns as long as a quarter of the pairs compared are links: near copies of one text meet that text, and large groups
   become one component by about one comparison a class. Then every possible link between the components that are left
   is compared, put forward in the first bucket that its two classes share.
A link is only ever left out where both ends are in one component already, so components are exact.

Defined cases: null, empty and blank texts have no shingles, link with nothing and stand alone. Rows that repeat both
id and text are returned once; rows that share an id, null too, but not the text are returned apart. A component's id
is the smallest id in it, null only if all are. Extra columns are not read.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm.bitmap import hash_bits, may_have
from parcelspark.llm.graph import components
from parcelspark.llm.textkit import NOT_SPACE, Words, chunks, free_names, mix
from parcelspark.session import cut

WORDS = 5
SHARE = (75, 100)  # a link: intersection / union is at least this
LEAF = 64
NEAR = 48  # leaves before a leaf that its task still holds; pairs of leaves further apart meet in a join
FAN_OUT = 8
NODE_BITS = 2048
SIGNATURE_BITS = 1 << 14
FIRST, NONE = 16, np.iinfo(np.int64).max  # buckets of a class that travel with it, and what stands for none
COMPARED = 500  # pairs whose sets a task holds at a time
SKETCH_LOG2 = 22  # bins, one byte each when broadcast
SKETCH_SHARE = 16  # one text in so many is counted for the order of shingles, which no result depends on


def set_key(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits that name each set; 0 for the empty set."""
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    sums = total[starts[1:]] - total[starts[:-1]]
    n = np.diff(starts).astype(np.uint64)
    return np.where(n > 0, mix(sums + n), np.uint64(0))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Bitmap in 64-bit words; its length is a power of two, so a longer one folds to a shorter. At most ``SIGNATURE_BITS``:
    a set's rows in all its buckets would else grow with the square of its size. Bounds hold for any length."""
    n_words = 1
    while n_words * 64 < min(2 * len(shingles), SIGNATURE_BITS):
        n_words *= 2
    bits = np.zeros(n_words * 64, dtype=bool)
    bits[(shingles & np.uint64(n_words * 64 - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(sig: np.ndarray, n_words: int) -> np.ndarray:
    return np.bitwise_or.reduce(sig.reshape(-1, n_words), axis=0) if len(sig) > n_words else sig


def needed(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Smallest overlap of a link between sets of these sizes."""
    num, den = share
    return -((-num * (a + b)) // (den + num))


def linked(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> bool:
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return share[1] * both >= share[0] * (len(a) + len(b) - both)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text"):
            g, starts = Words(batch.column("text"), NOT_SPACE).shingles(WORDS)
            sigs = [signature(g[a:b]).tobytes() for a, b in zip(starts, starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(set_key(g, starts).view(np.int64)), pa.array(np.diff(starts).astype(np.int64)), pa.array(sigs, pa.binary())],
                names=["doc_id", "text_key", "cls", "n", "sig"],
            )


def _sketch_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text"):
            g, _ = Words(batch.column("text"), NOT_SPACE).shingles(WORDS)
            bins, n = np.unique((g >> np.uint64(64 - SKETCH_LOG2)).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n)], names=["bin", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], levels, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(shingle, class, size of the class) for the first shingles of each set, once for each set of a task."""
    level, done = levels.value, set()
    for whole in batches:
        for batch in chunks(whole, "text"):
            g, starts = Words(batch.column("text"), NOT_SPACE).shingles(WORDS)
            keys = set_key(g, starts)
            tokens, owners, sizes = [], [], []
            for i, key in enumerate(keys.tolist()):
                if key in done or starts[i] == starts[i + 1]:
                    continue
                done.add(key)
                own = g[starts[i] : starts[i + 1]]
                n = len(own)
                first = n + (-share[0] * n) // share[1] + 1
                rank = (level[(own >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (mix(own) >> np.uint64(6))
                tokens.append(own[np.argpartition(rank, first - 1)[:first]] if first < n else own)
                owners.append(np.full(first, key, dtype=np.uint64))
                sizes.append(np.full(first, n, dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners).view(np.int64)), pa.array(np.concatenate(sizes))], names=["token", "cls", "n"])


def _pack(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    """Compressed texts of the rows whose ``text_key`` may be wanted."""
    zip_ = zstandard.ZstdCompressor(3)
    for batch in batches:
        keep = pa.array(may_have(bits.value, batch.column("text_key").to_numpy().view(np.uint64)))
        packed = [zip_.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").filter(keep)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(keep), batch.column("text_key").filter(keep), pa.array(packed, pa.binary())], names=["doc_id", "text_key", "packed"])


def _unpacked(packed: list[bytes]) -> list[np.ndarray]:
    """Shingle sets of compressed texts, worked out together."""
    open_ = zstandard.ZstdDecompressor().decompress
    batch = pa.RecordBatch.from_arrays([pa.array([open_(p) for p in packed], pa.binary())], names=["text"])
    sets: list[np.ndarray] = []
    for part in chunks(batch, "text"):
        g, starts = Words(part.column("text"), NOT_SPACE).shingles(WORDS)
        sets += [g[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    return sets


def _compare(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(at, COMPARED) for at in range(0, whole.num_rows, COMPARED)):
            keys = [batch.column(c).to_pylist() for c in ("a", "b")]
            texts = dict(zip(keys[0], batch.column("packed_a").to_pylist(), strict=True)) | dict(zip(keys[1], batch.column("packed_b").to_pylist(), strict=True))
            sets = dict(zip(texts, _unpacked(list(texts.values())), strict=True))
            found = [(a, b) for a, b in zip(*keys, strict=True) if linked(sets[a], sets[b], share)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def compare(pairs: DataFrame, texts: DataFrame, classes: DataFrame, share: tuple[int, int]) -> tuple[DataFrame, int]:
    """The pairs (a, b) of classes that are links, and how many were compared. A set is taken from the text of its class's first row."""
    spark = pairs.sparkSession
    pairs = cut(pairs)
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    named = cut(wanted.join(classes, "cls").select("cls", F.col("rep.doc_id").alias("_id"), F.col("rep.text_key").alias("_key")))
    bits = spark.sparkContext.broadcast(hash_bits(named, "_key"))
    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, text_key bigint, packed binary"
    near = texts.mapInArrow(lambda it: _pack(it, bits), schema)
    have = near.join(named, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    packed = cut(have.groupBy("cls").agg(F.min("packed").alias("packed")))
    one = pairs.join(packed.select(F.col("cls").alias("b"), F.col("packed").alias("packed_b")), "b")
    two = one.join(packed.select(F.col("cls").alias("a"), F.col("packed").alias("packed_a")), "a")
    return cut(two.select("a", "b", "packed_a", "packed_b").mapInArrow(lambda it: _compare(it, share), "a bigint, b bigint")), pairs.count()


class Leaf:
    """Up to LEAF members of one bucket in order of size."""

    def __init__(self, cls: list[int], comp: list[int], n: list[int], sigs: list[bytes], first: list[bytes] | None = None):
        self.cls, self.comp, self.n = (np.array(x, dtype=np.int64) for x in (cls, comp, n))
        self.first = None if not first or first[0] is None else np.stack([np.frombuffer(f, dtype=np.int64) for f in first])
        self.sigs = [np.frombuffer(s, dtype=np.uint64) for s in sigs]

        self.width = np.array([len(s) for s in self.sigs])
        self.folded: dict[int, np.ndarray] = {}
        self.best, self.partner = np.zeros(len(cls)), np.zeros(len(cls), dtype=np.int64)

    def at(self, n_words: int) -> np.ndarray:
        """Bitmaps folded to ``n_words``; of members whose own are shorter, repeated ones (which are not used)."""
        if n_words not in self.folded:
            self.folded[n_words] = np.stack([fold(s, n_words) if len(s) >= n_words else np.tile(s, n_words // len(s)) for s in self.sigs])
        return self.folded[n_words]

    def prefer(self, at: np.ndarray, bound: np.ndarray, partner: np.ndarray) -> None:
        """Keep each member's partner of the best bound."""
        order = np.argsort(bound, kind="stable")
        best, who = np.zeros(len(self.cls)), np.zeros(len(self.cls), dtype=np.int64)
        best[at[order]], who[at[order]] = bound[order], partner[order]
        better = best > self.best
        self.best[better], self.partner[better] = best[better], who[better]


def possible_links(x: Leaf, y: Leaf, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i in x, j in y) of members of different components whose sizes and bitmaps allow a link, and the largest
    likeness they allow."""
    i, j = np.nonzero((x.comp[:, None] != y.comp[None, :]) & (needed(x.n[:, None], y.n[None, :], share) <= np.minimum(x.n[:, None], y.n[None, :])))
    if x is y:
        i, j = i[i < j], j[i < j]
    width = np.minimum(x.width[i], y.width[j])
    most = np.zeros(len(i), dtype=np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        p, q = i[at], j[at]
        a, b = x.at(w)[p], y.at(w)[q]
        most[at] = np.minimum(x.n[p] - np.bitwise_count(a & ~b).sum(axis=1), y.n[q] - np.bitwise_count(b & ~a).sum(axis=1))
    ok = most >= needed(x.n[i], y.n[j], share)
    i, j, most = i[ok], j[ok], most[ok]
    return i, j, most / (x.n[i] + y.n[j] - most)


def meet_first(x: np.ndarray, y: np.ndarray, token: int) -> np.ndarray:
    """Whether ``token`` is the first bucket that each row of x has in common with that of y, as far as their first buckets tell.

    Rows are the ``FIRST`` smallest buckets of a class. Where two such lists have any bucket in common, they have the
    smallest one that the classes share, so a pair is put forward there and nowhere else; else in each bucket.
    """
    both = np.full(len(x), NONE)
    for k in range(FIRST):
        shared = (x[:, k, None] == y).any(axis=1) & (x[:, k] != NONE)
        both = np.where(shared, np.minimum(both, x[:, k]), both)
    return (both == NONE) | (both == token)


def leaf_pairs(x: Leaf, y: Leaf, share: tuple[int, int], token: int | None = None) -> np.ndarray:
    """Possible links as rows (class, class), smaller first; given the bucket, those whose first common one it is."""
    i, j, _ = possible_links(x, y, share)
    if token is not None and x.first is not None:
        here = meet_first(x.first[i], y.first[j], token)
        i, j = i[here], j[here]
    p, q = x.cls[i], y.cls[j]
    return np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1)


class Nodes:
    """Nodes of one level: the OR of bitmaps, ranges of size and component, and the most members' shingles that share bits."""

    def __init__(self, bits, low, high, spare, comp_low, comp_high):
        self.bits, self.low, self.high, self.spare, self.comp_low, self.comp_high = bits, low, high, spare, comp_low, comp_high

    @staticmethod
    def of(leaf: Leaf) -> tuple:
        n_words = min(NODE_BITS // 64, *(len(s) for s in leaf.sigs)) if leaf.sigs else 1
        own = leaf.at(n_words)
        spare = int((leaf.n - np.bitwise_count(own).sum(axis=1)).max())
        bits = np.tile(np.bitwise_or.reduce(own, axis=0), NODE_BITS // 64 // n_words)  # a shorter bitmap, repeated, bounds as well
        return bits, int(leaf.n.min()), int(leaf.n.max()), spare, int(leaf.comp.min()), int(leaf.comp.max()), n_words

    def parents(self) -> Nodes:
        at = np.arange(0, len(self.low), FAN_OUT)
        return Nodes(np.bitwise_or.reduceat(self.bits, at, axis=0), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.maximum.reduceat(self.spare, at),
                     np.minimum.reduceat(self.comp_low, at), np.maximum.reduceat(self.comp_high, at))

    def possible(self, i: np.ndarray, j: np.ndarray, share: tuple[int, int]) -> np.ndarray:
        """Whether some member under i and some under j may be a link that is not known yet."""
        low, other = np.minimum(self.low[i], self.low[j]), np.maximum(self.low[i], self.low[j])
        high = np.minimum(self.high[i], self.high[j])
        most = np.minimum(np.bitwise_count(self.bits[i] & self.bits[j]).sum(axis=1) + np.minimum(self.spare[i], self.spare[j]), high)
        one = (self.comp_low[i] == self.comp_high[i]) & (self.comp_low[j] == self.comp_high[j]) & (self.comp_low[i] == self.comp_low[j])
        return (most >= needed(low, other, share)) & ~one


def traverse(leaves: Nodes, share: tuple[int, int], block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves more than ``NEAR`` apart that stay, by a dual traversal from the root; in blocks of bounded size."""
    levels = [leaves]
    while len(levels[-1].low) > FAN_OUT:
        levels.append(levels[-1].parents())
    top = len(levels[-1].low)
    i, j = np.triu_indices(top)
    stack = [(len(levels) - 1, i, j)]
    while stack:
        depth, i, j = stack.pop()
        if len(i) > block:
            stack += [(depth, i[:block], j[:block]), (depth, i[block:], j[block:])]
            continue
        ok = levels[depth].possible(i, j, share)
        i, j = i[ok], j[ok]
        if depth == 0:
            yield i[j - i > NEAR], j[j - i > NEAR]
            continue
        size = len(levels[depth - 1].low)
        steps = np.arange(FAN_OUT)
        ci = (i[:, None, None] * FAN_OUT + steps[None, :, None] + 0 * steps[None, None, :]).ravel()
        cj = (j[:, None, None] * FAN_OUT + steps[None, None, :] + 0 * steps[None, :, None]).ravel()
        fine = (ci < size) & (cj < size) & (ci <= cj)
        stack.append((depth - 1, ci[fine], cj[fine]))


_LEAF_ROWS = "kind int, token bigint, leaf int, a bigint, b bigint, node binary, members binary"
_LEAF_SCHEMA = pa.schema([("kind", pa.int32()), ("token", pa.int64()), ("leaf", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("node", pa.binary()), ("members", pa.binary())])


class _Bucket:
    """The leaves of one bucket so far: the last ``NEAR`` as they are, the first ``NEAR`` as rows until there are more."""

    def __init__(self, token: int):
        self.token, self.number, self.recent, self.first = token, 0, deque(maxlen=NEAR), []
        self.possible, self.written = False, False  # whether any link is possible, and whether a row says so


def _nodes(parts: list[tuple]) -> Nodes:
    cols = [np.array([p[k] for p in parts]) for k in range(7)]
    n_words = int(cols[6].min())
    bits = np.stack([fold(b[: int(w)], n_words) for b, w in zip(cols[0], cols[6], strict=True)])
    # folding further makes members' shingles share more bits; at most all of them
    spare = np.where(cols[6] > n_words, cols[2], cols[3])
    return Nodes(bits, cols[1], cols[2], spare, cols[4], cols[5])


def _leaves(batches: Iterator[pa.RecordBatch], share: tuple[int, int], full: bool) -> Iterator[pa.RecordBatch]:
    """From members sorted by (token, n, cls): pairs inside leaves and between near ones (kind 0, each pair about once a
    task), and the leaves of buckets of more than ``NEAR`` (kind 1). Not ``full``: only each member's best pair, and a row
    (kind 2) for a bucket all of whose best pairs other buckets of the task have put forward: it may hold more links."""
    held: list[list] = [[], [], [], [], []]
    bucket: _Bucket | None = None
    rows: list[tuple] = []
    seen: set[tuple[int, int]] = set()

    def emit(a: int, b: int) -> None:
        pair = (min(a, b), max(a, b))
        bucket.possible = True
        if pair not in seen:
            bucket.written = True
            seen.add(pair)
            rows.append((0, bucket.token, None, *pair, None, None))
            if len(seen) > 200_000:
                seen.clear()

    def pairs(x: Leaf, y: Leaf) -> None:
        if full:
            for a, b in leaf_pairs(x, y, share, bucket.token).tolist():
                emit(a, b)
        else:
            i, j, bound = possible_links(x, y, share)
            x.prefer(i, bound, y.cls[j])
            y.prefer(j, bound, x.cls[i])

    def retire(leaf: Leaf) -> None:
        for a, b, bound in zip(leaf.cls.tolist(), leaf.partner.tolist(), leaf.best.tolist(), strict=True):
            if bound > 0:
                emit(a, b)

    def flush(last: bool) -> None:
        if held[0]:
            leaf = Leaf(*held)
            pairs(leaf, leaf)
            if not (last and bucket.number == 0):
                node = Nodes.of(leaf)
                for other, before in bucket.recent:
                    if _nodes([before, node]).possible(np.array([0]), np.array([1]), share)[0]:
                        pairs(other, leaf)
                if len(bucket.recent) == NEAR and NEAR:
                    retire(bucket.recent[0][0])
                bucket.recent.append((leaf, node))
                row = (1, bucket.token, bucket.number, None, None, pickle.dumps(node), pickle.dumps([list(x) for x in held]))
                if bucket.number < NEAR:
                    bucket.first.append(row)
                else:
                    rows.extend([*bucket.first, row])
                    bucket.first = []
            else:
                retire(leaf)
            bucket.number += 1
            for x in held:
                x.clear()
        if last and bucket is not None:
            for leaf, _ in bucket.recent:
                retire(leaf)
            if not full and bucket.possible and not bucket.written:
                rows.append((2, bucket.token, *[None] * 5))

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LEAF_SCHEMA, strict=True)], schema=_LEAF_SCHEMA)
        rows.clear()
        return batch

    for batch in batches:
        first = batch.column("first").to_pylist() if "first" in batch.schema.names else [None] * batch.num_rows
        for t, *member in zip(*(batch.column(c).to_pylist() for c in ("token", "cls", "comp", "n", "sig")), first, strict=True):
            if bucket is None or t != bucket.token:
                flush(True)
                bucket = _Bucket(t)
            elif len(held[0]) == LEAF:
                flush(False)
            for x, v in zip(held, member, strict=True):
                x.append(v)
            if len(rows) >= 5_000:
                yield out()
    flush(True)
    if rows:
        yield out()


def _leaf_links(key: tuple, group: pa.Table, share: tuple[int, int]) -> pa.Table:
    """Dual traversal over the leaves of one bucket; a leaf here is one row of fixed width."""
    order = np.argsort(group.column("leaf").to_numpy())
    nodes = _nodes([pickle.loads(group.column("node")[int(i)].as_py()) for i in order])
    found = list(traverse(nodes, share))
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))
    return pa.table({"token": pa.array([key[0].as_py()] * len(i), pa.int64()), "x": pa.array(i, pa.int32()), "y": pa.array(j, pa.int32())})


def _between(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t, x, y in zip(*(batch.column(c) for c in ("token", "mx", "my")), strict=True):
            pairs = leaf_pairs(Leaf(*pickle.loads(x.as_py())), Leaf(*pickle.loads(y.as_py())), share, t.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def tree_pairs(members: DataFrame, share: tuple[int, int], full: bool) -> DataFrame:
    """Pairs (a, b) of classes that signature trees over the buckets of ``members`` (token, cls, comp, n, sig) leave.

    Not ``full``: only the best pair of each class, among near leaves.
    """
    rows = cut(members.repartition("token").sortWithinPartitions("token", "n", "cls").mapInArrow(lambda it: _leaves(it, share, full), _LEAF_ROWS))
    inside = rows.where("kind = 0").select("a", "b").distinct()
    if not full:
        return inside
    leaves = rows.where("kind = 1")
    upper = leaves.select("token", "leaf", "node").groupBy("token").applyInArrow(lambda key, group: _leaf_links(key, group, share), "token bigint, x int, y int")
    near = upper.join(leaves.select("token", F.col("leaf").alias("x"), F.col("members").alias("mx")), ["token", "x"])
    near = near.join(leaves.select("token", F.col("leaf").alias("y"), F.col("members").alias("my")), ["token", "y"])
    across = near.select("token", "mx", "my").mapInArrow(lambda it: _between(it, share), "a bigint, b bigint")
    return inside.unionByName(across).distinct()


def _levels(texts: DataFrame) -> np.ndarray:
    """How frequent the shingles of each bin of the sketch are, as a small number; 2**SKETCH_LOG2 bytes."""
    counted = texts.where(F.pmod(F.xxhash64("text"), F.lit(SKETCH_SHARE)) == 0).select("text")
    bins = counted.mapInArrow(_sketch_bins, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    bins = cut(bins)
    mean = (bins.agg(F.sum("n")).first()[0] or 0) / (1 << SKETCH_LOG2)
    level = np.zeros(1 << SKETCH_LOG2, dtype=np.uint8)
    for r in bins.where(F.col("n") > mean + 6 * mean**0.5 + 6).collect():  # the few bins far above chance
        level[r.bin] = min(60, int(np.log2(r.n - mean)))
    return level


def jaccard_components(documents: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, text_key, n_shingles, comp, component_id) for each distinct (doc_id, text) of ``documents``.

    ``text_key`` is the text's ``xxhash64``; ``comp`` names the component (null: no shingles), ``component_id`` is its smallest id.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    kind = dict(documents.dtypes)["doc_id"]
    narrow = cut(texts.mapInArrow(_sets, f"doc_id {kind}, text_key bigint, cls bigint, n bigint, sig binary"))
    classes = cut(narrow.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("lowest"), F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    levels = spark.sparkContext.broadcast(_levels(texts))
    tokens = texts.mapInArrow(lambda it: _prefixes(it, levels, share), "token bigint, cls bigint, n bigint")
    buckets = cut(_buckets(tokens, share))
    signed = classes.select("cls", "sig")
    members = lambda rows: rows.join(signed, "cls").select("token", "cls", "comp", "n", "sig")
    size = F.count("*").over(Window.partitionBy("token"))
    left, links, label, turn, paying = buckets.withColumns({"comp": F.col("cls"), "size": size}), None, None, 0, True
    while paying:
        order = {0: F.col("size").cast("bigint") * -1, 1: F.col("size").cast("bigint")}.get(turn, F.xxhash64("token", F.lit(turn)))
        picked = left.groupBy("cls").agg(F.min(F.struct(order.alias("o"), "token", "comp", "n")).alias("p")).select("p.token", "cls", "p.comp", "p.n")
        found, tried = compare(tree_pairs(members(picked), share, False), texts, classes, share)
        links = found if links is None else links.unionByName(found)
        label = components(links)
        left = _mixed(left, label)
        turn, paying = turn + 1, tried > 0 and 4 * found.count() >= tried
    every = members(left).join(left.groupBy("cls").agg(F.sort_array(F.collect_list("token")).alias("first")).mapInArrow(_first_buckets, "cls bigint, first binary"), "cls")
    label = components(links.unionByName(compare(tree_pairs(every, share, True), texts, classes, share)[0]))

    own = classes.join(label.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "lowest", F.coalesce("comp", "cls").alias("comp"))
    lowest = own.groupBy("comp").agg(F.min("lowest").alias("component_id"))
    of = own.join(lowest, "comp").select("cls", "comp", "component_id")
    sets = narrow.select("doc_id", "text_key", "cls", F.col("n").alias("n_shingles")).distinct()
    some = sets.where("n_shingles > 0").join(of, "cls").select("doc_id", "text_key", "n_shingles", "comp", "component_id")
    none = sets.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("bigint").alias("comp"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def _first_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class's sorted buckets the first ``FIRST``, in a row of fixed width."""
    for batch in batches:
        lists = [np.asarray(t.values)[:FIRST] for t in batch.column("first")]
        packed = [np.concatenate((x, np.full(FIRST - len(x), NONE))).astype("<i8").tobytes() for x in lists]
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(packed, pa.binary())], names=["cls", "first"])


def _buckets(tokens: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(token, cls, n) of the buckets of two classes or more whose sizes may match; ``token`` names a bucket from here on."""
    bucket = Window.partitionBy("token")
    members_hash = F.sum(F.shiftrightunsigned(F.xxhash64("cls"), 24))  # 40 bits each, so that sums stay in range
    held = tokens.withColumn("low", F.min("cls").over(bucket)).withColumn("high", F.max("cls").over(bucket)).withColumn("sum", members_hash.over(bucket))
    named = held.where("low < high").select(F.xxhash64("low", "high", "sum").alias("bucket"), "cls", "n").distinct()
    by_size = Window.partitionBy("bucket").orderBy("n", "cls")
    apart = F.coalesce(F.lag("n").over(by_size) * share[1] < F.col("n") * share[0], F.lit(True))
    runs = named.withColumn("run", F.sum(apart.cast("int")).over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sized = runs.withColumn("size", F.count("*").over(Window.partitionBy("bucket", "run")))
    return sized.where("size > 1").select(F.xxhash64("bucket", "run").alias("token"), "cls", "n")


def _mixed(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """Rows (token, cls, n, comp, size) of the buckets that hold several components."""
    bucket = Window.partitionBy("token")
    known = buckets.drop("comp").join(label.withColumnRenamed("node", "cls"), "cls", "left").select("token", "cls", "n", "size", F.coalesce("comp", "cls").alias("comp"))
    return cut(known.withColumn("low", F.min("comp").over(bucket)).withColumn("high", F.max("comp").over(bucket)).where("low < high").drop("low", "high"))


def keep_one(documents: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """One row of each component, its smallest (doc_id, text); texts without shingles stay. All columns as they were.

    Rows that repeat both id and text are one document, of which one row stays.
    """
    found = cut(jaccard_components(documents, share))
    heads = found.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("head"))
    losers = found.join(heads, "comp").where(~(F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.text_key") == F.col("text_key"))))
    id_, key, rows = free_names(documents.columns, "_id", "_key", "_rows")
    lost = losers.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key))
    kept = documents.join(lost, same, "left_anti")
    twice = documents.groupBy("doc_id", F.xxhash64("text").alias(key)).agg(F.count("*").alias(rows)).where(F.col(rows) > 1).select(F.col("doc_id").alias(id_), key)
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
