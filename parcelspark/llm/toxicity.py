"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are byte 5-grams of the lower-cased text (all but letters is one blank), hashed to a fixed number of bins; those
toxic examples have significantly more often, by chi-squared, are kept, all of them. Their document frequencies are
counted over all documents. Labelled examples, at most ``per_label`` of each label in
order of a hash of the id, form the index: postings by block of ``BLOCK`` examples, and the largest weight of each term
in each block. A text's blocks are put in order of the largest cosine they can hold; the first few are scored, then all
others that can hold more than the k-th best so far; so the k nearest are exact. Their labels vote with weights that fall with distance; a logistic curve,
fit on the examples' own votes without themselves and weighted back to the labels' shares, makes the vote a probability.

Every text is read whole. Labels are only read from rows where ``learn`` holds; language, source and id are not used.
Defined cases: null and empty texts, and texts without a kept term, have no neighbours: they get the share of toxic
examples among examples without a kept term. Rows of null label are not learned from; an id labelled twice is toxic if
either says so; without examples of both labels every score is the share of toxic ones (0 if there are none). Repeated
rows give repeated results. Extra columns are kept by callers' own select.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm.textkit import LOWER, chunks, flat, mix

GRAM = 5
BINS_LOG2 = 20
LEAST_CHI = 15.0  # about one chance in ten thousand for a term that tells nothing
PER_LABEL = 2000
BLOCK = 64
FIRST_BLOCKS = 4
NEIGHBOURS = 15
_FOLDED = LOWER.copy()
for _b in range(128):
    if not chr(_b).isalpha():
        _FOLDED[_b] = 32


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bin of every 5-gram, and the text it is in. A blank stands before and behind each text."""
    raw, offsets = flat(column)
    n = len(column)
    data = np.full(len(raw) + 2 * n, 32, dtype=np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets) + 2)
    at = np.arange(len(raw)) + 2 * np.repeat(np.arange(n), np.diff(offsets)) + 1
    data[at] = _FOLDED[raw]
    if len(data) < GRAM:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    m = len(data) - GRAM + 1
    gram = np.zeros(m, dtype=np.uint64)
    for j in range(GRAM):
        gram = (gram << np.uint64(8)) | data[j : j + m]
    same = owner[:m] == owner[GRAM - 1 :]
    return (mix(gram[same]) >> np.uint64(64 - BINS_LOG2)).astype(np.int64), owner[:m][same]


def term_counts(column: pa.Array, term_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count), sorted; ``term_of`` maps bins to kept terms (-1: not kept), None keeps bins."""
    bins, owner = grams(column)
    terms = bins if term_of is None else term_of[bins].astype(np.int64)
    keep = terms >= 0
    key, n = np.unique((owner[keep] << 32) | terms[keep], return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, n


def _label_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text"):
            labels = batch.column("toxic").to_numpy()
            text, bins, _ = term_counts(batch.column("text"))
            key, n = np.unique((bins << 1) | labels[text], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array((key & 1).astype(np.int32)), pa.array(n)], names=["bin", "toxic", "n"])


def _examples(batches: Iterator[pa.RecordBatch], term_of) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text"):
            text, term, n = term_counts(batch.column("text"), term_of.value)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            parts = [(term[a:b].astype(np.int32), n[a:b].astype(np.int32)) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array([p[0] for p in parts], pa.list_(pa.int32())), pa.array([p[1] for p in parts], pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms", "counts"]
            )


def _frequencies(batches: Iterator[pa.RecordBatch], term_of) -> Iterator[pa.RecordBatch]:
    """How many texts of a task have each kept term, and, as term -1, how many texts there are."""
    total, n = np.zeros(int(term_of.value.max(initial=-1)) + 1, dtype=np.int64), 0
    for whole in batches:
        n += whole.num_rows
        for batch in chunks(whole, "text"):
            total += np.bincount(term_counts(batch.column("text"), term_of.value)[1], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], names=["term", "n"])


class Index:
    """Block-max inverted index of the examples, with the fitted curve."""

    def __init__(self, term_of: np.ndarray, ids: list, toxic: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], share: float, frequencies: tuple[np.ndarray, int] | None = None):
        self.term_of, self.ids, self.toxic = term_of, ids, toxic
        n_terms = int(term_of.max()) + 1 if len(term_of) else 0
        df, n_texts = frequencies or (np.bincount(np.concatenate([*terms, np.zeros(0, dtype=np.int64)]).astype(np.int64), minlength=n_terms), len(ids))
        self.idf = np.log((1 + n_texts) / (1 + df)) + 1
        vectors = [self.vector(t, c) for t, c in zip(terms, counts, strict=True)]
        # near examples share a block: order by label, then by strongest term, so that a block's largest weights say something
        strongest = [int(t[np.argmax(v)]) if len(t) else -1 for t, v in zip(terms, vectors, strict=True)]
        order = sorted(range(len(ids)), key=lambda i: (toxic[i], strongest[i], i))
        self.ids, self.toxic = [ids[i] for i in order], toxic[order]
        self.n_blocks = -(-len(order) // BLOCK)
        self.most = np.zeros((n_terms, self.n_blocks), dtype=np.float32)
        parts, self.begin = [], np.zeros((self.n_blocks, n_terms + 1), dtype=np.int32)  # where a block's postings of a term begin
        for b in range(self.n_blocks):
            rows = order[b * BLOCK : (b + 1) * BLOCK]
            t = np.concatenate([terms[i] for i in rows]).astype(np.int64)
            d = np.repeat(np.arange(len(rows)), [len(terms[i]) for i in rows])
            w = np.concatenate([vectors[i] for i in rows])
            by = np.lexsort((d, t))
            t, d, w = t[by], d[by], w[by]
            np.maximum.at(self.most[:, b], t, w.astype(np.float32) * np.float32(1 + 1e-6))
            self.begin[b] = np.searchsorted(t, np.arange(n_terms + 1)) + sum(len(p[0]) for p in parts)
            parts.append((d + b * BLOCK, w))
        self.places, self.weights = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in (0, 1))
        self.none = share
        self.curve = (0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
        self._fit([terms[i] for i in order], [vectors[i] for i in order], share)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, terms: np.ndarray, vector: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples (cosine above 0; ties: the lower place), and only theirs."""
        bound = vector @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        at, value = self._scored(order[:FIRST_BLOCKS], terms, vector, without)
        best = np.lexsort((at, -value))[:k]
        at, value = at[best], value[best]
        rest = order[FIRST_BLOCKS:]
        if len(at) == k:
            rest = rest[bound[rest] >= value[-1]]
        if len(rest):
            more_at, more = self._scored(rest, terms, vector, without)
            at, value = np.concatenate((at, more_at)), np.concatenate((value, more))
            best = np.lexsort((at, -value))[:k]
            at, value = at[best], value[best]
        return at, value

    def _scored(self, blocks: np.ndarray, terms: np.ndarray, vector: np.ndarray, without: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines, above 0, of the examples of some blocks."""
        start = self.begin[blocks[:, None], terms[None, :]].ravel()
        size = self.begin[blocks[:, None], terms[None, :] + 1].ravel() - start
        take = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        weight = np.repeat(np.tile(vector, len(blocks)), size)
        cosine = np.bincount(self.places[take], weights=self.weights[take] * weight, minlength=1)
        if 0 <= without < len(cosine):
            cosine[without] = 0
        at = np.flatnonzero(cosine > 0)
        return at, cosine[at]

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        weight = 1 / (1.05 - np.minimum(cosine, 1.0))
        return float((weight * self.toxic[at]).sum() / weight.sum())

    def _fit(self, terms: list[np.ndarray], vectors: list[np.ndarray], share: float) -> None:
        """Logistic curve over votes, by Newton steps; examples count by their label's share among all labelled rows."""
        votes, labels, blank = [], [], []
        for i, (t, v) in enumerate(zip(terms, vectors, strict=True)):
            at, cosine = self.nearest(t, v, without=i) if len(t) else ((), ())
            if len(at):
                votes.append(self.vote(at, cosine))
                labels.append(self.toxic[i])
            else:
                blank.append(self.toxic[i])
        n1 = max(1, int(self.toxic.sum()))
        n0 = max(1, len(self.toxic) - n1)
        weight_of = np.array([(1 - share) / n0, share / n1])
        if blank:
            w = weight_of[np.array(blank)]
            self.none = float((w * np.array(blank)).sum() / w.sum())
        else:
            self.none = 0.0 if votes else share
        if votes and 0 < share < 1:
            x, y = np.stack([np.array(votes), np.ones(len(votes))], axis=1), np.array(labels, dtype=float)
            w = weight_of[np.array(labels)] * len(votes)
            beta = np.array([4.0, -2.0])
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                slope = x.T @ (w * (y - p)) - 1e-2 * beta
                curve = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
                beta = np.clip(beta + np.linalg.solve(curve, slope), -60, 60)
            self.curve = (float(beta[0]), float(beta[1]))

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if not len(terms) or not len(self.ids):
            return self.none, np.zeros(0, dtype=np.int64), np.zeros(0)
        at, cosine = self.nearest(terms, self.vector(terms, counts))
        if not len(at):
            return self.none, at, cosine
        return float(1 / (1 + np.exp(-(self.curve[0] * self.vote(at, cosine) + self.curve[1])))), at, cosine


def fit(documents: DataFrame, labels: DataFrame, learn: Column, per_label: int = PER_LABEL) -> Index:
    """Index of at most ``per_label`` examples of each label; examples and kept terms, of 2**BINS_LOG2 bins, are all that reaches the driver."""
    spark = documents.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(learn)
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    hashed = known.withColumn("o", F.xxhash64(F.col("doc_id").cast("string"))).withColumn("salt", F.pmod("o", F.lit(64)))
    first = hashed.withColumn("n", F.row_number().over(Window.partitionBy("toxic", "salt").orderBy("o", "doc_id"))).where(F.col("n") <= per_label)
    pick = first.withColumn("n", F.row_number().over(Window.partitionBy("toxic").orderBy("o", "doc_id"))).where(F.col("n") <= per_label).select("doc_id", "toxic")
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(pick), "doc_id")  # 2 * per_label ids

    n = {r.toxic: r.n for r in pick.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    bins = texts.select("toxic", "text").mapInArrow(_label_bins, "bin bigint, toxic int, n bigint").groupBy("bin").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    gap = F.col("a") * n0 - F.col("b") * n1
    seen = F.col("a") + F.col("b")
    chi = gap.cast("double") * gap / (seen * F.greatest(F.lit(1), F.lit(n1 + n0) - seen))
    telling = (seen >= 5) & (gap > 0) & (chi * F.lit(n1 + n0) / max(1, n1 * n0) >= LEAST_CHI)
    kept = sorted(r.bin for r in bins.where(telling).select("bin").collect())
    term_of = np.full(1 << BINS_LOG2, -1, dtype=np.int32)
    term_of[kept] = np.arange(len(kept))
    shared = spark.sparkContext.broadcast(term_of)
    kind = dict(documents.dtypes)["doc_id"]
    rows = texts.select("doc_id", "toxic", "text").mapInArrow(lambda it: _examples(it, shared), f"doc_id {kind}, toxic int, terms array<int>, counts array<int>").toArrow().to_pylist()
    counted = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _frequencies(it, shared), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(kept) + 1, dtype=np.int64)  # the last: all texts
    for r in counted:
        df[r.term] = r.n
    rows.sort(key=lambda r: (str(r["doc_id"]), r["terms"], r["counts"]))  # whatever order tasks end in
    as_array = lambda x: np.array(x, dtype=np.int64)
    return Index(term_of, [r["doc_id"] for r in rows], as_array([r["toxic"] for r in rows]), [as_array(r["terms"]) for r in rows], [as_array(r["counts"]) for r in rows], share, (df[:-1], int(df[-1])))


def _scored(batches: Iterator[pa.RecordBatch], shared, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    index = shared.value
    evidence_type = pa.list_(pa.struct([("doc_id", kind), ("cosine", pa.float64()), ("toxic", pa.int32())]))
    for whole in batches:
        for batch in chunks(whole, "text"):
            text, term, n = term_counts(batch.column("text"), index.term_of)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            scores, evidence = [], []
            for a, b in zip(cut, cut[1:], strict=False):
                s, at, cosine = index.score(term[a:b], n[a:b])
                scores.append(s)
                evidence.append([{"doc_id": index.ids[i], "cosine": float(c), "toxic": int(index.toxic[i])} for i, c in zip(at[:3].tolist(), cosine[:3].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(evidence, evidence_type)], names=[*batch.schema.names, "score", "evidence"])


def score(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` (doc_id, text and any others) with score and evidence: the three nearest examples, with cosine and label."""
    shared = rows.sparkSession.sparkContext.broadcast(index)
    kept = rows.drop("score", "evidence")
    kind = dict(kept.dtypes)["doc_id"]
    arrow = pa.int64() if kind == "bigint" else pa.string() if kind == "string" else pa.int32()
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
    return kept.mapInArrow(lambda it: _scored(it, shared, arrow), f"{schema}, score double, evidence array<struct<doc_id:{kind},cosine:double,toxic:int>>")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
