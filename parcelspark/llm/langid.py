"""Language identification in two steps: the family, then the languages of that family one against one.

Features are byte n-grams (1 to 4) of the lower-cased text, hashed to a fixed number of bins, as square roots of their
counts scaled to length one. Families are told apart by one linear support vector machine each (one against the rest);
inside a family every two languages have a machine of their own, and votes, then margins, decide. All machines are fit
by dual coordinate descent on at most ``per_language`` labelled rows a language, taken in order of a hash of the id, so
the fit does not grow with the table. Every text is read whole.

Defined cases: text that is null or has no letter is ``und`` with score 0. Rows of null lang are not learned from; a
language without a known family is a family of its own; with one language learned all texts are that language; with
none all are ``und``. Repeated rows give repeated results. Extra columns are kept by ``predict`` callers' own select.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm.textkit import LOWER, chunks, flat, mix

BINS_LOG2 = 12
PER_LANGUAGE = 800
ROWS = 256

# fixed values: families of ISO 639-1 codes
FAMILIES = {
    "Germanic": "en de nl af sv da no nb nn is lb fy",
    "Romance": "fr es it pt ca gl ro oc",
    "Slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "Baltic": "lt lv",
    "Uralic": "fi et hu",
    "Celtic": "ga gd cy br",
    "Indic": "hi bn ur mr gu pa ne",
    "Semitic": "ar he mt am",
    "Turkic": "tr az kk ky uz",
    "Sinitic": "zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# digits, punctuation and blanks say nothing: they all are one blank
_FOLDED = LOWER.copy()
for _b in range(128):
    if not chr(_b).isalpha():
        _FOLDED[_b] = 32


def features(column: pa.Array) -> np.ndarray:
    """One row of scaled n-gram counts for each text."""
    raw, offsets = flat(column)
    data = _FOLDED[raw].astype(np.uint64)
    owner = np.repeat(np.arange(len(column), dtype=np.int64), np.diff(offsets))
    counts = np.zeros(len(column) << BINS_LOG2, dtype=np.float32)
    gram = np.zeros(len(data), dtype=np.uint64)
    for k in range(1, 5):
        n = len(data) - k + 1
        if n <= 0:
            break
        gram = (gram[:n] << np.uint64(8)) | data[k - 1 :]
        same = owner[:n] == owner[k - 1 :]
        bins = (mix(gram + np.uint64(k << 40)) >> np.uint64(64 - BINS_LOG2)).astype(np.int64)
        counts += np.bincount(((owner[:n] << BINS_LOG2) + bins)[same], minlength=len(counts))
    x = np.sqrt(counts.reshape(len(column), -1))
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(length, 1e-9)


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 8.0, rounds: int = 12) -> np.ndarray:
    """Linear support vector machine (hinge loss) by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w, alpha, square = np.zeros(x.shape[1], dtype=np.float32), np.zeros(len(x)), (x * x).sum(axis=1)
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * float(w @ x[i]) - 1) / square[i], 0.0), cost)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


class Machines:
    """Fitted machines and the decision they take together."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        own = np.array(langs)
        family = {code: FAMILY_OF.get(code, code) for code in self.langs}
        self.families = sorted(set(family.values()))
        of = np.array([family[c] for c in langs])
        self.members = {f: [c for c in self.langs if family[c] == f] for f in self.families}
        weights = [fit_machine(x, np.where(of == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = [(a, b) for f in self.families for a, b in combinations(self.members[f], 2)]
        for a, b in self.pairs:
            rows = (own == a) | (own == b)
            weights.append(fit_machine(x[rows], np.where(own[rows] == a, 1.0, -1.0)))
        self.w = np.stack(weights).T if weights else np.zeros((x.shape[1] + 1, 0), dtype=np.float32)

    def decide(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        sure = lambda m: 1 / (1 + np.exp(-3 * m))
        margin = x @ self.w[:-1] + self.w[-1]
        n_families = len(self.families) if len(self.families) > 1 else 0
        at = margin[:, :n_families].argmax(axis=1) if n_families else np.zeros(len(x), dtype=int)
        score = sure(margin[np.arange(len(x)), at]) if n_families else np.ones(len(x))
        votes = np.zeros((len(x), len(self.langs)))
        number = {c: i for i, c in enumerate(self.langs)}
        for k, (a, b) in enumerate(self.pairs, n_families):
            m = margin[:, k]
            votes[:, number[a]] += (m >= 0) + 1e-3 * np.tanh(m)
            votes[:, number[b]] += (m < 0) - 1e-3 * np.tanh(m)
        out = []
        for i, f in enumerate(at):
            members = self.members[self.families[f]]
            best = max(members, key=lambda c, i=i: votes[i, number[c]])
            out.append(best)
            for k, (a, b) in enumerate(self.pairs, n_families):
                if best in (a, b):
                    score[i] *= sure(abs(margin[i, k]) if (margin[i, k] >= 0) == (best == a) else -abs(margin[i, k]))
        return out, score


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text", rows=ROWS):
            x = features(batch.column("text"))
            rows = [np.flatnonzero(r).astype(np.int32) for r in x]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(x, rows, strict=True)], pa.list_(pa.float32()))], names=["lang", "at", "value"])


def fit(documents: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Machines | None:
    """Machines learned from rows where ``learn`` holds; at most ``per_language`` rows a language reach the driver."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    kept = documents.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", order.alias("o"))
    # the cut by rank is made on narrow rows, inside sub-groups first
    narrow = kept.select("doc_id", "lang", "o").withColumn("salt", F.pmod("o", F.lit(64)))
    first = narrow.withColumn("n", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("o", "doc_id"))).where(F.col("n") <= per_language)
    pick = first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id"))).where(F.col("n") <= per_language)
    last = {r.lang: (r.o, r.n) for r in pick.groupBy("lang").agg(F.max("o").alias("o"), F.count("*").alias("n")).collect()}
    if not last:
        return None
    limit = F.create_map(*[F.lit(v) for c, (o, _) in sorted(last.items()) for v in (c, o)])
    rows = kept.where(F.col("o") <= limit[F.col("lang")]).select("lang", F.col("text").cast("string").alias("text"), "o").mapInArrow(_learned, "lang string, at array<int>, value array<float>").toArrow()
    x = np.zeros((rows.num_rows, 1 << BINS_LOG2), dtype=np.float32)
    for i, (at, value) in enumerate(zip(rows.column("at"), rows.column("value"), strict=True)):
        x[i, at.values.to_numpy()] = value.values.to_numpy()
    langs = rows.column("lang").to_pylist()
    order_by = sorted(range(len(langs)), key=lambda i: (langs[i], x[i].tobytes()))  # whatever order tasks end in
    return Machines(x[order_by], [langs[i] for i in order_by])


def _predicted(batches: Iterator[pa.RecordBatch], machines) -> Iterator[pa.RecordBatch]:
    fitted = machines.value
    for whole in batches:
        for batch in chunks(whole, "text", rows=ROWS):
            texts = batch.column("text")
            if fitted is None:
                langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            else:
                langs, scores = fitted.decide(features(texts))
            for i, t in enumerate(texts.to_pylist()):
                if not has_letter(t):
                    langs[i], scores[i] = "und", 0.0
            keep = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(langs), pa.array(np.clip(scores, 0, 1).astype(np.float64))], names=[*batch.schema.names, "lang_pred", "score"])


def predict(rows: DataFrame, machines: Machines | None) -> DataFrame:
    """``rows`` (a ``text`` column and any others) with lang_pred and score, which replace columns of those names."""
    shared = rows.sparkSession.sparkContext.broadcast(machines)
    kept = rows.drop("lang_pred", "score")
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
    return kept.mapInArrow(lambda it: _predicted(it, shared), f"{schema}, lang_pred string, score double")


def held_out() -> Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
