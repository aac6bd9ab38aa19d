"""Secret scans: plain patterns, and a battery of randomness tests over strings that look encoded.

Patterns (``assign``, ``access``, ``hex``) are taken as they are. Other runs of 16 or more base64-like characters are
candidates (``random``), and so is each part of 16 or more that is left when a run is split at any of ``+/-_``, so a key
in a path or beside a dash is tested by itself too. Their encoding is inferred (the smallest alphabet that holds them,
the 26 letters for letters of one case; digits alone are numbers and not tested), and three statistics are taken over the alphabet: chi-squared
uniformity, runs above and below its middle, and serial correlation. Each is brought to a standard deviate with the
mean and variance that a random string of that length has; D is the sum of their squares (for chi-squared only the
excess). A random string has a small D whatever its length.

A string is held against the hypothesis that it is text. What D text has is worked out for each alphabet and class of
length by drawing strings from the corpus' own character pairs, counted over all texts. A candidate's p is the share of
them with as small a D. The draws end at one in some thousands, so where that share is within the rate, p has a second
and analytic bound: text gives a string's likelihood under the pairs, over that under a uniform source, a value of x or
less with chance x at most (Markov's inequality). Both are joined by a weighted Bonferroni bound, ``SPLIT`` of it for the
second, so p has no floor however many candidates there are. Benjamini-Hochberg bounds the false discoveries inside
every class of encoding and length.

Defined cases: null and empty texts have no spans. Repeated rows give repeated results. Extra columns are not read.
Spans are in code points. A random span that overlaps a pattern's, or lies in a longer random one, is not added. No pairs at all (an empty table): no
random spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.textkit import chunks, flat, free_names
from parcelspark.session import cut

# fixed values: the patterns, and the alphabets in order of their symbols
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
PARTS = tuple(re.compile(f"[A-Za-z0-9{joints}]{{16,}}") for joints in ("+/", "+", "/", "_-", "_", "-", ""))  # what one alphabet can hold
KINDS = ("assign", "access", "hex", "random")
_UP, _LOW, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UP + "234567",
    "base36": _DIGITS + _LOW,
    "BASE36": _DIGITS + _UP,
    "base62": _UP + _LOW + _DIGITS,
    "base64": _UP + _LOW + _DIGITS + "+/",
    "base64url": _UP + _LOW + _DIGITS + "-_",
    "lower": _LOW,
    "UPPER": _UP,
}
LENGTHS = (16, 20, 24, 32, 40, 48, 64, 96, 128)  # classes of length begin here
DRAWS = 4000
RATE = 0.01
SPLIT = 0.01  # share of the level that the likelihood ratio has; the rest is for the draws
TENTHS = 3000  # the finest step of p is 10 ** -(TENTHS / 10)

_SETS = {name: frozenset(a) for name, a in ALPHABETS.items()}
_INDEX = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}


def encoding(run: str) -> str | None:
    """Name of the smallest alphabet that holds the run; None for words, numbers and mixtures."""
    seen = set(run)
    if seen <= set(_DIGITS) or run.isalpha() and (run.islower() or run.isupper() or run.istitle()):
        return None
    return next((name for name, a in _SETS.items() if seen <= a), None)


def alphabet(run: str) -> str | None:
    """Name of the alphabet that a run is tested in: its encoding, or for letters only those of its case or cases."""
    if run.isalpha():
        return "lower" if run.islower() else "UPPER" if run.isupper() else "base62"
    return encoding(run)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Runs that fit an alphabet, and their parts that do; (start, end, alphabet), longer ones first at one start."""
    found = set()
    for m in RUN.finditer(text):
        found.add(m.span())
        if not m[0].isalnum():
            found.update(part.span() for parts in PARTS for part in parts.finditer(text, *m.span()))
    return [(a, b, name) for a, b in sorted(found, key=lambda s: (s[0], -s[1])) if (name := alphabet(text[a:b]))]


def length_class(n: int) -> int:
    return max(x for x in LENGTHS if x <= n)


def deviation(symbols: np.ndarray, size: int) -> np.ndarray:
    """D of each row of symbol numbers (all rows of one length)."""
    rows, n = symbols.shape
    counts = np.zeros((rows, size))
    np.add.at(counts, (np.arange(rows)[:, None], symbols), 1)
    chi = (counts**2).sum(axis=1) * size / n - n
    z_chi = np.maximum(0, (chi - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n))
    high = symbols >= size // 2
    share = (size - size // 2) / size
    turn = 2 * share * (1 - share)
    turns = (high[:, 1:] != high[:, :-1]).sum(axis=1)
    z_runs = (turns - (n - 1) * turn) / np.sqrt((n - 1) * turn * (1 - turn))
    centred = (symbols - (size - 1) / 2) / np.sqrt((size**2 - 1) / 12)
    z_serial = (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / np.sqrt(n - 1)
    return z_chi**2 + z_runs**2 + z_serial**2


def d_of(run: str, name: str) -> float:
    index = _INDEX[name]
    return float(deviation(np.array([[index[c] for c in run]]), len(index))[0])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def joint(spans: list[tuple]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts, ends = [], []
    for a, b, *_ in sorted(spans):
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def meets(stretches: tuple[list[int], list[int]], start: int, end: int) -> bool:
    i = bisect_left(stretches[0], end) - 1  # the last that begins before the end
    return i >= 0 and stretches[1][i] > start


def _scan(batches: Iterator[pa.RecordBatch], names: list[str], models) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("at", pa.int32()), ("kind", pa.string()), ("end", pa.int64())]))
    maybe = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.string()), ("d", pa.float64()), ("tail", pa.int32())]))
    for whole in batches:
        for batch in chunks(whole, "text"):
            bases, others = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                other, taken = [], joint(base)
                for start, end, name in candidates(text or ""):
                    if not meets(taken, start, end):
                        run = text[start:end]
                        other.append({"start": start, "end": end, "stratum": f"{name}:{length_class(len(run))}", "d": d_of(run, name), "tail": tail_of(run, name, models.value[name])})
                bases.append([{"start": a, "at": KINDS.index(k), "kind": k, "end": b} for a, b, k in base])
                others.append(other)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(bases, span), pa.array(others, maybe)], names=[*names, "base", "maybe"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring ASCII characters; blanks between words are passed over."""
    for whole in batches:
        total = np.zeros(1 << 14, dtype=np.int64)
        for batch in chunks(whole, "text"):
            data, _ = flat(batch.column("text"))
            data = data[data > 32].astype(np.int64)
            left, right = data[:-1], data[1:]
            ascii_ = (left < 128) & (right < 128)
            total += np.bincount((left[ascii_] << 7) + right[ascii_], minlength=1 << 14)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])


def pair_model(counts: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Chances of an alphabet's symbols at the start and after each symbol, from character pairs (128 x 128 counts)."""
    symbols = [ord(c) for c in ALPHABETS[name]]
    own = counts[np.ix_(symbols, symbols)] + 1e-3 * counts.sum() / counts.size**2 + 1e-9
    return own.sum(axis=1) / own.sum(), own / own.sum(axis=1, keepdims=True)


def tail_of(run: str, name: str, model: tuple[np.ndarray, np.ndarray]) -> int:
    """Tenths of a power of ten, rounded down, that the likelihood ratio's bound on p lies below 1 (0: it says nothing)."""
    begin, step = model
    at = np.array([_INDEX[name][c] for c in run])
    ratio = np.log10(begin[at[0]]) + np.log10(step[at[:-1], at[1:]]).sum() + len(at) * np.log10(len(begin))
    return int(np.clip(np.floor(-10 * (ratio - np.log10(SPLIT))), 0, TENTHS))


def text_deviations(counts: np.ndarray, name: str, length: int, draws: int = DRAWS) -> np.ndarray:
    """Sorted D of strings drawn from character pairs (128 x 128 counts), kept to an alphabet."""
    symbols = ALPHABETS[name]
    begin, step = pair_model(counts, name)
    begin, step = np.cumsum(begin), np.cumsum(step, axis=1)
    rng = np.random.default_rng(length * 31 + len(name))
    rows = np.zeros((draws, length), dtype=np.int64)
    rows[:, 0] = np.minimum(np.searchsorted(begin, rng.random(draws)), len(symbols) - 1)
    for i in range(1, length):
        rows[:, i] = np.minimum((step[rows[:, i - 1]] < rng.random(draws)[:, None]).sum(axis=1), len(symbols) - 1)
    return np.sort(deviation(rows, len(symbols)))


def p_of(rank: np.ndarray | int, draws: int = DRAWS) -> np.ndarray | float:
    """p of a rank among the draws, or, below 0, of so many tenths of a power of ten."""
    return np.where(rank < 0, 10.0 ** (np.minimum(rank, 0) / 10), np.minimum(1, (np.maximum(rank, 0) + 1) / (draws + 1) / (1 - SPLIT)))


def ranked(d: np.ndarray, tail: np.ndarray, null: np.ndarray, rate: float) -> np.ndarray:
    """The rank of each candidate among the draws, or minus its tail where that gives the smaller p."""
    rank = np.searchsorted(null, d, side="right")
    p = p_of(rank, len(null))
    return np.where((p <= rate) & (p_of(-tail, len(null)) < p) & (tail > 0), -tail, rank)


def largest_p(ranks: dict[int, int], rate: float = RATE, draws: int = DRAWS) -> float:
    """Benjamini-Hochberg: the largest p that is reported, from the number of candidates at each rank; 0: none is."""
    rank, n = np.array(list(ranks), dtype=np.int64), np.array(list(ranks.values()), dtype=np.int64)
    p = p_of(rank, draws)
    order = np.argsort(p, kind="stable")
    p, k = p[order], np.cumsum(n[order])
    ok = np.flatnonzero(p * k[-1] <= rate * k)
    return float(p[ok[-1]]) if len(ok) else 0.0


def d_limit(null: np.ndarray, p: float) -> float:
    """D below this has at most ``p`` by the draws; negative: none has."""
    rank = int(np.floor(p * (1 - SPLIT) * (len(null) + 1) * (1 + 1e-12))) - 1
    return -1.0 if rank < 0 else float(null[rank]) if rank < len(null) else float("inf")


def limits(counts: np.ndarray, found: dict[str, np.ndarray], rate: float = RATE, draws: int = DRAWS) -> dict[str, float]:
    """Largest D that is reported by the draws alone, for each stratum; ``found`` has how many candidates lie at each rank of the draws."""
    out = {}
    for stratum, at_rank in found.items():
        p = largest_p({int(i): int(at_rank[i]) for i in np.flatnonzero(at_rank)}, rate, draws)
        name, length = stratum.rsplit(":", 1)
        if p > 0:
            out[stratum] = d_limit(text_deviations(counts, name, int(length), draws), p)
    return out


def scan(documents: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, text_key, ``base`` (the patterns' spans) and ``spans`` (all), each sorted: start, kind's place, kind, end."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    kind = dict(documents.dtypes)["doc_id"]
    base = "array<struct<start:bigint,at:int,kind:string,end:bigint>>"
    counts = np.zeros(1 << 14)
    for r in texts.mapInArrow(_pairs, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 2**14 rows at most
        counts[r.pair] = r.n
    counts = counts.reshape(128, 128)
    models = spark.sparkContext.broadcast({name: pair_model(counts, name) for name in ALPHABETS})
    scanned = cut(texts.mapInArrow(lambda it: _scan(it, ["doc_id", "text_key"], models), f"doc_id {kind}, text_key bigint, base {base}, maybe array<struct<start:bigint,end:bigint,stratum:string,d:double,tail:int>>"))

    tried = scanned.select(F.explode("maybe").alias("m")).select("m.stratum", "m.d", "m.tail")
    strata = sorted(r.stratum for r in tried.select("stratum").distinct().collect())  # alphabets times classes of length at most
    found: dict[str, dict[int, int]] = {s: {} for s in strata}
    drawn = {s: text_deviations(counts, s.rsplit(":", 1)[0], int(s.rsplit(":", 1)[1])) for s in strata}
    if strata:
        nulls = spark.sparkContext.broadcast(drawn)
        ranks = tried.mapInArrow(lambda it: _ranks(it, nulls, rate), "stratum string, rank int, n bigint").groupBy("stratum", "rank").agg(F.sum("n").alias("n"))
        for r in ranks.collect():  # a row for each stratum and draw or step of p at most
            found[r.stratum][r.rank] = r.n
    allowed = {s: (d_limit(drawn[s], p), d_limit(drawn[s], rate), int(np.ceil(-10 * np.log10(p) * (1 - 1e-12)))) for s in strata if (p := largest_p(found[s], rate)) > 0}
    out = scanned.mapInArrow(lambda it: _reported(it, allowed), f"doc_id {kind}, text_key bigint, base {base}, extra {base}")
    return out.select("doc_id", "text_key", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", "extra")).alias("spans"))


def _reported(batches: Iterator[pa.RecordBatch], allowed: dict[str, tuple[float, float, int]]) -> Iterator[pa.RecordBatch]:
    """The candidates within their stratum's limits (D; or D within the rate, and tail), without those inside a longer one."""
    for batch in batches:
        extra = []
        for maybe in batch.column("maybe").to_pylist():
            spans, reach = [], 0
            for m in maybe:  # in order of start, longer ones first
                by_d, gate, by_tail = allowed.get(m["stratum"], (-1.0, -1.0, 0))
                if (m["d"] < by_d or (m["d"] < gate and m["tail"] >= by_tail)) and m["end"] > reach:
                    spans.append({"start": m["start"], "at": KINDS.index("random"), "kind": "random", "end": m["end"]})
                    reach = m["end"]
            extra.append(spans)
        base = batch.column("base")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), base, pa.array(extra, base.type)], names=["doc_id", "text_key", "base", "extra"])


def _ranks(batches: Iterator[pa.RecordBatch], nulls, rate: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        strata, d = np.array(batch.column("stratum").to_pylist(), dtype=object), batch.column("d").to_numpy()
        tail = batch.column("tail").to_numpy()
        for s in sorted(set(strata.tolist())):
            rank, n = np.unique(ranked(d[strata == s], tail[strata == s], nulls.value[s], rate), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(rank)), pa.array(rank.astype(np.int32)), pa.array(n)], names=["stratum", "rank", "n"])


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def replaced(text: str, spans: list[dict], mark: str) -> str:
    """The text with the mark in place of each span; spans that overlap or are inside others count as one."""
    pieces, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            pieces += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*pieces, text[at:]])


def _redacted(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is their spans, without it."""
    for whole in batches:
        for batch in chunks(whole, "text"):
            *rest, spans = batch.columns
            names = batch.schema.names[:-1]
            found = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(found):
                texts, at = batch.column("text").to_pylist(), names.index("text")
                for i in found.tolist():
                    texts[i] = replaced(texts[i], spans[i].as_py(), mark)
                rest[at] = pa.array(texts, rest[at].type)
                if "n_chars" in names:
                    n = names.index("n_chars")
                    counts = rest[n].to_pylist()
                    for i in found.tolist():
                        counts[i] = len(texts[i])
                    rest[n] = pa.array(counts, rest[n].type)
            yield pa.RecordBatch.from_arrays(rest, names=names)


def redact(documents: DataFrame, mark: str = "[secret]", rate: float = RATE) -> DataFrame:
    """``documents`` with every found span replaced by ``mark``; a column n_chars follows the text, other columns stay."""
    id_, key, spans = free_names(documents.columns, "_id", "_key", "_spans")
    found = scan(documents, rate).where(F.size("spans") > 0).groupBy("doc_id", "text_key").agg(F.first("spans").alias(spans))
    found = found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), spans)
    both = documents.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left")
    return both.select(*documents.columns, spans).mapInArrow(lambda it: _redacted(it, mark), documents.schema)
