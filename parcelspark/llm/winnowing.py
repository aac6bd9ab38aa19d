"""Benchmark decontamination by winnowing.

Every window of L words keeps one fingerprint: the smallest of its k-gram hashes, the rightmost of equal ones. Equal
windows keep equal fingerprints, so a span of at least L words that a document shares with an item is always met by a
shared fingerprint. A met fingerprint is extended to its whole window inside the join, on the words themselves, so a
boilerplate k-gram alone never pairs a document with an item.

L is 13 (k = 7); an item of fewer words, but not none, is one window of its own length (k = half of it).

Defined cases: null or empty text has no words, so n_words = n_hit = 0 and it is not contaminated. Rows that repeat
both id and text count once; rows that share an id (null too) but not the text are judged apart. Benchmark rows with a
null item_id are ignored, repeated ones count once. Extra columns of either table are not read. An empty benchmark
leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.bitmap import hash_bits, may_have
from parcelspark.llm.textkit import ALNUM, Words, chunks, free_names
from parcelspark.session import cut

WINDOW = 13


def gram_length(length: int) -> int:
    return (length + 1) // 2


def fingerprints(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept fingerprint of every window of ``length`` words, and the number of the window's first word."""
    k = gram_length(length)
    width = length - k + 1
    g, at = words.grams(k)
    if len(g) < width:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(g, width)
    whole = at[width - 1 :] - at[: len(rows)] == width - 1
    whole &= words.text_of[at[: len(rows)]] == words.text_of[at[width - 1 :]]
    pick = width - 1 - np.argmin(rows[:, ::-1], axis=1)
    return rows[np.arange(len(rows)), pick][whole], at[: len(rows)][whole]


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text"):
            words = Words(batch.column("text"), ALNUM)
            item = batch.column("item_id").to_pylist()
            out: dict[str, list] = {"length": [], "fp": [], "window": [], "item_id": []}
            short = sorted({int(c) for c in words.counts if 0 < c < window})
            for length in (*short, window):
                fp, first = fingerprints(words, length)
                for f, i in zip(fp.astype(np.int64).tolist(), first.tolist(), strict=True):
                    text = int(words.text_of[i])
                    if length == window or words.counts[text] == length:
                        for name, v in zip(out, (length, f, words.joined(i, length), item[text]), strict=True):
                            out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("length", pa.int32()), ("fp", pa.int64()), ("window", pa.binary()), ("item_id", pa.string())]))


def _document_windows(batches: Iterator[pa.RecordBatch], lengths: list[int], bits) -> Iterator[pa.RecordBatch]:
    """A row for each document with its word count, and one for each of its windows that may be an item's."""
    slots = bits.value
    for whole in batches:
        for batch in chunks(whole, "text"):
            words = Words(batch.column("text"), ALNUM)
            rows: dict[tuple, list[int]] = {}
            for length in lengths:
                fp, first = fingerprints(words, length)
                for at in np.flatnonzero(may_have(slots, fp)).tolist():
                    i = int(first[at])
                    text = int(words.text_of[i])
                    rows.setdefault((text, length, int(fp[at].astype(np.int64)), words.joined(i, length)), []).append(i - int(words.offsets[text]))
            n, keys = batch.num_rows, list(rows)
            take = pa.array([*range(n), *(k[0] for k in keys)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take),
                    batch.column("text_key").take(take),
                    pa.array([*words.counts.tolist(), *[None] * len(keys)], pa.int64()),
                    pa.array([*[None] * n, *(k[1] for k in keys)], pa.int32()),
                    pa.array([*[None] * n, *(k[2] for k in keys)], pa.int64()),
                    pa.array([*[None] * n, *(k[3] for k in keys)], pa.binary()),
                    pa.array([*[None] * n, *rows.values()], pa.list_(pa.int32())),
                ],
                names=["doc_id", "text_key", "n_words", "length", "fp", "window", "starts"],
            )


def _covered(spans: Column) -> Column:
    """Number of words in any of the sorted spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("bigint"), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end")
    )
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_hit, n_items, items (sorted as strings), contaminated.

    ``contaminated``: some word is hit, and hit words are at least one in ``share``. Only windows whose fingerprint is
    in the test set's bitmap (1 MB) leave the scan; the join that follows is exact, its large keys are split at run time.
    """
    spark = documents.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = items.mapInArrow(lambda it: _item_windows(it, window), "length int, fp bigint, window binary, item_id string")
    tests = cut(found.groupBy("length", "fp", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    lengths = sorted(r.length for r in tests.select("length").distinct().collect())  # at most `window` numbers
    bits = spark.sparkContext.broadcast(hash_bits(tests, "fp"))

    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    kind = dict(documents.dtypes)["doc_id"]
    scanned = cut(texts.mapInArrow(lambda it: _document_windows(it, lengths, bits), f"doc_id {kind}, text_key bigint, n_words bigint, length int, fp bigint, window binary, starts array<int>"))
    hits = scanned.where("window is not null").join(tests, ["length", "fp", "window"])
    spans = F.transform("starts", lambda s: F.struct(s.cast("bigint").alias("start"), (s + F.col("length")).cast("bigint").alias("end")))
    both = (
        scanned.where("n_words is not null")
        .select("doc_id", "text_key", "n_words", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
        .unionByName(hits.select("doc_id", "text_key", F.lit(None).cast("bigint").alias("n_words"), spans.alias("spans"), "items"))
    )
    grouped = both.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    judged = grouped.select("doc_id", "text_key", "n_words", _covered(F.array_sort(F.array_distinct("spans"))).alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"))
    return judged.select(
        "doc_id", "text_key", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, **how: int) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, all columns as they were."""
    id_, key = free_names(documents.columns, "_id", "_key")
    bad = decontaminate(documents, benchmark, **how).where("contaminated").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key))
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left_anti")
