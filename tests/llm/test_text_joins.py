"""Winnowing and the Jaccard join against brute force, and their defined cases."""

import itertools
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from parcelspark.llm import sigtree, winnowing
from parcelspark.llm.graph import components
from parcelspark.llm.textkit import ALNUM, NOT_SPACE, Words, mix


def near_copies(rng, n_groups, size):
    """Groups of near copies with overlaps around the limit, a shared passage, and loners."""
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 220))]
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own[:0] = passage
            texts.append(" ".join(own))
    return texts + [t for t in texts if rng.random() < 0.1]


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["Ab c\td", None, "", "x", "É é ß1-2", "a b c d e f a b c d e"]
    for mask, rule in ((NOT_SPACE, brute.SPACE), (ALNUM, brute.ALNUM)):
        w = Words(pa.array(texts), mask)
        got = [[bytes(w.data[w.start[k] : w.end[k]]).decode() for k in range(w.offsets[i], w.offsets[i + 1])] for i in range(len(texts))]
        assert got == [brute.words(t, rule) for t in texts]
    g, at = Words(pa.array(texts), NOT_SPACE).shingles(5)
    assert np.diff(at).tolist() == [len(brute.shingles(t)) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_near_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(sigtree, "LEAF", 4)
    monkeypatch.setattr(sigtree, "NEAR", 2)
    texts = near_copies(random.Random(seed), 40, 12)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sigtree.jaccard_components(df).collect()}
    want = brute.components([brute.shingles(t) for t in texts], list(range(len(texts))))
    assert got == dict(enumerate(want))


def test_trees_alone_find_every_link(monkeypatch):
    """Without star comparisons: all pairs that the traversal leaves hold every link between components."""
    rng = random.Random(5)
    sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(rng.randint(20, 90))], dtype=np.uint64)) for _ in range(12)]
    members = []
    for s in sets:
        for _ in range(rng.randint(1, 8)):
            own = s.copy()
            k = rng.randint(0, len(own) // 6)
            own[:k] = [rng.getrandbits(64) for _ in range(k)]
            members.append(np.unique(own))
    members.sort(key=len)
    leaves = [sigtree.Leaf(list(range(a, min(a + 4, len(members)))), list(range(a, min(a + 4, len(members)))), [len(m) for m in members[a : a + 4]], [sigtree.signature(m).tobytes() for m in members[a : a + 4]]) for a in range(0, len(members), 4)]
    monkeypatch.setattr(sigtree, "NEAR", 0)
    nodes = sigtree._nodes([sigtree.Nodes.of(x) for x in leaves])
    found = {tuple(p) for x in leaves for p in sigtree.leaf_pairs(x, x, (75, 100)).tolist()}
    for i, j in sigtree.traverse(nodes, (75, 100), block=16):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            found |= {tuple(p) for p in sigtree.leaf_pairs(leaves[a], leaves[b], (75, 100)).tolist()}
    links = {(a, b) for b in range(len(members)) for a in range(b) if sigtree.linked(members[a], members[b], (75, 100))}
    assert links and links <= found


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_buckets_with_untested_links_stay(order):
    """Two tight sub-groups and a weaker link between them: the bucket of all four stays wherever it stands in its task."""
    shared, left, right = (np.arange(a, b, dtype=np.uint64) for a, b in ((0, 88), (100, 112), (200, 212)))
    scattered = lambda *parts: np.sort(mix(np.concatenate(parts) + np.uint64(1)))
    one = lambda k: np.array([k], dtype=np.uint64)
    sets = [scattered(shared, left, one(300)), scattered(shared, left, one(301)), scattered(shared, right, one(302)), scattered(shared, right, one(303))]
    assert all(sigtree.linked(a, b, sigtree.SHARE) for a, b in itertools.combinations(sets, 2))
    buckets = [(0, 1), (2, 3), (0, 1, 2, 3)]
    members = [(token, i, i, len(sets[i]), sigtree.signature(sets[i]).tobytes()) for token, k in enumerate(order) for i in buckets[k]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*members, strict=True)], names=["token", "cls", "comp", "n", "sig"])
    rows = [r for b in sigtree._leaves(iter([batch]), sigtree.SHARE, False) for r in b.to_pylist()]
    assert {r["token"] for r in rows} == {0, 1, 2}
    pairs = [(r["a"], r["b"]) for r in rows if r["kind"] == 0]
    assert len(pairs) == len(set(pairs))  # repeats still go within a task


def test_join_cases(spark, awkward, none):
    rows = sigtree.jaccard_components(awkward).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)
    long = len(brute.shingles(" ".join(f"word{i % 977} stone{i % 61}" for i in range(40_000))))
    want = [(1, 3, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, long, 5), (6, long, 5), (7, 1, 7), (None, 1, None), (None, 0, None), (8, 1, 8)]
    assert got == sorted(want, key=str)
    assert sigtree.jaccard_components(none).count() == 0
    kept = sigtree.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 1, 2, 3, 4, 5, 7, None, None, 8]))


def test_graph(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 200), (5, 4), (None, 3)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100), 200: 200}


def test_windows_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", item(rng.choice([0, 1, 3, 7, 12, 13, 14, 20, 40]))) for k in range(25)] + [("again", item(20))] * 2
    texts = []
    for _ in range(60):
        parts = [item(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(items)[1].split(" ")
            a = rng.randint(0, max(0, len(w) - 5))
            parts += [" ".join(w[a : a + rng.randint(3, 30)]).upper(), item(rng.randint(0, 10))]
        texts.append("\n".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in winnowing.decontaminate(docs, bench).collect()}
    assert got == {i: brute.contamination(t, items) for i, t in enumerate(texts)}


def test_contamination_cases(spark, awkward, none):
    bench = spark.createDataFrame([("a", "word0 stone0 word1 stone1 word2 stone2 word3 stone3 word4 stone4 word5 stone5 word6"), (None, "one two"), ("e", ""), ("n", None)], "item_id string, text string")
    got = winnowing.decontaminate(awkward, bench)
    by = {(r.doc_id, r.n_words): r for r in got.collect()}
    assert len(by) == 11
    assert by[2, 0].n_hit == 0 and not by[2, 0].contaminated
    assert by[5, 80_000]["items"] == ["a"] and not by[5, 80_000].contaminated
    assert winnowing.decontaminate(none, bench).count() == 0
    assert winnowing.decontaminate(awkward, bench.where("false")).where("n_hit > 0").count() == 0
    kept = winnowing.keep_clean(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
