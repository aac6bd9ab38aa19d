"""Centroids, seekable fill-in-middle and the streaming BPE transducer, against plain versions and the library."""

import hashlib
import random
import re
from array import array

import numpy as np
import pytest

from parcelspark.llm import bpe, centroids, fim
from parcelspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_clusters(rows, k, rounds, scale, dims, seed=3):
    kept = [(i, [int(np.floor(float(scale) * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    places = [v for _, v in sorted(kept, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(places)), key=lambda j: (far(v, places[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v), []).append(v)
        places = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else places[j] for j in range(len(places))]
    out = [(i, near(v), far(v, places[near(v)])) for i, v in kept]
    by = {j: sum(d for _, c, d in out if c == j) for j in range(len(places))}
    return [(i, c, d, by[c], sum(by.values())) for i, c, d in out], places


ORDER = lambda rows: sorted(map(tuple, rows), key=lambda r: tuple((x is not None, 0 if x is None else x) for x in r))


def test_clusters(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 3, 0.3) for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[7][1])] * 40 + [(7, [0.0] * 4), (None, [1.0] * 4), (None, [-1.0] * 4), (900, None), (901, [1.0] * 3), (902, []), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan")] * 4), (905, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id bigint, vector array<double>, cluster int").repartition(5)
    for k, block in ((3, 50), (8, 7), (400, 8192)):
        got, places = centroids.cluster(df, k=k, rounds=4, dims=4, scale=64, block=block)
        want, at = plain_clusters(rows, k, 4, 64, 4)
        assert places == at and ORDER(got.collect()) == ORDER(want)
    few, places = centroids.cluster(df.where("id = 901 or id = 3"), k=8, rounds=2, dims=4)
    assert len(places) == 1 and [r.distance for r in few.collect()] == [0]
    empty, places = centroids.cluster(df.where("false"), dims=4)
    assert empty.count() == 0 and places == [] and empty.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia"]
    words = df.selectExpr("cast(id as string) id", "cast(vector as array<float>) vector")
    assert centroids.cluster(words, k=2, rounds=1, dims=4)[0].count() == len(rows) - 6


def test_far_components(spark):
    """Components beyond what squares in longs allow are worked out exactly; what no long holds is null."""
    rows = [(i, [float(2**30 * (i % 2)) + i, -3.5e5 * i]) for i in range(30)] + [(50, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    got, places = centroids.cluster(df.where("id < 50"), k=3, rounds=3, dims=2, scale=1)
    want, at = plain_clusters(rows[:-1], 3, 3, 1, 2)
    assert places == at and ORDER(got.collect()) == ORDER(want)
    got = centroids.cluster(df, k=1, rounds=1, dims=2, scale=1)[0].collect()
    assert len(got) == 31 and {r.inertia for r in got} == {None} and any(r.distance is None for r in got)


def test_tables_by_hand():
    block = centroids.Block(np.array([0, 2, 3]), np.array([-1, 4, 9]), np.array([[0, 1, 0], [0, 0, 0]], dtype="<u2").tobytes(), [[0, 9], [4, 8]])
    assert block.distances([[0, 9], [4, 8]]).tolist() == [[1, 26], [16, 1], [1, 26]]
    number, sums = block.sums(np.array([0, 1, 0]), 2)
    assert number.tolist() == [2, 1] and sums == [[-2, 18], [4, 9]]


def plain_fim(key, text, plain_from=50, psm_from=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = sha(f"42:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
        return key, n, "plain", None, None, sha(text), sha(text), text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < psm_from else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return key, n, form, len(p), len(m), sha(out), sha(text), out


@pytest.mark.parametrize("frame_bytes", [1, 7, 64, 1 << 16])
def test_fill_in_middle(spark, awkward, frame_bytes):
    rng = random.Random(frame_bytes)
    texts = ["", " ", "a", " a", "a ", "é" * 30, "日本 語\t\n x", "<P> here", "ends <", "<<S", "\x0b\x0c\r a", "\x00 \x1c\x85 b", None]
    texts += ["".join(rng.choice("ab <é日\n\tPSM>") for _ in range(rng.randint(1, 80))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "no id here"), (3, " a"), (3, "again")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n int, form string").repartition(3)
    kept = fim.store(df, frame_bytes)
    for kwargs in ({}, {"plain_from": 100}, {"plain_from": 100, "psm_from": 0}):
        got = fim.forms(fim.plan(kept, **kwargs), texts=True).collect()
        assert ORDER(got) == ORDER(plain_fim(k, t, **kwargs) for k, t in rows)
    if frame_bytes > 1:
        long = fim.forms(fim.plan(fim.store(awkward, frame_bytes * 100), plain_from=100), texts=True).collect()
        assert ORDER(long) == ORDER(plain_fim(r.doc_id, r.text, 100) for r in awkward.collect())
        assert fim.forms(fim.plan(fim.store(awkward.where("false")))).count() == 0


class Counted(fim.Frames):
    opened = 0

    def frame(self, i):
        self.opened += 1
        return super().frame(i)


def test_only_cut_frames_are_opened(spark):
    import zstandard

    text = " ".join(f"word{i}" for i in range(5000))
    row = fim.store(spark.createDataFrame([(1, text)], "doc_id int, text string"), 1000).first()
    doc = Counted(bytes(row.frames), {k: np.array(row[k]) for k in ("unit_ends", "char_ends", "byte_ends", "frame_ends")}, zstandard.ZstdDecompressor())
    assert len(row.unit_ends) > 30 and row.unit_ends[-1] == 5000
    units = UNIT.findall(text)
    for u in (0, 1, 2500, 4999, 5000):
        doc.opened = 0
        assert doc.cut(u) == (len("".join(units[:u])),) * 2 and doc.opened <= 1
    assert b"".join(doc.stream(1234, 30_000)).decode() == text[1234:30_000]
    frames = [bytes(row.frames)[a:b] for a, b in zip([0, *row.frame_ends], row.frame_ends)]
    assert b"".join(zstandard.ZstdDecompressor().decompress(f) for f in frames).decode() == text


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(definition):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_query(spark, docs, library):
    got = {r.doc_id: r for r in QUERIES["op13_bpe"](spark, SF).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert tuple(got[r.doc_id]) == (r.doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), sha(text))


def test_bpe_text(definition, library):
    own, rng = bpe.Bpe(definition), random.Random(3)
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftex|>", " \n\t x  y  z\x1c\x1f q\x85", "'s 'T don't I'll''ll", "日本語 ՘࢏1 \U0001e6c0 é 👍🏽", "a" * 5000, "guarantee" * 400, " " * 3000 + "x", "\n" * 2000]
    texts += ["".join(rng.choice("aeintrsh .,'-\n(é日▁guarnt\x1c ՘") for _ in range(rng.randint(1, 200))) for _ in range(500)]
    texts += ["".join(rng.choice(["ing", "guarantee", "tion", "er", "a", "re", "un", " "]) for _ in range(rng.randint(100, 1500))) for _ in range(60)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert array("I", own.encode(text)).tolist() == ids, text[:80]
        assert own.decode(own.encode(text), step=3) == library.decode(ids, skip_special_tokens=False)
    for _ in range(500):  # bytes that are no characters
        ids = [rng.randrange(50257) if rng.random() < 0.5 else rng.randrange(188, 256) for _ in range(rng.randint(0, 40))]
        assert own.decode(array("I", ids).tobytes(), step=1 + len(ids) % 5) == library.decode(ids, skip_special_tokens=False)


def test_windows_split_as_whole_texts(definition, monkeypatch):
    own, rng = bpe.Bpe(definition), random.Random(6)
    texts = ["".join(rng.choice("ab1.' \n日é") for _ in range(400)) for _ in range(60)]
    whole = [own.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "WINDOW", 5)
    monkeypatch.setattr(bpe, "KEPT", 20)
    assert [own.encode(t) for t in texts] == whole and len(own.ids) < 500


def test_settled_characters(library):
    """Characters outside of the looked-at ranges have one class in the pattern's engine and in the library."""
    settled = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not bpe._UNSETTLED.match(chr(c))]
    assert len(settled) > 30_000
    for at in range(0, len(settled), 2000):
        text = "".join(f"a{c}1" for c in settled[at : at + 2000])
        assert [o for _, o in library.pre_tokenizer.pre_tokenize_str(text)] == [m.span() for m in bpe._SPLIT.finditer(text)]


def test_lookahead_of_random_merges():
    """Tokens given out early are those of the whole string, for lists whose lookahead is reached and for long strings."""
    rng, reached = random.Random(9), 0
    for _ in range(150):
        parts, merges = [b"a", b"b", b"c"], []
        for _ in range(rng.randint(1, 9)):
            x, y = rng.choice(parts), rng.choice(parts)
            if (x, y) not in merges and x + y not in parts:
                merges.append((x, y))
                parts.append(x + y)
        ids = {p: i for i, p in enumerate(parts)}
        ahead = bpe.lookahead(merges)
        table = {(ids[x], ids[y]): r * (bpe.TOKEN + 1) + ids[x + y] for r, (x, y) in enumerate(merges)}
        single = [ids.get(bytes([b]), 0) for b in range(256)]
        machine = lambda: bpe.Transducer(single, table, [len(p) for p in parts], ahead)
        for _ in range(30):
            text = bytes(rng.choice(b"aabc") for _ in range(rng.randint(1, 40)))
            one, whole = machine(), machine().merged(text + bytes(rng.choice(b"abc") for _ in range(30)))
            end, seen = 0, one.merged(text)
            for t, (u, v) in enumerate(zip(seen, whole)):
                if u != v:
                    reached = max(reached, (len(text) - end) / ahead)
                    assert len(text) - end <= ahead + len(parts[u]) - 1, (merges, text)
                    break
                end += len(parts[u])
        long = bytes(rng.choice(b"aabc") for _ in range(3000))
        one, out = machine(), []
        for i in range(0, len(long), 37):
            out += one.push(long[i : i + 37])
            assert len(one.held) <= 4 * ahead + 64 + 37
        assert out + one.close() == machine()._merged_long([single[b] for b in long]) and len(out) > 100
    assert reached >= 1


def test_bpe_cases(spark, awkward, definition):
    clash = awkward.selectExpr("*", "1 as ids", "2 as n_tokens")
    coded = bpe.encode(clash, definition)
    rows = bpe.decode(coded, definition).collect()
    assert ORDER((r.doc_id, r.text) for r in rows) == ORDER((r.doc_id, r.text or "") for r in awkward.collect())
    assert sum(r.n_tokens == 0 for r in rows) == 3
    assert bpe.decode(bpe.encode(awkward.where("false"), definition), definition).count() == 0
    with pytest.raises(ValueError):
        bpe.Bpe(definition.replace('"dropout":null', '"dropout":0.1').replace('"dropout": null', '"dropout": 0.1'))
    with pytest.raises(ValueError):
        bpe.lookahead([(b"ab", b"c")])
