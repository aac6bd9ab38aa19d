"""Formats: token files, WARC archives, fingerprints, SentencePiece ids, dialogues; and all queries with SQL."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from compare import compare, duck

import __spark_entry__ as entry
from parcelspark.llm import chat, ctph, tokenfile, warc, wfst
from parcelspark.llm.queries import ORACLES, QUERIES
from parcelspark.llm.shards import bounds, filesystem

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def model():
    return wfst.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert compare(spark, duck(SF), SF, QUERIES[name], ORACLES[name]) is None


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_bounds_do_not_depend_on_partitions(spark, docs):
    from pyspark.sql import functions as F

    rows = docs.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("tie"), F.length("text").alias("n"))
    one, many = (bounds(rows.repartition(n), F.col("n"), 20_000) for n in (1, 13))
    assert one == many and len(one) > 3
    sizes = {(True, r.key, r.tie): r.n for r in rows.collect()}
    at, want, total = sorted(sizes), [], 0
    for k in at:
        if total // 20_000 != (total - last) // 20_000 if want else True:
            want.append(k)
        last = sizes[k]
        total += last
    assert one == want


def test_token_file(spark, docs, definition, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(definition)
    manifest = tokenfile.write(docs, definition, 2, str(tmp_path / "t"), shard_bytes=60_000)
    lines = manifest.orderBy("shard").collect()
    assert len(lines) > 2
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got, start = {r.doc_id: r for r in tokenfile.read(manifest).collect()}, 0
    for (key, _), e in zip(texts, plain.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 2], dtype="<u4").tobytes()
        assert (bytes(got[key].ids), got[key].start, got[key].n_tokens) == (ids, start, len(ids) // 4)
        start += len(ids) // 4
    some = {r.doc_id: bytes(r.ids) for r in tokenfile.read(manifest, wanted=[5, 77]).collect()}
    assert some == {k: bytes(got[k].ids) for k in (5, 77)}
    again = tokenfile.write(docs.repartition(5), definition, 2, str(tmp_path / "u"), shard_bytes=60_000)
    same = [[hashlib.sha256((tmp_path / d / f"tokens-{r.shard:06d}.bin").read_bytes()).digest() for r in lines] for d in "tu"]
    assert same[0] == same[1] and again.count() == len(lines)
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".tokens") and not p.name.endswith(".crc")]


class Counted(io.BytesIO):
    read_bytes = 0

    def read_at(self, n, offset):
        self.read_bytes += n
        self.seek(offset)
        return self.read(n)


def test_frames_are_independent_and_checked():
    out = io.BytesIO()
    writer = tokenfile.ShardWriter(out, frame_bytes=4000)
    rng = np.random.default_rng(0)
    ids = [rng.integers(0, 60_000, rng.integers(0, 2000), dtype="<u4").tobytes() for _ in range(50)]
    for i, x in enumerate(ids):
        writer.add(f"d{i}", x)
    assert writer.close() == (50, sum(map(len, ids)) // 4)
    data = out.getvalue()
    reader = tokenfile.ShardReader(file := Counted(data), len(data))
    before = file.read_bytes
    assert dict(reader.documents(["d31"])) == {"d31": ids[31]}
    assert file.read_bytes - before < len(data) / 5
    assert [x for _, x in reader.documents()] == ids
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read(8000) == b"".join(ids)[:8000]
    broken = bytearray(data)
    broken[int(reader.starts[3]) + 40] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.ShardReader(Counted(bytes(broken)), len(data)).frame(3)


def test_words_as_whole_texts(definition):
    encode = tokenfile.encoder(definition)
    for text in ["Hello, WORLD's ÀÉß ﬁ ñ İstanbul ΣΑΣ <|endoftext|>x <|startoftext|> ''s \x1cq\tz éa", "", "  \n ", "日本語 123 4.5 don't DON'T a.b,c;", "́x  y z"]:
        assert np.frombuffer(encode.encode([text])[0], "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_tokenizers_that_join_across_blanks():
    """A tokenizer whose pieces begin with a blank encodes texts whole."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encode = tokenfile.encoder(f.read())
    for text in ("two words  and\nlines", " x", "", "don't stop 12 34"):
        assert np.frombuffer(encode.encode([text])[0], "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_file_cases(spark, awkward, none, definition):
    rows = tokenfile.read(tokenfile.write(awkward, definition, 2)).collect()
    assert len(rows) == awkward.count() and sum(r.n_tokens == 1 for r in rows) == 4
    assert sorted(r.start for r in rows)[0] == 0
    assert tokenfile.read(tokenfile.write(none, definition, 2)).count() == 0
    fp = ctph.with_next(awkward).collect()
    assert len(fp) == awkward.count() - 1 or len(fp) == awkward.count()
    assert ctph.with_next(none).count() == 0
    one = ctph.with_next(awkward.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints(spark, docs):
    texts = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in ctph.with_next(docs, shard_bytes=40_000).collect()}
    assert len(got) == len(texts)
    for i, (key, text) in enumerate(texts):
        following = texts[(i + 1) % len(texts)][1]
        n = len(text) // 4
        edited = (text[: len(text) - n] + following[:n] if n else text).encode()
        own = ctph.fingerprint(text.encode())
        want = (len(text), hashlib.sha256(edited).hexdigest(), own, ctph.fingerprint(edited), ctph.likeness(own, ctph.fingerprint(edited)), ctph.likeness(own, ctph.fingerprint(following.encode())))
        assert tuple(got[key])[1:] == want


@pytest.mark.parametrize("copies", [10_000, 2])
def test_repeats_larger_than_shards(spark, copies, monkeypatch):
    """Repeats of one row that fill several shards: every row has its result, a repeat's next is the repeat."""
    monkeypatch.setattr(ctph, "COPIES", copies, raising=False)
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(k, f"text number {k} " * 20) for k in range(5)] + [(5, long)] * 7 + [(k, f"text number {k} " * 20) for k in range(6, 12)]
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "doc_id bigint, text string").repartition(3)
    texts = df.selectExpr("doc_id key", "xxhash64(text) tie", "length(text) size")
    starts = bounds(texts, texts["size"], 1000)
    assert len(starts) == len(set(starts)) > 2
    want = []
    for i, (key, text) in enumerate(rows):
        following, own = rows[(i + 1) % len(rows)][1], ctph.fingerprint(text.encode())
        n = len(text) // 4
        edited = (text[: len(text) - n] + following[:n]).encode()
        want.append((key, len(text), hashlib.sha256(edited).hexdigest(), own, ctph.fingerprint(edited), ctph.likeness(own, ctph.fingerprint(edited)), ctph.likeness(own, ctph.fingerprint(following.encode()))))
    assert sorted(tuple(r) for r in ctph.with_next(df, shard_bytes=1000).collect()) == sorted(want)


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 18))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        assert ctph.edit_distance(a, b) == row[-1]
    assert ctph.likeness(ctph.fingerprint(b""), ctph.fingerprint(b"abc")) == 0.0
    assert ctph.fingerprint(b"") == "3::"


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame(
        [(3, "http://a/é", "<p>same</p>"), (1, "http://b/\r\nX: y", "<p>same</p>"), (2, None, None), (4, "u", ""), (4, "u", ""), (5, "v", "<p>é other</p>" * 500), (None, "w", "<p>same</p>"), (6, "x", "z" * 300_000)],
        "page_id bigint, url string, html string",
    )
    manifest = warc.write(pages, str(tmp_path / "a"), shard_bytes=4000, file_bytes=300)
    lines = manifest.orderBy("file").collect()
    assert len(lines) >= 4 and sum(r.n_records for r in lines) == 7
    for r in lines:
        fs, name = filesystem(r.file)
        data = open(name, "rb").read()
        assert (len(data), hashlib.sha1(data).hexdigest()) == (r.n_bytes, r.sha1)
        assert next(warc.records(io.BytesIO(data)))[0]["WARC-Type"] == "warcinfo"
    got = {r.page_id: r for r in warc.read(manifest).collect()}
    kinds = {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in got.items()}
    assert kinds == {None: ("response", None, 11), 1: ("revisit", None, 11), 3: ("revisit", None, 11), 2: ("response", None, 0), 4: ("revisit", 2, 0), 5: ("response", None, 7500), 6: ("response", None, 300_000)}
    assert bytes(got[5].payload).decode() == "<p>é other</p>" * 500 and got[1].payload_digest == got[3].payload_digest == warc.digest32(b"<p>same</p>")
    again = warc.write(pages.repartition(3), str(tmp_path / "b"), shard_bytes=4000, file_bytes=300)
    assert [(r.file.rsplit("/", 1)[1], r.sha1) for r in again.orderBy("file").collect()] == [(r.file.rsplit("/", 1)[1], r.sha1) for r in lines]
    big = {r.page_id: r.record_type for r in warc.read(warc.write(pages, least_bytes=12)).collect()}
    assert set(big.values()) == {"response"}
    assert warc.read(warc.write(pages.where("false"))).count() == 0


def test_damaged_archive():
    data = bytearray(warc.response(1, 2, "u", b"payload " * 100))
    data[-20] ^= 255
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(io.BytesIO(bytes(data))))


def test_ids_as_the_library(spark, docs, model):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = wfst.encode(docs.select("doc_id", "text"), model).collect()
    assert all(r.ids == plain.encode(r.text) and r.round_trip for r in rows)
    machine = wfst.transducer(model)
    rng = random.Random(8)
    odd = ["", " ", "  a  b ", "x\n\n\t y ﬁ 日本 <s> ▁ é 👍🏽 <0x0A>", "a" * 90, " " * 40, "....!!!!????----====", "1234567890" * 5]
    odd += ["".join(rng.choice("aeintrsh .,'-\n(é日▁") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for text in odd:
        ids = machine.encode(text)
        assert ids == plain.encode(text), text
        assert machine.decode(ids) == plain.decode(ids)


def test_unigram_path():
    """Least weight of all segmentations, by trying them all."""
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "aba": -4.0, "▁a": -3.5, "ba": -4.6}
    model = wfst.Model(b"")
    model.pieces = [("<unk>", 0.0, wfst.UNKNOWN), *((p, s, wfst.NORMAL) for p, s in pieces.items())]
    machine = wfst.Transducer(model)

    def every(s):
        return [[]] if not s else [[s[:i], *rest] for i in range(1, len(s) + 1) if s[:i] in pieces for rest in every(s[i:])]

    for text in ("ab", "aba", "abab", "baab", "a b", "abba aba"):
        best = min(-sum(pieces[p] for p in path) for path in every(machine.normalised(text)))
        assert abs(best + sum(pieces[model.pieces[i][0]] for i in machine.encode(text))) < 1e-9


def test_id_cases(spark, awkward, none, model):
    clash = awkward.selectExpr("*", "1 as ids", "2 as n_ids")
    rows = wfst.encode(clash, model).collect()
    assert len(rows) == awkward.count() and all((r.ids is None) == (r.text is None) for r in rows)
    assert all(r.round_trip for r in rows if r.text is not None)
    assert wfst.encode(none, model).count() == 0


def test_rotation(spark):
    rows = [("c", 0, "system", "be kind"), ("c", 1, "ann", "hi"), ("c", 2, "bob", None), ("c", 2, "bob", None), ("c", 3, None, "?"), ("c", None, "ann", "late"), ("s", 0, "system", "only"), (None, 0, "zed", "x"), (None, 1, "ann", "y" * 5)]
    rows += [("long", i, "ab"[i % 2], "t" * (i % 7)) for i in range(200)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id string, turn int, role string, text string, speaker int")
    out = chat.rotate(df).collect()
    whole = {}
    for r in sorted(out, key=lambda r: (str(r.conv_id), r.speaker, r.part)):
        text, masks = whole.setdefault((r.conv_id, r.speaker), ["", []])
        assert len(text) == r.start
        whole[r.conv_id, r.speaker][0] += r.rendered
        masks += [(m.start, m.end) for m in r.masks]
    assert set(whole) == {("c", "ann"), ("c", "bob"), (None, "zed"), (None, "ann"), ("long", "a"), ("long", "b")}
    text, masks = whole["c", "ann"]
    assert text == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|user|>\n?<|end|>\n<|assistant|>\nlate<|end|>\n"
    assert [text[a:b] for a, b in masks] == ["hi<|end|>\n", "late<|end|>\n"]
    text, masks = whole["long", "b"]
    assert [text[a:b] for a, b in masks] == ["t" * (i % 7) + "<|end|>\n" for i in range(1, 200, 2)]
    assert chat.rotate(df.where("false")).count() == 0
