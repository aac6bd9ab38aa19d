"""The pipeline's stages on small documents, against brute force."""

import brute
import pytest
from conftest import SF

import corpus_pipeline
from parcelspark.llm import secrets

pytest.importorskip("public_tokenizers")


def test_stages(spark):
    from parcelspark.session import cut

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = [{r.doc_id: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
        if name != "tokens":
            assert docs.columns == names
        kept.append({r.doc_id: r for r in docs.collect()})
    raw, language, copies, clean, redacted, coded = kept
    assert set(language) == {k for k, r in raw.items() if r.text and any(c.isalpha() for c in r.text)}
    ids = sorted(language)
    sets = brute.components([brute.shingles(language[i].text) for i in ids], ids)
    assert set(copies) == {i for i, (n, c) in zip(ids, sets, strict=True) if c == i or not n}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i: brute.contamination(r.text, items) for i, r in copies.items()}
    assert set(clean) == {i for i, (n, h, _) in hit.items() if not (h and 20 * h >= n)}
    assert set(redacted) == set(clean) == set(coded)
    changed = [i for i in clean if secrets.base_spans(clean[i].text)]
    assert all("[secret]" in redacted[i].text for i in changed) and all(redacted[i].n_chars == len(redacted[i].text) for i in changed)
    assert all(coded[i].round_trip and coded[i].text == redacted[i].text for i in coded)


def test_run_has_all_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"ids", "n_ids", "round_trip"} <= set(out.columns)


def test_clashing_columns(spark, awkward):
    """Columns named as the stages' own come back as they were, from every stage."""
    names = ["_id", "_key", "_spans", "_rows", "score", "lang_pred", "text_key", "comp", "spans", "items"]
    docs = awkward.selectExpr("*", *[f"concat('{n}', coalesce(cls, 0)) AS {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.cls or 0}" for r in rows for n in names), name


def test_redaction_is_linear():
    text = " ".join(f"token={i:09d}x" for i in range(20_000))
    spans = [{"start": 17 * i, "end": 17 * i + 16} for i in range(20_000)] + [{"start": 5, "end": 30}, {"start": 0, "end": 2}]
    assert secrets.replaced(text, spans, "#") == "# " * 19_998 + "#"  # the first two are joined by a span over both
    assert secrets.replaced("abc", [], "#") == "abc" and secrets.replaced("abc", [{"start": 0, "end": 3}], "#") == "#"
    taken = secrets.joint([(5, 9), (0, 3), (2, 4), (9, 10)])
    assert taken == ([0, 5], [4, 10])
    assert [secrets.meets(taken, a, b) for a, b in ((4, 5), (3, 4), (4, 6), (10, 12), (9, 20), (0, 1))] == [False, True, True, False, True, True]
