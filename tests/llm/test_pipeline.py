"""The pipeline's stages against plain Python on the smallest tables, each on what the one before kept."""

import re

import corpus_pipeline
from pulsegrid.llm import queries, secrets
from tests.llm.test_minhash import brute as near_groups
from tests.llm.test_secrets import brute as base_spans


def test_stages(spark, sf_dir):
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, kept = start, [start.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        kept.append(docs.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == start.columns
        docs = spark.createDataFrame(kept[-1], docs.schema)
    raw, good, single, clean, packed = kept
    chosen = {r.doc_id for r in queries.op6_quality(spark, sf_dir).collect() if r.selected}
    assert {r.doc_id for r in good} == chosen and 0.5 * len(raw) < len(good) < len(raw)
    groups = near_groups([(r.doc_id, r.text) for r in good], 80)
    assert {r.doc_id for r in single} == {i for i, (_, c) in groups.items() if i == c}
    before = {r.doc_id: r for r in single}
    assert set(before) == {r.doc_id for r in clean}
    for r in clean:
        assert r.n_chars == len(r.text) and base_spans(r.text) == []
        if r.text != before[r.doc_id].text:  # all that is not marked is as before
            parts = [re.escape(p) for p in r.text.split("[SECRET]")]
            assert re.fullmatch("(?s:.+?)".join(parts), before[r.doc_id].text)
        elif before[r.doc_id].text:
            assert base_spans(before[r.doc_id].text) == []
    assert [r.doc_id for r in sorted(packed)] == sorted(before) and {r.doc_id: r.n_tokens for r in packed} == {r.doc_id: max(1, len(r.text.split())) for r in clean}
    assert [k.name for k in secrets.BASE] == ["assign", "access", "hex"]


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[0] == "doc_id" and out.count() > 100


def test_edge_cases_of_every_stage(spark, sf_dir):
    """Nulls, empty and very long texts, ties, repeats, clashing names and empty tables, in each stage alone and in a row."""
    path = "a1/" * 400_000
    words = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (None, "no id at all"), (3, "plain words of a clean text"), (3, "plain words of a clean text"), (3, "another text of the same id"), (4, path), (5, words), (6, words + " end"), (7, "key token=abcdefabcdef0123456789 end"), (None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    more = ["log_weight", "n_features", "secrets", "_id", "row", "cluster", "bucket", "own", "found", "text_key", "batch", "tokens"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(more)) for i, t in rows], f"{names}, {', '.join(c + ' string' for c in more)}")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        if k == len(corpus_pipeline.STAGES) - 1:
            continue
        assert out.columns == docs.columns
        got = out.collect()
        assert all(r[c] == "x" for r in got for c in more), name
        if name == "minhash near-dedup":
            assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((i or 0, t or "") for i, t in rows if i != 6)
        if name == "secret scans":
            want = [(i, t.replace("token=abcdefabcdef0123456789", "[SECRET]") if t else t) for i, t in rows]
            assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, want))
            assert all(r.n_chars == len(r.text or "") for r in got)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(packed) == len(rows) and max(r.n_tokens for r in packed) == 60_001 and all(r.padding >= 0 for r in packed)
