import hashlib
import random

import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import bpe, queries

LETTERS = ["a", "b", "é", "ß", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'re", "'", "1", "23", "!", "<|endoftext|>", "<|end", "한", "😀", "​", "　", "the", "ing", "ation", "-", "_", "\x00", "٣", "ſ"]


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(queries.vocabulary_path())
    own.no_truncation()
    own.no_padding()
    return own


def test_ids_and_texts_equal_the_library(library):
    own, r = bpe.encoder(queries.vocabulary_path()), random.Random(2)
    texts = ["".join(r.choices(LETTERS, k=r.randrange(50))) for _ in range(3000)] + ["", "a" * 2000, "ab" * 999, " " * 2000]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(own.encode(text)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_long_texts_in_parts(library, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 100)
    own, r = bpe.encoder(queries.vocabulary_path()), random.Random(3)
    text = "".join(r.choices(LETTERS, k=5000))
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)).decode() == text


def test_borders_without_memory(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    own = bpe.Encoder(queries.vocabulary_path())
    assert own.encode("some words and some more words, in a row").tolist() == library.encode("some words and some more words, in a row").ids


def test_operator_on_edge_cases(spark):
    path = queries.vocabulary_path()
    rows = [(1, None), (2, ""), (None, "x"), (3, "word " * 30_000), (3, "same"), (3, "same")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, token_ids string")
    out = bpe.decode(bpe.encode(df, path), path).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in out) == sorted((i or 0, t or "") for i, t in rows)
    broken = spark.createDataFrame([(1, [220, 50256, 447]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(broken, path).collect()} == {1: " <|endoftext|>�", 2: None, 3: ""}
    assert bpe.decode(bpe.encode(df.limit(0), path), path).collect() == []


def test_query_equals_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op7_bpe(spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
