import math
import random
import re

import numpy as np
import pytest

from pulsegrid.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, docs, k=10):
    held = [(d, terms(t)) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, ts in held:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for i, text in items:
        hits = []
        for d, ts in held:
            m = 100 - 75 + 75 * len(ts) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * ts.count(t) // (1000 * ts.count(t) + 8 * m)) for t in terms(text) if t in df)
            if score > 0:
                hits.append((score, d))
        hits.sort(key=lambda h: (-h[0], h[1] is None, h[1]))
        out += [(i, rank, d, score) for rank, (score, d) in enumerate(hits[:k], 1)]
    return sorted(out, key=str)


def searched(spark, items, docs, k=10):
    out = lexical.search(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def corpus(seed=1, n=300):
    r = random.Random(seed)
    words = ["".join(r.choice("abcéßK") for _ in range(r.randrange(1, 5))) + r.choice(["", "9"]) for _ in range(60)]
    text = lambda m: "".join(r.choice(words) + r.choice([" ", "-", "\n", "  ", "_"]) for _ in range(r.randrange(m)))
    docs = [(i, text(60)) for i in range(n)]
    docs += [(n + i, docs[i % 5][1]) for i in range(40)] + [(9001, None), (9002, ""), (9003, "?!"), (9004, "a" * 300_000 + " " + text(50))]
    return [(i, text(25)) for i in range(25)] + [(90, None), (91, "zzz unknown"), (92, text(9) * 200)], docs


def test_equals_plain_scoring_with_ties(spark):
    items, docs = corpus()
    assert searched(spark, items, docs) == brute(items, docs)


@pytest.mark.parametrize(("cells", "terms_", "docs_", "digit"), [(40, 3, 4, 20), (1, 2048, 1, 9), (1 << 23, 5, 512, 6)])
def test_tiles_blocks_and_digits_change_nothing(spark, monkeypatch, cells, terms_, docs_, digit):
    for name, value in (("BLOCK_CELLS", cells), ("TERMS", terms_), ("DOCS", docs_), ("DIGIT", digit)):
        monkeypatch.setattr(lexical, name, value)
    items, docs = corpus(2, 40)
    items = items[:5] + items[-2:] if cells == 1 else items
    assert searched(spark, items, docs, 3) == brute(items, docs, 3)


def test_terms_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical, "spans", lambda data, starts, ends, folded: np.zeros(len(starts), np.uint64))
    text = "bb aa ba AB zz aa".encode()
    ids, places = lexical.Vocabulary([b"aa", b"ab", b"bb"])(np.frombuffer(text, np.uint8), np.array([0, 5, len(text)]))
    assert ids.tolist() == [2, 0, -1, 1, -1, 0] and places.tolist() == [0, 2, 6]


def test_a_tile_stays_below_the_exact_range():
    assert lexical.TERMS * ((1 << lexical.DIGIT) - 1) * 10**6 < 1 << 53


def test_edge_cases(spark):
    docs = [(None, "same text"), (5, "same text"), (5, "same text"), (2, "same text"), (1, "other words")]
    items = [(7, "same"), (7, "same"), (None, "text")]
    out = searched(spark, items, docs)
    assert out == brute(items, docs) and len(out) == 12
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(i.limit(0), d).collect() == [] and lexical.search(i, d.limit(0)).collect() == []
    more = lexical.search(i.selectExpr("*", "1 AS rank", "2 AS score", "3 AS item"), d.selectExpr("*", "1 AS n", "2 AS ids", "3 AS id"))
    assert sorted((tuple(r) for r in more.collect()), key=str) == out
