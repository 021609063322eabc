import hashlib
import random

from pyspark.sql import functions as F

from pulsegrid.llm import exact, queries


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    last = {t: max((x for x in ids if x is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, last[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


def shown(out):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str)


def corpus():
    r = random.Random(5)
    line = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randrange(20, 300))) + r.choice([". ", "\n", "! "])
    shared = [line() * 9 for _ in range(12)]
    texts = ["".join(r.choice([line(), *shared]) for _ in range(r.randrange(1, 12))) for _ in range(150)]
    texts += [texts[k % 40] for k in range(120)] + ["one common text. " * 200] * 200
    texts += [texts[0] + " ", texts[0].upper(), "x" * 30_000, "x" * 30_000, "x" * 30_001, None, "", " ", None]
    return [(i * 7 % 10_007, t) for i, t in enumerate(texts)]


def test_equals_grouping_by_text(spark):
    rows = corpus()
    out = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert shown(out) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)


def test_chunks_that_share_a_hash_are_told_apart(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact.exact_duplicates(df, identify=lambda c: F.pmod(F.xxhash64(c), F.lit(3))).collect()
    assert shown(out) == brute(rows)


def test_chunks_are_the_text_and_bounded(spark):
    df = spark.createDataFrame([(t or "",) for _, t in corpus()] + [("🙂" * 9000 + "a. b",)], "text string").withColumn("chunks", exact.chunks(F.col("text")))
    for r in df.collect():
        assert "".join(r.chunks) == r.text
        assert all(len(c) <= exact.LONGEST + 2 for c in r.chunks)


def test_a_stretch_gives_the_same_chunks_behind_another_start(spark):
    r = random.Random(2)
    body = "".join("".join(r.choice("abcdef ") for _ in range(120)) + ". " for _ in range(400))
    a, b = (row.chunks for row in spark.createDataFrame([(body,), ("A new start. " * 17 + body,)], "text string").select(exact.chunks(F.col("text")).alias("chunks")).collect())
    assert len(set(a) & set(b)) > 0.8 * len(a)


def test_edge_cases(spark):
    rows = [(None, "a", 1), (None, "a", 2), (3, "a", 3), (3, "a", 3), (4, None, 4), (None, "only null ids", 5), (None, "only null ids", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, recipe int").withColumns({"own": F.lit(1), "kept": F.lit(2), "chunks": F.lit(3)})
    out = exact.exact_duplicates(df).collect()
    a = [r for r in out if r.group_size == 4]
    assert len(a) == 4 and {r.keep_id for r in a} == {3} and [r.doc_id for r in a if r.kept] == [3]
    nulls = [r for r in out if r.group_size == 2]
    assert len(nulls) == 2 and {r.keep_id for r in nulls} == {None} and sum(r.kept for r in nulls) == 1
    assert exact.exact_duplicates(df.limit(0)).collect() == []


def test_native(spark, sf_dir):
    plan = queries.op13_exact_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
