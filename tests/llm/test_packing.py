import random
import re
from collections import Counter
from itertools import accumulate, combinations

from pyspark.sql import functions as F

from pulsegrid.llm import packing, queries


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= size) - size) for size, n in histogram)


def test_boundaries_are_optimal():
    r = random.Random(4)
    for _ in range(20):
        histogram = [(s, r.randrange(1, 50)) for s in r.sample(range(1, 300), 9)]
        top = max(s for s, _ in histogram)
        best = min(padding(histogram, [*c, top]) for k in range(3) for c in combinations([s for s, _ in histogram if s < top], k))
        got = packing.boundaries(histogram, 3)
        assert len(got) <= 3 and padding(histogram, got) == best
    assert packing.boundaries([], 3) == []


def test_boundaries_of_long_texts_are_optimal_too():
    r = random.Random(6)
    for _ in range(60):
        histogram = [(s, r.choice([1, r.randrange(1, 50), 10 ** r.randrange(12)])) for s in r.sample([*range(1, 40), *range(2000, 10**7, 991)], r.randrange(1, 10))]
        top, k = max(s for s, _ in histogram), r.randrange(1, 5)
        best = min(padding(histogram, [*c, top]) for q in range(k) for c in combinations([s for s, _ in histogram if s < top], q))
        got = packing.boundaries(histogram, k)
        assert len(got) <= k and padding(histogram, got) == best


def test_batches_fit_the_budget_and_leave_no_gap(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.choice([1, 5, 9, 40, r.randrange(1, 300)])) for i in range(1500)] + [(9, None), (9, ""), (None, "a"), (10**9, "w " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("x"))
    out = packing.pack(df, buckets=6, budget=1000).collect()
    assert len(out) == len(rows)
    batches = {}
    for x in out:
        assert x.n_tokens == max(1, len((x.text or "").split())) and x.padding == x.bucket_length - x.n_tokens >= 0
        batches.setdefault((x.bucket, x.bucket_length), {}).setdefault(x.batch, []).append(x.batch_row)
    assert len(batches) <= 6 and len({b for b, _ in batches}) == len(batches)
    for (_, size), own in batches.items():
        full = max(1, 1000 // size)
        assert sorted(own) == list(range(len(own)))
        assert all(sorted(v) == list(range(full)) for k, v in own.items() if k < len(own) - 1)
    assert packing.pack(df.limit(0)).collect() == []


def test_query_is_optimal_and_without_gaps(spark, sf_dir):
    docs = {r.doc_id: max(1, len(re.findall(r"[^ \t\n\x0b\f\r]+", r.text or ""))) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op10_packing(spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in out} == docs and len(out) == len(docs)
    histogram = sorted(Counter(docs.values()).items())
    size, rows = [s for s, _ in histogram], [0, *accumulate(n for _, n in histogram)]
    best = [s * rows[j + 1] for j, s in enumerate(size)]  # brute force over every split
    for _ in range(packing.BUCKETS - 1):
        best = [min(best[j], *[best[i] + size[j] * (rows[j + 1] - rows[i + 1]) for i in range(j)]) if j else best[0] for j in range(len(size))]
    assert sum(r.bucket_length for r in out) == best[-1]
    places = {}
    for r in out:
        full = max(1, packing.BUDGET // r.bucket_length)
        assert r.padding == r.bucket_length - r.n_tokens >= 0 and r.batch_row < full
        places.setdefault((r.bucket, full), []).append(r.batch * full + r.batch_row)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


def test_repeated_rows_and_lots(spark, monkeypatch):
    monkeypatch.setattr(packing, "LOT_ROWS", 50)
    df = spark.createDataFrame([(1, "a b c")] * 4000, "doc_id long, text string")
    out = packing.pack(df, budget=30).collect()
    assert sorted((r.batch, r.batch_row) for r in out) == [(i // 10, i % 10) for i in range(4000)]
