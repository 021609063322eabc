import hashlib
import random

import pytest
import xxhash

from pulsegrid.llm import fingerprints, queries


def test_order_does_not_matter_and_edits_are_incremental():
    parts = [f"line {i}" for i in range(200)] + ["line 1"] * 3
    mark = fingerprints.fingerprint(parts)
    random.Random(1).shuffle(parts)
    assert fingerprints.fingerprint(parts) == mark
    assert fingerprints.insert(mark, "new") == fingerprints.fingerprint([*parts, "new"])
    assert fingerprints.delete(fingerprints.insert(mark, "new"), "new") == mark
    assert fingerprints.fingerprint([*parts, "line 1"]) != mark
    whole = b""
    for p in parts:
        whole = fingerprints.insert(whole or fingerprints.fingerprint([]), p)
    assert whole == mark


@pytest.mark.parametrize("shared", [0, 30, 100, 170, 200])
def test_likeness_estimates_the_shared_part(shared):
    a = fingerprints.fingerprint([f"a{i}" for i in range(200)])
    b = fingerprints.fingerprint([f"a{i}" if i < shared else f"b{i}" for i in range(200)])
    assert abs(fingerprints.likeness(a, b) - shared / 200) < 0.25
    assert fingerprints.likeness(a, b) == fingerprints.likeness(b, a)


def tie(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1]), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        f = [fingerprints.fingerprint(fingerprints.paragraphs(x)) for x in (t, edited, n)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f[0].hex(), f[1].hex(), fingerprints.likeness(*f[:2]), fingerprints.likeness(f[0], f[2])))
    return sorted(out, key=str)


def test_edge_cases_equal_brute_force(spark):
    r = random.Random(6)
    rows = [(i, "\n".join(f"é{r.randrange(9)}." for _ in range(r.randrange(40)))) for i in r.sample(range(5000), 300)]
    rows += [(None, "no id"), (None, None), (7, "x"), (7, "x"), (7, ""), (8, None), (9, "long. " * 50_000), (10, "\U0001f600" * 5)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fingerprint string")
    assert sorted(map(tuple, fingerprints.compare_with_next(df).collect()), key=str) == brute(rows)
    one = df.where("doc_id = 10")
    assert [tuple(x) for x in fingerprints.compare_with_next(one).collect()] == brute([rows[-1]])
    assert fingerprints.compare_with_next(df.limit(0)).collect() == []


@pytest.mark.parametrize("hot", [None, 77, 500])
def test_one_id_with_most_rows_is_spread(spark, hot):
    r = random.Random(8)
    rows = [(hot, f"text {r.randrange(900)}. More of it {i % 7}.") for i in range(1500)] + [(i, f"own {i}. line") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fingerprints.compare_with_next(df)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = [tuple(r) for r in queries.op5_fingerprints(spark, sf_dir).collect()]
    assert sorted(out, key=str) == brute(docs)
    assert sum(r[5] for r in out) > 2 * sum(r[6] for r in out)


def test_likeness_of_many_equal_lines():
    from pulsegrid.llm import fingerprints as own

    full, half = own.fingerprint(["a line"] * 70_000), own.fingerprint(["a line"] * 35_000)
    assert len(full) == own.WIDTH
    assert abs(own.likeness(full, half) - 0.8) < 1e-9
    assert own.insert(half, "a line", 35_000) == full and own.insert(full, "a line", -35_000) == half
