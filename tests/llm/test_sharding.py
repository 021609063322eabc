import random
import zlib

from pyspark.sql import functions as F

from pulsegrid.llm import queries, sharding
from pulsegrid.llm.ranges import position


def checked(rows, shards):
    """Slots without gaps; bytes of each shard."""
    slots, loads, places = {}, [0] * shards, {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += len((r.text or "").encode()) + 1
        places.setdefault(r.text or "", set()).add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return loads, places


def test_near_equal_bytes_with_equal_texts_together(spark):
    r = random.Random(3)
    texts = [r.choice("aé") * r.randrange(400) + str(i) for i in range(6000)] + ["hot text" * 30] * 300 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    loads, places = checked(sharding.shard_documents(df).collect(), 8)
    assert max(loads) < 1.03 * min(loads)
    assert all(len(v) == 1 for v in places.values())


def test_one_text_with_most_rows_is_spread(spark):
    df = spark.createDataFrame([(i, "x" * 50 if i % 3 else f"own {i}" * 9) for i in range(4000)], "doc_id long, text string")
    loads, places = checked(sharding.shard_documents(df, shards=4).collect(), 4)
    assert max(loads) < 1.05 * min(loads)
    assert len(places["x" * 50]) > 1 and all(len(v) == 1 for k, v in places.items() if k[0] == "o")


def test_edge_cases(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "same", 3), (1, "same", 3), (2, "y" * 200_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = sharding.shard_documents(df)
    assert out.columns == ["doc_id", "text", "shard", "slot"]
    checked(out.collect(), 8)
    assert sharding.shard_documents(df.limit(0)).collect() == []


def test_position_equals_counting(spark):
    bounds = sorted(random.Random(1).sample(range(-1000, 1000), 77))
    df = spark.range(-1100, 1100).select("id", position(F.col("id"), bounds).alias("at"))
    assert all(r.at == sum(b <= r.id for b in bounds) for r in df.collect())


def test_equal_rows_of_one_id_are_spread(spark):
    rows = [(7, "the same text " * 3)] * 4000 + [(i, f"own text {i}") for i in range(400)]
    loads, places = checked(sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 8)
    assert max(loads) < 1.1 * min(loads) and all(len(v) == 1 for k, v in places.items() if k[0] == "o")


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op9_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    loads, slots, places = [0] * 8, {}, {}
    for r in out:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        loads[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        places.setdefault(docs[r.doc_id], set()).add(r.shard)
    assert max(loads) < 1.03 * min(loads) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    share = sum(loads) / 8
    copies = {t: sum(docs[r.doc_id] == t for r in out) * (len(t.encode()) + 1) for t, v in places.items() if len(v) > 1}
    assert all(size > share for size in copies.values())
