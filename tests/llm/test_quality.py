import re

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import quality, queries


def test_kth_largest_equals_sorting(spark):
    r = np.random.default_rng(1)
    values = [*r.normal(size=500), *[2.0] * 40, *(1e-9 * r.normal(size=200)), 1e6, -1e6]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").cache()
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 30, 60, 300, 500, len(values)):
        assert quality.kth_largest(df, "v", k) == ordered[k - 1]
    assert quality.kth_largest(df.where("v = 2"), "v", 3) == 2.0


def test_calibrated_cut():
    assert quality.calibrated_cut([(1.0, True), (-4.0, False), (2.0, True)]) == -1.5
    assert quality.calibrated_cut([]) == quality.calibrated_cut([(1.0, True)]) == float("-inf")
    assert quality.calibrated_cut([(0.0, False)]) == float("inf")


def brute_weights(docs, targets):
    """log weights from tokens told by a regular expression and hashed alike."""
    from pulsegrid.llm import hashing

    def grams(text):
        tokens = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x20\x09-\x0D]+", text.encode())
        data = np.frombuffer(b" ".join(tokens) or b" ", np.uint8)
        h, _, _ = hashing.tokens(data, np.array([0, len(data)]))
        shape = [0 if not re.match(rb"[\w\x80-\xff]", t) else 1 if re.search(rb"[a-z\x80-\xff]", t) else 2 if re.search(rb"[A-Z]", t) else 3 for t in tokens]
        return quality.features(h, np.array(shape, int), np.array([0, len(h)]))[0]

    own = {i: grams(t or "") for i, t in docs}
    counts = np.ones((2, quality.FEATURES))
    for i, g in own.items():
        for k in (0, 1) if i in targets else (0,):
            np.add.at(counts[k], g, 1)
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    return {i: (len(g), ratio[g].sum()) for i, g in own.items()}


def test_weights_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    targets = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    want = brute_weights([(r.doc_id, r.text) for r in docs.collect()], {r.doc_id for r in targets.collect()})
    got = quality.scored(docs, quality.log_ratios(docs, targets)).collect()
    assert all(r.n_features == want[r.doc_id][0] and abs(r.log_weight - want[r.doc_id][1]) < 1e-6 * (1 + r.n_features) for r in got)


def test_gumbel_top_k_samples_by_weight(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(np.log(3.0))).otherwise(0.0).alias("w"))
    keys = rows.withColumn("key", quality.gumbel_key(F.col("w"), F.col("doc_id"), 5)).cache()
    least = quality.kth_largest(keys, "key", 400)
    drawn = keys.where(F.col("key") >= least).groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()
    counts = {r.odd: r["count"] for r in drawn}
    assert sum(counts.values()) == 400 and 250 < counts[0] < 350


def test_held_out_accuracy_and_stage(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    chosen = {r.doc_id: r.selected for r in queries.op6_quality(spark, sf).collect()}
    good, bad = ([chosen[i] for i, q in known.items() if q == x] for x in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2
    kept = quality.keep_selected(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in chosen.items() if s}


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good words", 0.5), (1, "good words", 0.5), (2, None, 1.0), (None, "", 1.0)], "doc_id long, text string, log_weight double")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, quality int")
    assert len(quality.resample(docs, labels).collect()) == 4
    assert sum(r.selected for r in quality.resample(docs, labels, k=2).collect()) >= 2
    assert not any(r.selected for r in quality.resample(docs, labels, k=0).collect())
    assert quality.resample(docs.limit(0), labels.limit(0)).collect() == []
    assert all(r.selected for r in quality.resample(docs, labels.limit(0)).collect())


def test_selection_of_the_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    fold = {r.doc_id: r.f for r in spark.createDataFrame([(i,) for i in labels], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)).alias("f")).collect()}
    weights = brute_weights(docs, {i for i, q in labels.items() if q == 1 and fold[i] == 0})
    sample = [(weights[i][1], q == 1) for i, q in labels.items() if fold[i] == 1 and i in weights]
    k = sum(w >= quality.calibrated_cut(sample) for _, w in weights.values())
    out = queries.op6_quality(spark, sf_dir).collect()
    keys = {r.doc_id: r.gumbel_key - r.log_weight + weights[r.doc_id][1] for r in out}
    assert {r.doc_id for r in out if r.selected} == set(sorted(keys, key=keys.get, reverse=True)[:k])


def test_labels_limit_repeated_ids_and_clashing_columns(spark):
    rows = [(i, f"good words here {i}" if i % 2 else f"BAD @@ ## {i}", float(i)) for i in range(400)] + [(1, "good words here 1", 1.0)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, log_weight double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    for n in (50, 400):
        kept = quality.keep_selected(docs, labels, n_labels=n).collect()
        assert all(r.log_weight == float(r.doc_id) for r in kept)
        assert sum(r.doc_id == 1 for r in kept) in (0, 51) and 150 < len({r.doc_id for r in kept}) < 260
