"""Quality classification by importance resampling.

Hashed n-gram models of target text (documents labelled good) and of raw text (all documents) give each
document a log importance weight, the log ratio of its probabilities under the two. Documents are then
drawn without replacement in proportion to their weights, by the Gumbel top-k trick (Xie et al., "Data
Selection for Language Models via Importance Resampling", NeurIPS 2023).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import hashing
from pulsegrid.llm.hashing import U64
from pulsegrid.llm.store import cut, spread

FEATURES = 1 << 14
#: Labelled rows used to fit the target model and to calibrate, about, by default; the raw model counts all documents.
LABELS = 20_000
#: A rejected good document weighs as much as so many accepted bad ones in calibration.
COST = 5.0


def features(h: np.ndarray, shape: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams and their documents: tokens, pairs of tokens, and pairs of token shapes with a mark for repeats."""
    own = np.repeat(np.arange(len(places) - 1), np.diff(places))
    inside = own[1:] == own[:-1]
    pairs = hashing.mix(h[:-1] * U64(3) + h[1:])[inside]
    shapes = hashing.mix((shape[:-1] * 16 + shape[1:] * 2 + (h[1:] == h[:-1])).astype(U64) + U64(0x5EED))[inside]
    grams = np.concatenate([h, pairs, shapes]) % U64(FEATURES)
    return grams.astype(np.int64), np.concatenate([own, own[1:][inside], own[1:][inside]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(model, feature, n) of a task's rows; columns: text, target. Model 0 is of all rows, 1 of target rows."""
    total = np.zeros((2, FEATURES), np.int64)
    for batch in batches:
        target = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        for at, _, (h, shape), places in hashing.grouped(batch.column(0), hashing.tokens):
            grams, own = features(h, shape, places)
            total[0] += np.bincount(grams, minlength=FEATURES)
            total[1] += np.bincount(grams[target[at + own]], minlength=FEATURES)
    model, feature = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(model, pa.int32()), pa.array(feature, pa.int32()), pa.array(total[model, feature])], ["model", "feature", "n"])


def log_ratios(docs: DataFrame, targets: DataFrame) -> np.ndarray:
    """Log ratio of the target model to the raw model for each feature; ``targets`` (doc_id) is a bounded sample."""
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(targets.select("doc_id", F.lit(True).alias("target")).distinct()), "doc_id", "left")
    counts = np.ones((2, FEATURES))
    rows = marked.select("text", "target").mapInArrow(_count, "model int, feature int, n long")
    for model, feature, n in rows.groupBy("model", "feature").agg(F.sum("n")).collect():  # two models' worth at most
        counts[model, feature] += n
    share = np.log(counts / counts.sum(1, keepdims=True))
    return share[1] - share[0]


def scored(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``docs`` with n_features and log_weight, both 0 for null and empty texts; columns so named are replaced."""
    names = [c for c in docs.columns if c not in ("n_features", "log_weight")]
    place = names.index("text")
    table = docs.sparkSession.sparkContext.broadcast(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for at, k, (h, shape), places in hashing.grouped(batch.column(place), hashing.tokens):
                grams, own = features(h, shape, places)
                n[at : at + k] = np.bincount(own, minlength=k)
                weight[at : at + k] = np.bincount(own, table.value[grams], minlength=k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(weight)], [*names, "n_features", "log_weight"])

    schema = docs.select(*names).schema.add("n_features", "long").add("log_weight", "double")
    return docs.select(*names).mapInArrow(score, schema)


def gumbel_key(log_weight: Column, doc_id: Column, seed: int) -> Column:
    """log_weight plus Gumbel noise that only doc_id and the seed decide, so a lost task draws it again alike."""
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return log_weight - F.log(-F.log(u))


def kth_largest(rows: DataFrame, col: str, k: int) -> float:
    """The k-th largest value of a column without nulls, by histograms that narrow down; k is at most the row count."""
    low, high = rows.agg(F.min(col), F.max(col)).first()
    above, bins = 0, 4096
    while high > low:
        width = (high - low) / bins
        place = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1))
        inside = rows.where((F.col(col) >= low) & (F.col(col) <= high))
        counts = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(place).agg(F.count("*"), F.min(col), F.max(col)).collect()}
        for b in sorted(counts, reverse=True):
            n, first, last = counts[b]
            if above + n >= k:
                break
            above += n
        if (first, last) == (low, high) and n > 1 and width <= abs(low) * 1e-15:
            break
        low, high = first, last
    return low


def calibrated_cut(sample: list[tuple[float, bool]]) -> float:
    """The log weight that parts good from bad at least cost, halfway between the values beside it."""
    if not sample:
        return float("-inf")
    sample = sorted(sample)
    cost = best = sum(not good for _, good in sample)  # accept all
    at = 0
    for k, (_, good) in enumerate(sample, 1):
        cost += COST if good else -1
        if cost < best:
            best, at = cost, k
    if at == 0:
        return float("-inf")
    return float("inf") if at == len(sample) else (sample[at - 1][0] + sample[at][0]) / 2


def _selection(docs: DataFrame, labels: DataFrame, seed: int, k: int | None, n_labels: int) -> tuple[np.ndarray, float, DataFrame]:
    docs = spread(docs.select("doc_id", "text"))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    sample = cut(known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(max(n, 1))) < n_labels).select("doc_id", "quality", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)).alias("fold")))
    ratios = log_ratios(docs, sample.where("quality = 1 AND fold = 0"))
    marks = cut(scored(docs.select("doc_id", "text"), ratios).select("doc_id", "n_features", "log_weight", gumbel_key(F.col("log_weight"), F.col("doc_id"), seed).alias("gumbel_key")))
    if k is None:
        one = marks.join(F.broadcast(sample.where("fold = 1")), "doc_id").groupBy("doc_id").agg(F.min("log_weight").alias("log_weight"), F.min("quality").alias("quality"))
        held_out = one.select("log_weight", "quality").collect()  # one row for each sampled label
        k = marks.where(F.col("log_weight") >= calibrated_cut([(w, q == 1) for w, q in held_out])).count()
    k = min(k, marks.count())
    return ratios, kth_largest(marks, "gumbel_key", k) if k else float("inf"), marks


def resample(docs: DataFrame, labels: DataFrame, seed: int = 1, k: int | None = None, n_labels: int = LABELS) -> DataFrame:
    """(doc_id, n_features, log_weight, gumbel_key, selected), one row per row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and quality (1 is good); about ``n_labels`` of them, drawn by a hash of doc_id, are
    used, half to fit and half to calibrate; of a doc_id with several labels or rows the least counts. ``k`` documents are drawn; by default as many as weigh at least the calibrated cut. Rows
    that tie with the k-th (repeated rows do) are drawn too. Null and empty texts weigh 0, and texts may be as long as
    a row can be: they are read in pieces. Without labels all are drawn, and an empty table gives an empty one. Other
    columns are not read.
    """
    _, least, marks = _selection(docs, labels, seed, k, n_labels)
    return marks.withColumn("selected", F.col("gumbel_key") >= least)


def keep_selected(docs: DataFrame, labels: DataFrame, seed: int = 1, k: int | None = None, n_labels: int = LABELS) -> DataFrame:
    """The rows of ``docs`` that ``resample`` selects, all columns; texts are scored again rather than shuffled."""
    ratios, least, _ = _selection(docs, labels, seed, k, n_labels)
    own = {c: f"{c}_of_docs" for c in docs.columns if c in ("n_features", "log_weight")}
    kept = scored(docs.withColumnsRenamed(own), ratios).where(gumbel_key(F.col("log_weight"), F.col("doc_id"), seed) >= least)
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
