"""Ranked lexical search: tiles of item vocabulary times tiles of document impacts, multiplied by BLAS.

Items are taken in blocks whose dense item x term matrix is bounded. For each block the documents are read once:
whole texts are tokenised in numpy and kept as (number of terms, vocabulary ids, occurrences). Counts over all rows
then give the weights, and a second pass over the kept counts multiplies dense tiles in float64. All entries are
whole numbers, and a tile's sums stay below 2^53, so each product is exact; tiles are added up in 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.hashing import grouped, spans
from pulsegrid.llm.store import spread, written

#: A block's items times its terms, the columns of a vocabulary tile and the documents of a tile.
BLOCK_CELLS, TERMS, DOCS = 1 << 23, 1 << 11, 512
#: Weights are split in digits of so many bits. An impact is below 10^6 < 2^20, so a tile's sum is below
#: TERMS * 2^DIGIT * 2^20 = 2^51.
DIGIT = 20
#: Candidates of an item meet in so many lots before its last ranking.
LOTS = 64

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in UTF-8 bytes: runs of ASCII letters and digits and all longer characters."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TERM[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a term ends where its document does
    now, before = inside[1:], inside[:-1]
    return np.flatnonzero(now & (~before | first)), np.flatnonzero(before & (~now | first))


def _flat(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices start, start + 1, ... of each span one after another, and where each span begins in them."""
    at = np.cumsum(lengths) - lengths
    return np.repeat(starts - at, lengths) + np.arange(int(lengths.sum())), at


class Vocabulary:
    """Terms by hash; a hash that meets is confirmed byte by byte."""

    def __init__(self, terms: list[bytes]) -> None:
        self.size = len(terms)
        lengths = np.array([len(t) for t in terms], np.int64)
        blob = np.frombuffer(b"".join(terms), np.uint8)
        starts = np.cumsum(lengths) - lengths
        hashes = spans(blob, starts, starts + lengths, True) if terms else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.blob, self.starts, self.lengths, self.ids, self.hashes = blob, starts[order], lengths[order], order, hashes[order]
        self.sharing = int(np.unique(hashes, return_counts=True)[1].max(initial=0))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary's id of each term of the documents, -1 if it has none, and the documents' offsets in them."""
        starts, ends = term_spans(data, offsets)
        out = np.full(len(starts), -1, np.int32)
        if self.size and len(starts):
            hashes = spans(data, starts, ends, True)
            first = np.searchsorted(self.hashes, hashes)
            for k in range(self.sharing):  # once, unless terms share a hash
                near = np.minimum(first + k, self.size - 1)
                met = np.flatnonzero((self.hashes[near] == hashes) & (self.lengths[near] == ends - starts))
                near = near[met]
                here, at = _flat(starts[met], self.lengths[near])
                there, _ = _flat(self.starts[near], self.lengths[near])
                if len(met):
                    same = np.logical_and.reduceat(_LOWER[data[here]] == self.blob[there], at)
                    out[met[same]] = self.ids[near[same]]
        return out, np.searchsorted(starts, offsets)


def _terms_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, text in zip(batch[0].to_pylist(), batch[1].cast(pa.large_binary()).to_pylist(), strict=True):
            data = np.frombuffer(text or b"", np.uint8)
            starts, ends = term_spans(data, np.array([0, len(data)]))
            low = _LOWER[data].tobytes()
            counts: dict[bytes, int] = {}
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                counts[low[s:e]] = counts.get(low[s:e], 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["item", "term", "times"])


def _blocks(sizes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and last item of runs whose items times terms stay within BLOCK_CELLS; an item alone may exceed it."""
    out: list[list[int]] = []
    items = terms = 0
    for item, n in sorted(sizes):
        if not out or (items + 1) * (terms + n) > BLOCK_CELLS:
            out.append([item, item])
            items = terms = 0
        out[-1][1] = item
        items, terms = items + 1, terms + n
    return [(a, b) for a, b in out]


def _counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(id, n, ids, tfs) of the documents with a term: number of terms, then the block's terms and their occurrences."""
    vocabulary = Vocabulary(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(1, vocabulary.size)
        for batch in batches:
            for first, n, (ids,), places in grouped(batch.column(1), vocabulary):
                document = np.repeat(np.arange(n, dtype=np.int64), np.diff(places))
                met = ids >= 0
                pairs, tfs = np.unique(document[met] * width + ids[met], return_counts=True)
                total = np.diff(places)
                some = np.flatnonzero(total > 0)
                bounds = np.searchsorted(pairs, np.append(some, n) * width)
                offsets = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n).take(pa.array(some)),
                        pa.array(total[some].astype(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array((pairs % width).astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(tfs.astype(np.int64))),
                    ],
                    ["id", "n", "ids", "tfs"],
                )

    return docs.mapInArrow(count, "id long, n long, ids array<int>, tfs array<long>")


class Best:
    """The k best (score, id) of each item so far; of equal scores the smaller id stays, null ids come last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score, self.id, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """scores: items x documents. Whatever ties with an item's k-th score is looked at, not just k of them."""
        bar = self.least
        if scores.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        item, doc = np.nonzero(scores >= bar[:, None])
        if not len(item):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[item, doc]])
        doc_id, none = np.concatenate([self.id, ids[doc]]), np.concatenate([self.null, null[doc]])
        order = np.lexsort((doc_id, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.k]
        self.item, self.score, self.id, self.null = item[place < self.k], score[order], doc_id[order], none[order]
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.least)) == self.k)
        self.least[full] = self.score[np.searchsorted(self.item, full, "right") - 1]


def _scored(counted: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, score) of each partition's k best documents; weights: items x terms, whole numbers."""
    planes = []
    rest = weights
    while not planes or rest.any():
        planes.append((rest & ((1 << DIGIT) - 1)).astype(np.float64))
        rest = rest >> DIGIT

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(weights), k)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                tile = batch.slice(at, DOCS)
                n, held = tile.column(1).to_numpy(), tile.column(2)
                tf = tile.column(3).flatten().to_numpy()
                document = np.repeat(np.arange(len(n)), held.value_lengths().to_numpy())
                m = 25 + (75 * n * n_docs) // n_terms
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[document])
                used, column = np.unique(held.flatten().to_numpy(), return_inverse=True)
                total = np.zeros((len(weights), len(n)), np.int64)
                for low in range(0, len(used), TERMS):
                    here = (column >= low) & (column < low + TERMS)
                    cols = used[low : low + TERMS]
                    dense = np.zeros((len(cols), len(n)))
                    dense[column[here] - low, document[here]] = impact[here]
                    for j, plane in enumerate(planes):
                        total += (plane[:, cols] @ dense).astype(np.int64) << (DIGIT * j)
                ids = tile.column(0)
                best.add(total, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        ids = pa.array(best.id, pa.int64(), mask=best.null)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), ids, pa.array(best.score)], ["item", "id", "score"])

    return counted.mapInArrow(score, "item long, id long, score long")


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(items: DataFrame, docs: DataFrame, k: int = 10, item_id: str = "item_id", doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item id, rank, doc_id, score): each item's ``k`` documents of the highest score above 0, all if fewer.

    Both texts are read whole. Items and documents without a term, null texts among them, are in no result. Every
    row is a document (or item) of its own, so repeated rows take ranks of their own; equal scores go by ascending
    doc_id, a null one last. Document ids are longs. Other columns do not matter, whatever they are called. One
    item may have any number of terms, and one text any length. Empty tables give an empty one.
    """
    spark = docs.sparkSession
    named = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("name"), F.col(text_col).alias("text")))
    of_items = written(named.select("item", "text").mapInArrow(_terms_of_items, "item long, term binary, times long"))
    rows = spread(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text_col).alias("text")))
    found = spark.createDataFrame([], "item long, id long, score long")
    for first, last in _blocks([tuple(r) for r in of_items.groupBy("item").count().collect()]):
        block = of_items.where(F.col("item").between(first, last)).collect()
        numbers = sorted({r["item"] for r in block})
        terms = sorted({bytes(r["term"]) for r in block})
        counted = written(_counted(rows, terms))
        n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = dict(counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect())
        row, column = {x: i for i, x in enumerate(numbers)}, {t: i for i, t in enumerate(terms)}
        weights = np.zeros((len(numbers), len(terms)), np.int64)
        for r in block:
            c = column[bytes(r["term"])]
            weights[row[r["item"]], c] = r["times"] * weight(n_docs, df.get(c, 0))
        places = F.broadcast(spark.createDataFrame([*enumerate(numbers)], "place long, item long"))
        hits = _scored(counted, weights, n_docs, n_terms, k).withColumnRenamed("item", "place")
        found = found.union(hits.join(places, "place").select("item", "id", "score"))
    lots = _top(found.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(LOTS))), ["item", "lot"], k)
    ranked = _top(lots, ["item"], k).join(named.select("item", "name"), "item")
    return ranked.select(F.col("name").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score")
