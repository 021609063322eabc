"""MinHash near-duplicate groups with sequential Bayesian verification.

Stages, each a Spark job over rows:

1. one pass over the texts gives each document's set size, a 128-bit key of its word sequence, its
   MinHash signature and its band hashes; equal word sequences are folded into one representative;
2. documents sharing a band are candidates. Inside a band's bucket, pairs are compared signature
   batch by signature batch; a pair is dropped once the posterior probability that its similarity
   reaches the threshold is below ``miss`` (uniform prior, Satuluri and Parthasarathy, "Bayesian
   Locality Sensitive Hashing", VLDB 2012). Each bucket emits a forest of its survivors, never all
   pairs. Buckets over ``block`` members skip the pruning and are joined to their smallest member,
   which can only widen the candidate clusters;
3. clusters of survivors are verified on full shingle sets in blocks of ``block`` documents, pairs
   in falling order of estimate, skipping pairs that are already connected. Larger clusters take
   two passes: each block with a few documents common to all blocks, then each document outside the
   cluster's largest component against every block. No pair of different components goes untested.

The number of bands follows from the threshold, so that a pair at it escapes all bands with probability ``miss``
at most: 24 bands at 0.85, 35 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import hashing
from pulsegrid.llm.components import connected
from pulsegrid.llm.store import cut, partitions, spread

ROWS, BATCH = 5, 24
BLOCK, COMMON = 256, 16
#: A side of a join is broadcast up to so many rows of two longs.
SMALL_ROWS = 250_000
U64 = hashing.U64
_C = hashing.stream(13, 8) | U64(1)


def bands_needed(threshold: float, miss: float) -> int:
    """The fewest bands that a pair at the threshold escapes with probability ``miss`` at most."""
    agree = threshold**ROWS
    return 1 if agree >= 1 else max(1, ceil(log(miss) / log(1 - agree)))


@cache
def _family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    return hashing.stream(11, hashes) | U64(1), hashing.stream(12, hashes)


def least_matches(threshold: float, miss: float, hashes: int | None = None, step: int = BATCH) -> list[int]:
    """For each batch's end n: the fewest matches m at which P(similarity >= threshold | m of n) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = []
    hashes = bands_needed(threshold, miss) * ROWS if hashes is None else hashes
    step = min(step, hashes)
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def shingles(h: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words (all words, if fewer), and offsets of documents in them."""
    counts = np.diff(places)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=out[1:])
    own = np.repeat(np.arange(len(runs)), runs)
    at = places[:-1][own] + np.arange(out[-1]) - out[:-1][own]
    size = np.minimum(counts, width)[own]
    raw = size.astype(U64) * _C[7]
    padded = np.concatenate([h, np.zeros(width, U64)])
    for k in range(width):
        raw += np.where(size > k, padded[at + k] * _C[k], U64(0))
    return hashing.mix(raw), out


def signatures(s: np.ndarray, places: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash signatures (documents x hashes) of non-empty sets laid end to end."""
    sig = np.empty((len(places) - 1, hashes), np.uint32)
    a, b = _family(hashes)
    for i in range(hashes):
        sig[:, i] = np.minimum.reduceat((s * a[i] + b[i]) >> U64(32), places[:-1])
    return sig


def _keys(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """16 bytes for each document's sequence of words."""
    rank = (np.arange(len(h)) - np.repeat(places[:-1], np.diff(places))).astype(U64)
    return np.stack([np.add.reduceat(hashing.mix(h + rank * _C[5 + i]), places[:-1]) for i in range(2)], 1)


def _describe(batches: Iterator[pa.RecordBatch], width: int, n_bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for at, n, (h,), places in hashing.grouped(batch.column(1), hashing.words):
            full = np.flatnonzero(np.diff(places) > 0)
            sizes = np.zeros(n, np.int64)
            keys, sigs, bands = ([None] * n for _ in range(3))
            if len(full):
                dense = np.append(places[:-1][full], places[-1])
                s, to = shingles(h, dense, width)
                for k, i in enumerate(full):
                    sizes[i] = len(np.unique(s[to[k] : to[k + 1]]))
                sig, key = signatures(s, to, n_bands * ROWS), _keys(h, dense)
                band = np.empty((len(full), n_bands), U64)
                for b in range(n_bands):
                    rows = sig[:, b * ROWS : (b + 1) * ROWS].astype(U64)
                    band[:, b] = hashing.mix((hashing.mix(rows + _C[:ROWS]) * _C[:ROWS]).sum(1, dtype=U64) + U64(b))
                for k, i in enumerate(full):
                    keys[i], sigs[i], bands[i] = key[k].tobytes(), sig[k].tobytes(), band[k].view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(keys, pa.binary()), pa.array(sizes), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64())), batch.column(2).slice(at, n)], ["doc_id", "words_key", "n_shingles", "signature", "bands", "text_key"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sorted distinct shingle hashes in place of the text (column 1); other columns stay."""
    for batch in batches:
        for at, n, (h,), places in hashing.grouped(batch.column(1), hashing.words):
            s, to = shingles(h, places, width)
            blobs = [np.unique(s[to[i] : to[i + 1]]).tobytes() for i in range(n)]
            part = batch.slice(at, n)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary()), *part.columns[2:]], [part.schema.names[0], "shingle_set", *part.schema.names[2:]])


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group, from input sorted by its first ``keys`` columns (integers)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1), len(ids)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(ids[lo])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union by smallest position."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = sorted((self.find(x), self.find(y)))
        self.up[y] = x
        return x != y


def survivors(sig: np.ndarray, least: list[int], other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (x, y, matches) that no batch's posterior bound prunes: all with x < y, or x against ``other``."""
    first = sig[:, :BATCH]
    cross = other is not None
    right = other if cross else sig
    xs, ys = [], []
    for x in range(len(sig)):
        low = 0 if cross else x + 1
        if low >= len(right):
            continue
        hits = np.flatnonzero((right[low:, :BATCH] == first[x]).sum(1) >= least[0]) + low
        xs.append(np.full(len(hits), x))
        ys.append(hits)
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
    hits = np.zeros(len(x), np.int64)
    for k, fewest in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        keep = np.empty(len(x), bool)
        for lo in range(0, len(x), 50_000):
            at = slice(lo, lo + 50_000)
            hits[at] += (sig[x[at], part] == right[y[at], part]).sum(1)
        keep = hits >= fewest
        x, y, hits = x[keep], y[keep], hits[keep]
    return x, y, hits


def _stars(ids: np.ndarray, forest: Forest) -> tuple[list[int], list[int]]:
    roots = [forest.find(i) for i in range(len(ids))]
    return [int(ids[i]) for i, r in enumerate(roots) if i != r], [int(ids[r]) for i, r in enumerate(roots) if i != r]


def _edges(pairs: tuple[list[int], list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], ["a", "b"])


def _prune(batches: Iterator[pa.RecordBatch], least: list[int]) -> Iterator[pa.RecordBatch]:
    """A forest of each bucket's surviving pairs; columns: bucket, doc_id, signature."""
    a: list[int] = []
    b: list[int] = []
    for table in runs(batches, 1):
        ids = table.column(1).to_numpy()
        sig = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint32).reshape(len(ids), -1)
        forest = Forest(len(ids))
        for x, y in zip(*survivors(sig, least)[:2], strict=True):
            forest.join(int(x), int(y))
        more = _stars(ids, forest)
        a += more[0]
        b += more[1]
        if len(a) > 5000:
            yield _edges((a, b))
            a, b = [], []
    yield _edges((a, b))


def _verify(batches: Iterator[pa.RecordBatch], least: list[int], hashes: int, numerator: int, denominator: int) -> Iterator[pa.RecordBatch]:
    """Exact links of a block as stars; columns: cluster, block, block of guests, doc_id, side, label, shingle_set.

    side 0 rows are compared with each other and with side 1, side 1 rows with each other too; rows that
    share a non-null label are connected beforehand.
    """
    for table in runs(batches, 3):
        ids, side, label = (table.column(i).to_numpy() for i in (3, 4, 5))
        keep = np.lexsort((side, ids))  # a document on both sides counts once
        keep = keep[np.append(True, ids[keep][1:] != ids[keep][:-1])] if len(keep) else keep
        ids, side, label = ids[keep], side[keep], label[keep]
        blobs = table.column(6).take(pa.array(keep)).to_pylist()
        sets = [np.frombuffer(x, U64) for x in blobs]
        places = np.append(0, np.cumsum([len(s) for s in sets]))
        sig = signatures(np.concatenate(sets), places, hashes)
        forest = Forest(len(ids))
        known: dict[int, int] = {}
        for i, x in enumerate(label):
            if x >= 0:
                forest.join(known.setdefault(int(x), i), i)
        x, y, hits = survivors(sig, least)
        for k in np.argsort(-hits, kind="stable"):
            i, j = int(x[k]), int(y[k])
            if forest.find(i) == forest.find(j):
                continue
            s, t = sets[i], sets[j]
            if numerator * max(len(s), len(t)) > denominator * min(len(s), len(t)):
                continue
            both = len(np.intersect1d(s, t, assume_unique=True))
            if denominator * both >= numerator * (len(s) + len(t) - both):
                forest.join(i, j)
        yield _edges(_stars(ids, forest))


def bounded_broadcast(rows: DataFrame) -> DataFrame:
    """``rows`` of a few longs, to be broadcast if a count shows SMALL_ROWS at most, else to be shuffled as usual."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (85, 100), width: int = 5, miss: float = 1e-6, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", text_key: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct
    runs of ``width`` words, or its whole sequence if it has fewer. Documents with intersection /
    union >= threshold (a fraction) are linked; component_id is the smallest doc_id reachable, kept
    tells whether it is the row's own.

    Null, empty and blank texts have an empty set and link with nothing. Rows with a null doc_id have a
    null component_id, link with nothing and are kept. Rows repeated with one doc_id and text get the
    same result; a doc_id with several texts gets a result for each, and its texts link apart. With
    ``text_key`` the rows also have the xxhash64 of their text. Texts may be as long as a row can be: they are read in
    pieces. Other columns of ``docs`` are not read, and an empty table gives an empty one.

    Buckets above ``block`` documents go to the verification whole, where posterior bounds prune pairs block by block.
    """
    spark = docs.sparkSession
    n_bands = bands_needed(threshold[0] / threshold[1], miss)
    least = least_matches(threshold[0] / threshold[1], miss)
    text = F.col(text_col).cast("string")
    plain = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")))
    described = cut(plain.mapInArrow(lambda it: _describe(it, width, n_bands), "doc_id long, words_key binary, n_shingles long, signature binary, bands array<long>, text_key long"))

    usable = described.where("words_key IS NOT NULL AND doc_id IS NOT NULL")
    named = F.struct("doc_id", "text_key")
    reps = cut(usable.groupBy("words_key").agg(F.min_by(F.struct("doc_id", "text_key", "signature", "bands"), named).alias("r")).select("words_key", "r.*"))
    # A document goes by its doc_id; the texts of a doc_id that has several go by hashes of their words.
    several = bounded_broadcast(usable.groupBy("doc_id").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low <> high").select("doc_id", F.lit(True).alias("several")))
    apart = not several.isEmpty()
    origin = None
    if apart:
        node = F.when(F.col("several"), F.xxhash64("words_key")).otherwise(F.col("doc_id"))
        reps = cut(reps.join(several, "doc_id", "left").select("words_key", node.alias("doc_id"), "signature", "bands", F.col("doc_id").alias("own"), "text_key"))
        origin = reps.select("doc_id", "own", F.col("text_key").alias("own_key"))

    # Buckets with the same members are folded; members are told by a count and two xors.
    banded = reps.select(F.explode("bands").alias("bucket"), "doc_id")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")).where("n > 1")
    buckets = buckets.groupBy("n", "low", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "low")
    members = cut(banded.join(buckets, "bucket"))
    signed = members.where(F.col("n") <= block).join(reps.select("doc_id", "signature"), "doc_id").select("bucket", "doc_id", "signature")
    n_parts = partitions(spark)
    links = signed.repartition(n_parts, "bucket").sortWithinPartitions("bucket", "doc_id").mapInArrow(lambda it: _prune(it, least), "a long, b long")
    wide = members.where((F.col("n") > block) & (F.col("doc_id") != F.col("low"))).select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    clusters = cut(connected(links.union(wide)).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")))

    sized = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("doc_id", "cluster", "size")
    texts = plain.where("doc_id IS NOT NULL")
    if apart:
        sized = sized.join(origin, "doc_id")
        met = (F.col("doc_id") == F.col("own")) & (F.col("text_key") == F.col("own_key"))
        texts = texts.join(bounded_broadcast(sized.withColumnRenamed("doc_id", "node")), met).drop("doc_id").withColumnRenamed("node", "doc_id")
    else:
        texts = texts.join(bounded_broadcast(sized), "doc_id")
    sets = cut(texts.select("doc_id", "text", "cluster", "size").mapInArrow(lambda it: _sets(it, width), "doc_id long, shingle_set binary, cluster long, size long").where("length(shingle_set) > 0"))

    blocks = F.ceil(F.col("size") / block).cast("long")
    home = F.pmod(F.xxhash64("doc_id"), blocks)
    homes = sets.select("cluster", home.alias("block"), F.lit(0).cast("long").alias("guests"), "doc_id", F.lit(0).alias("side"), F.lit(-1).cast("long").alias("label"), "shingle_set")
    common = sets.where((F.col("size") > block) & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("size")) < COMMON)).select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(0).cast("long").alias("guests"), "doc_id", F.lit(1).alias("side"), F.lit(-1).cast("long").alias("label"), "shingle_set")

    def verified(rows: DataFrame) -> DataFrame:
        keys = ["cluster", "block", "guests"]
        return rows.repartition(n_parts, *keys).sortWithinPartitions(*keys).mapInArrow(lambda it: _verify(it, least, n_bands * ROWS, *threshold), "a long, b long")

    exact = connected(verified(homes.union(common)))
    large = sets.where(F.col("size") > block).select("doc_id", "cluster", "size")
    if not large.isEmpty():
        exact = cut(exact)
        labelled = large.distinct().join(exact.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("cluster", "doc_id", "size", F.coalesce("component", "doc_id").alias("label"))
        main = labelled.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        labelled = cut(labelled.join(bounded_broadcast(main), "cluster"))
        outside = labelled.where("label <> main")
        strangers = outside.groupBy("cluster").agg(F.count("*").alias("strangers"))
        lots = F.ceil(F.col("strangers") / block).cast("long")
        payload = sets.select("doc_id", "shingle_set")
        known = labelled.join(bounded_broadcast(strangers), "cluster").withColumn("lots", lots)
        lists = F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)
        at_home = known.select("cluster", home.alias("block"), F.explode(lists).alias("guests"), "doc_id", F.lit(0).alias("side"), "label")
        as_guests = known.where("label <> main").select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.pmod(F.xxhash64("doc_id", F.lit(9)), F.col("lots")).alias("guests"), "doc_id", F.lit(1).alias("side"), "label")
        second = verified(at_home.union(as_guests).join(payload, "doc_id").select("cluster", "block", "guests", "doc_id", "side", "label", "shingle_set"))
        exact = connected(second.union(exact.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    if apart:  # components by their smallest doc_id
        exact = cut(exact)
        smallest = exact.join(origin.select(F.col("doc_id").alias("node"), "own"), "node").groupBy("component").agg(F.min("own").alias("least_own"))
        exact = exact.join(smallest, "component").select("node", F.col("least_own").alias("component"))
        alone = F.col("own")
    else:
        alone = F.col("rep")
    places = reps.select("words_key", F.col("doc_id").alias("rep"), *(["own"] if apart else [])).join(exact.select(F.col("node").alias("rep"), "component"), "rep", "left").select("words_key", F.coalesce("component", alone).alias("found"))
    out = described.select("doc_id", "words_key", "n_shingles", "text_key").join(places, "words_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *(["text_key"] if text_key else []))
