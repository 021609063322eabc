"""Homomorphic fingerprints of documents as multisets of paragraphs.

Each paragraph is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors modulo powers of two (Bellare and Micciancio's AdHash, as in LtHash). So it does not depend
on the paragraphs' order, and inserting or deleting one adds or subtracts its vector. The vector has
SUMS lanes modulo 2^32, which decide equality, and SIGNS lanes of +-1 modulo 2^32, from whose squared
differences the size of the symmetric difference is estimated (Alon, Matias and Szegedy).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.ranges import position
from pulsegrid.llm.store import partitions

SUMS, SIGNS = 8, 128
WIDTH = SUMS * 4 + SIGNS * 4
#: A paragraph ends at a line break, or at a sentence's end before white space, so that one-line texts have several.
BREAK = re.compile(r"(?<=[.!?;|])\s+|\n+")


def paragraphs(text: str) -> list[str]:
    return [p for p in BREAK.split(text) if p]


def fingerprint(parts: Iterable[str]) -> bytes:
    """The sum of the paragraphs' vectors; of none: zeros."""
    digests = b"".join([blake2b(p.encode("utf-8", "surrogatepass"), digest_size=SUMS * 4 + SIGNS // 8).digest() for p in parts])
    if not digests:
        return bytes(WIDTH)
    rows = np.frombuffer(digests, np.uint8).reshape(-1, SUMS * 4 + SIGNS // 8)
    sums = np.ascontiguousarray(rows[:, : SUMS * 4]).view("<u4").sum(0, dtype=np.uint32)
    ones = np.unpackbits(rows[:, SUMS * 4 :], axis=1).sum(0, dtype=np.int64)
    return sums.astype("<u4").tobytes() + (2 * ones - len(rows)).astype("<i4").tobytes()


def _lanes(mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(mark[: SUMS * 4], "<u4"), np.frombuffer(mark[SUMS * 4 :], "<i4")


def insert(mark: bytes, paragraph: str, times: int = 1) -> bytes:
    """The fingerprint with a paragraph more (or, with times = -1, one less)."""
    sums, signs = _lanes(mark)
    more, ones = _lanes(fingerprint([paragraph]))
    return (sums + more * np.uint32(times % (1 << 32))).astype("<u4").tobytes() + (signs + ones * np.int32(times)).astype("<i4").tobytes()


def delete(mark: bytes, paragraph: str) -> bytes:
    return insert(mark, paragraph, -1)


def likeness(a: bytes, b: bytes) -> float:
    """An estimate of 2 |A and B| / (|A| + |B|) over the multisets' squared counts: 1 if equal, 0 if nothing is shared."""
    if a == b:
        return 1.0
    x, y = _lanes(a)[1].astype(float), _lanes(b)[1].astype(float)
    size = x @ x + y @ y
    return float(min(1.0, max(0.0, 1 - (x - y) @ (x - y) / size))) if size else 0.0


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, guest, doc_id, text) in order; a unit's last row is a guest, the next unit's first."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: tuple | None = None
    mark = b""
    for batch in batches:
        rows: list[tuple] = []
        for bucket, guest, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            now = fingerprint(paragraphs(text))
            if held is not None and held[0] == bucket:
                _, own_id, own = held
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                other = fingerprint(paragraphs(edited))
                rows.append((own_id, len(own), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark.hex(), other.hex(), likeness(mark, other), likeness(mark, now)))
            held, mark = (None if guest else (bucket, doc_id, text)), now
        columns = [*zip(*rows, strict=True)] or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()), strict=True)], names)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose last half is replaced from the next document's start.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row.
    Documents follow by falling doc_id, those without one last, ties by the texts' xxhash64; after the last comes the
    first, and a single document follows itself. Null texts are empty, an empty table gives an empty one, and a text
    may be as long as a row can be: two are in hand at a time. Other columns are not read.

    The order is cut into ranges of ids at sampled quantiles, four for each shuffle partition. An id that fills
    ranges, and the rows without one, are cut further by hash, so a task's rows are bounded but for rows of one id
    and one text. Each range also gets the first row of the next one, so texts are shuffled once and every task
    streams through its ranges.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100_000)).first()[0] or []
    hot = {x for x, y in zip(cuts, cuts[1:], strict=False) if x == y}
    bounds = sorted({*cuts, *hot, *(x + 1 for x in hot if x < (1 << 63) - 1)})
    bucket = F.coalesce(F.lit(len(bounds)) - position(F.col("doc_id"), bounds), F.lit(len(bounds) + 1))
    placed = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(bucket).cast("int"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"), (F.min("doc_id").eqNullSafe(F.max("doc_id"))).alias("alone")).collect()
    fair = max(1, sum(r["n"] for r in sizes) // n)
    parted = [(r["bucket"], -(-r["n"] // fair)) for r in sizes if r["alone"] and r["n"] > 2 * fair]
    pieces = F.broadcast(spark.createDataFrame(parted or [(-1, 1)], "bucket int, pieces int"))  # as many rows as ranges at most
    share = F.least(F.floor((F.col("tie") / 2.0**64 + 0.5) * F.col("pieces")), F.col("pieces") - 1)
    placed = placed.join(pieces, "bucket", "left").withColumn("piece", F.coalesce(share, F.lit(0)).cast("int")).drop("pieces")

    heads = sorted(tuple(r) for r in placed.groupBy("bucket", "piece").agg(F.max("doc_id").alias("head")).collect())
    units = [(k, b, p, head) for k, (b, p, head) in enumerate(heads)]
    known = F.broadcast(spark.createDataFrame(units or [(0, -1, 0, 0)], "unit int, bucket int, piece int, head long"))
    placed = placed.join(known, ["bucket", "piece"])
    before = F.pmod(F.col("unit") - 1, F.lit(max(1, len(units)))).cast("int")
    firsts = placed.where(F.col("doc_id").eqNullSafe(F.col("head"))).groupBy(before.alias("unit")).agg(F.min(F.struct("tie", "text")).alias("t"))
    both = placed.select("unit", F.lit(0).alias("guest"), "doc_id", "tie", "text").union(firsts.select("unit", F.lit(1), F.lit(None).cast("long"), "t.tie", "t.text"))
    ordered = both.repartition(partitions(spark), "unit").sortWithinPartitions("unit", "guest", F.desc_nulls_last("doc_id"), "tie", "text").drop("tie")
    return ordered.mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
