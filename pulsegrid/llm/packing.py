"""Length buckets of least padding, and batches within a token budget.

The global histogram of lengths is counted by Spark, with a bin for each distinct length; there are at most
about sqrt(2 * tokens) of them. Dynamic programming over it on the driver takes time in proportion to the
bins, so boundaries are optimal at every length. Documents are numbered inside their bucket without
gathering a bucket in one task.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.ranges import numbered, position
from pulsegrid.llm.store import written

BUCKETS, BUDGET = 16, 16_384
#: Rows and tokens of a bucket that one task numbers, about, and most such lots of all buckets.
LOT_ROWS, LOT_TOKENS, MOST_LOTS = 200_000, 1 << 24, 1 << 17


def length(text: Column) -> Column:
    """Tokens of a text: runs without white space, one at least; a null text has one."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)), F.lit(1)).cast("long")


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """The largest lengths of at most ``buckets`` buckets that minimise total padding over (length, count) bins.

    best[k][j] = min over i of best[k - 1][i] + length[j] * (rows of bins i..j), the padded tokens, in whole
    numbers. For each i that is a line in length[j] with slope -(rows before i); slopes fall and lengths rise,
    so the lower envelope is kept as a queue and a round takes one pass over the bins.
    """
    histogram = sorted(histogram)
    if not histogram:
        return []
    size, rows = [x for x, _ in histogram], [0]
    for _, n in histogram:
        rows.append(rows[-1] + n)
    m = len(size)
    best: list[int] = [size[j] * rows[j + 1] for j in range(m)]  # of the first j + 1 bins, in one bucket
    cuts = [[-1] * m]
    for _ in range(1, min(buckets, m)):
        new, cut = list(best), [-1] * m  # -1: no more buckets than before
        line: list[int] = []  # ends i of earlier buckets: best[i] - rows[i + 1] * x
        at = 0
        for j in range(1, m):
            i = j - 1
            while len(line) - at >= 2:  # the last line is nowhere lowest between its neighbours
                a, b = line[-2], line[-1]
                if (best[i] - best[a]) * (rows[b + 1] - rows[a + 1]) > (best[b] - best[a]) * (rows[i + 1] - rows[a + 1]):
                    break
                line.pop()
            line.append(i)
            value = lambda k, x=size[j]: best[k] - rows[k + 1] * x
            while len(line) - at >= 2 and value(line[at + 1]) <= value(line[at]):
                at += 1
            total = value(line[at]) + size[j] * rows[j + 1]
            if total < new[j]:
                new[j], cut[j] = total, line[at]
        best = new
        cuts.append(cut)
    out, j = [], m - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            out.append(size[j])
            j = cut[j]
    return sorted([*out, size[j]])


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, tokens: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with n_tokens, bucket, bucket_length, batch, batch_row and padding.

    ``tokens`` is a document's length (by default ``length`` of its text); nulls and lengths under 1 count
    as 1. Every document goes to the shortest bucket that holds it; a batch of a bucket has as many rows
    as bucket_length fits into ``budget``, and one at least, so a document over the budget is a batch of
    its own, however long. Batches are numbered from 0 in each bucket. Ties are ordered by id; repeated rows
    are packed each, and a row's number in the written table tells them apart. Columns of the same names are
    replaced. An empty table gives an empty one.
    """
    made = ("n_tokens", "bucket", "bucket_length", "batch", "batch_row", "padding")
    names = [c for c in docs.columns if c not in made]
    count = F.greatest(F.coalesce(tokens if tokens is not None else length(F.col("text")), F.lit(1)), F.lit(1)).cast("long")
    rows = docs.select(F.struct(*names).alias("row"), count.alias("n_tokens"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("own"))
    rows = written(rows).withColumn("spread", F.xxhash64("id", "own"))
    histogram = [tuple(r) for r in rows.groupBy("n_tokens").agg(F.count("*")).collect()]
    ends = boundaries(histogram, buckets)
    if not ends:
        return docs.select(*names, *[F.lit(0).cast("long").alias(c) for c in made]).limit(0)
    placed = rows.withColumn("bucket", position(F.col("n_tokens") - 1, ends))
    inside, held = dict.fromkeys(range(len(ends)), 0), dict.fromkeys(range(len(ends)), 0)
    for size, n in histogram:
        b = bisect_left(ends, size)
        inside[b] += n
        held[b] += size * n
    least = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4 // len(ends))
    lots = {b: int(min(max(least, n // LOT_ROWS, held[b] // LOT_TOKENS), MOST_LOTS // len(ends), n) or 1) for b, n in inside.items()}
    table = docs.sparkSession.createDataFrame([*lots.items()], "bucket int, lots int")
    placed = placed.join(F.broadcast(table), "bucket").withColumn("lot", F.pmod("spread", F.col("lots")).cast("int")).drop("lots")
    units, at = [], dict.fromkeys(inside, 0)
    for b, lot, n in sorted(tuple(r) for r in placed.groupBy("bucket", "lot").agg(F.count("*")).collect()):
        units.append((b, lot, ends[b], max(1, budget // ends[b]), at[b]))
        at[b] += n
    out = numbered(placed, units, {"bucket": "int", "lot": "int", "bucket_length": "long", "rows": "long", "offset": "long"}, [F.col("id"), F.col("own")])
    return out.select(
        *[F.col("row")[c].alias(c) for c in names],
        "n_tokens",
        F.col("bucket").cast("long").alias("bucket"),
        "bucket_length",
        F.floor(F.col("slot") / F.col("rows")).cast("long").alias("batch"),
        (F.col("slot") % F.col("rows")).cast("long").alias("batch_row"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )
