"""Shards of near equal bytes from sampled splitters, in Spark expressions only.

Records are ordered by a hash of their text, so equal texts are neighbours. A size-weighted sample of
keys gives quantile boundaries for many more ranges than shards. Ranges that turn out overfull are
subdivided: a text that alone fills more than a range gets a range of its own, the rest is cut at its
own quantiles. Whole ranges are then dealt to shards, largest first, always to the lightest shard.
A range is spread over shards only if one text's copies exceed a shard's share. The rows are written once with
their key, size and a number of their own; all counts read these narrow columns.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.ranges import numbered, position
from pulsegrid.llm.store import written

#: Ranges for each shard, bytes of a range on large inputs, most ranges, and sampled keys for each range.
RANGES, RANGE_BYTES, MOST_RANGES, SAMPLED = 64, 256 << 20, 16_384, 64
ROUNDS = 3


def _quantiles(rows: DataFrame, n: int) -> list[int]:
    found = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 100_000)).first()[0]
    return sorted(set(found or []))


def splitters(rows: DataFrame, total: int, n: int, seed: int = 1) -> list[int]:
    """Sorted boundaries of about ``n`` ranges of equal bytes, from keys drawn with probability in proportion to size."""
    chance = F.least(F.lit(1.0), F.col("size") * (SAMPLED * n / total))
    draw = F.pmod(F.xxhash64("id", "own", "key", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    bounds = _quantiles(rows.where(draw < chance), n)
    for _ in range(ROUNDS):
        loads = rows.groupBy(position(F.col("key"), bounds).alias("range")).agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        over = [r["range"] for r in loads if r["bytes"] > 2 * total / n and r["low"] < r["high"]]
        if not over:
            break
        crowded = rows.withColumn("range", position(F.col("key"), bounds)).where(F.col("range").isin(over))
        heavy = [r["key"] for r in crowded.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > total / n).select("key").collect()]
        rest = crowded.where(~F.col("key").isin(heavy)) if heavy else crowded
        inner = rest.groupBy("range").agg(F.percentile_approx("key", [0.25, 0.5, 0.75], 1000).alias("cuts")).collect()
        more = {k for x in heavy for k in (x, x + 1) if k < 1 << 63} | {k for r in inner for k in r["cuts"]}
        if more <= set(bounds):
            break
        bounds = sorted(more.union(bounds))
    return bounds


def deal(loads: list[tuple[int, int, int, int]], shards: int, total: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(range, piece) to (shard, first slot) for loads (range, piece, rows, bytes): largest first to the lightest shard.

    The pieces of a range go together unless they exceed a shard's share.
    """
    whole: dict[int, list[tuple[int, int, int, int]]] = {}
    for x in loads:
        whole.setdefault(x[0], []).append(x)
    lots = []
    for pieces in whole.values():
        size = sum(p[3] for p in pieces)
        lots += [([p], p[3]) for p in pieces] if size > total / shards else [(pieces, size)]
    heap = [(0, s) for s in range(shards)]
    slots, out = [0] * shards, {}
    for pieces, size in sorted(lots, key=lambda x: (-x[1], x[0][0][:2])):
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, shard))
        for r, piece, rows, _ in sorted(pieces):
            out[r, piece] = (shard, slots[shard])
            slots[shard] += rows
    return out


def shard_rows(rows: DataFrame, key: Column, size: Column, row_id: str = "doc_id", shards: int = 8) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (0 up, without gaps, in each shard).

    ``key`` (a long) orders records and keeps equal keys together, ``size`` (a positive long) is what
    shards share equally; both must be of ``rows``. Null keys count as 0, null sizes as 1. Equal keys
    are ordered by ``row_id``; repeated rows are interchangeable, and a row's number in the written table
    tells them apart, so that they can be spread too. A size may be as large as a long. Columns named shard
    or slot are replaced. An empty table gives an empty one.
    """
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    keyed = rows.select(F.struct(*names).alias("row"), F.coalesce(key, F.lit(0)).cast("long").alias("key"), F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)).cast("long").alias("size"), F.col(row_id).cast("string").alias("id"), F.monotonically_increasing_id().alias("own"))
    keyed = written(keyed)
    total, count = keyed.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return rows.select(*names, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    n = min(MOST_RANGES, max(RANGES * shards, total // RANGE_BYTES))
    bounds = splitters(keyed.select("id", "own", "key", "size"), total, n)
    ranged = keyed.withColumn("range", position(F.col("key"), bounds))
    sized = ranged.groupBy("range").agg(F.count("*").alias("n")).collect()
    fair = -(-count // n)
    pieces = {r["range"]: -(-r["n"] // fair) for r in sized if r["n"] > 2 * fair}
    table = rows.sparkSession.createDataFrame([*pieces.items()] or [(-1, 1)], "range int, pieces int")
    ranged = ranged.join(F.broadcast(table), "range", "left").withColumn("piece", F.pmod(F.xxhash64("id", "own"), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")
    loads = [tuple(r) for r in ranged.groupBy("range", "piece").agg(F.count("*"), F.sum("size")).collect()]
    units = [(*k, *v) for k, v in deal(loads, shards, total).items()]
    out = numbered(ranged, units, {"range": "int", "piece": "int", "shard": "int", "offset": "long"}, [F.col("key"), F.col("id"), F.col("own")])
    return out.select(*[F.col("row")[c].alias(c) for c in names], "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with shard and slot: shards of near equal UTF-8 bytes (one more for each row), equal texts together.

    Null texts count as empty ones. See ``shard_rows``.
    """
    return shard_rows(docs, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.coalesce(F.octet_length(text_col), F.lit(0)) + 1, id_col, shards)
