"""The prefix trie of conversations by collapsing whole sequences.

Texts are digested where they are read; from then on a turn is a digest and a length. A prefix is named by sums of
digests that hold each turn's place, so prefixes of one conversation can be summed in pieces: rows are dealt by
ranges of (conversation, turn), and a conversation of any length is split over many tasks. Conversations with one
and the same sequence collapse to that sequence with a weight and a list of ends; sequences that are no proper
prefix of another, found by anti-join, are the leaves. Only distinct sequences are expanded to their prefixes, and
all figures of a node are sums over the sequences through it. For the sum over a subtree each node counts once, for
its smallest member: a sequence owns the lower end of its path, from one depth on, which one look-up tells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.store import partitions, written

#: Sums of so many numbers of 32 bits name a prefix; a sum of 2^31 turns still fits a long.
LANES = 6
#: Characters of a piece of an end list, and pieces of a batch.
PIECE, ROWS = 1 << 18, 1000


def _turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, lot, place, digest, chars): each conversation's turns numbered from 1; and (conv_id, n).

    Rows of a conversation may be spread over any number of ranges ("lots"); numbers run on by way of the lots' counts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    rows = written(dealt.select("conv_id", "digest", "chars", F.spark_partition_id().alias("lot"), F.monotonically_increasing_id().alias("at")))
    lots = rows.groupBy("conv_id", "lot").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(lots.select("conv_id", "lot", (before - F.col("first") + 1).alias("shift"), "n"))
    placed = rows.join(starts.drop("n"), ["conv_id", "lot"]).select("conv_id", "lot", (F.col("at") + F.col("shift")).alias("place"), "digest", "chars")
    return placed, starts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def _rebuilt(conversations: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length, lot, place, digest, chars) of the rebuilt turns, and (conv_id, length) of all conversations."""
    turns, counts = _turns(conversations)
    turns = written(turns)
    base = F.col("conv_id") - F.col("conv_id") % group
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)) if heads else F.lit(0).cast("long")
    firsts = counts.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    own = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = counts.select("conv_id", "n", base.alias("base"), h.alias("h")).join(firsts, "base", "left")
    convs = convs.withColumn("lent", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "lent", "h", (F.col("lent") + own).alias("length")))
    sizes = convs.select("conv_id", F.col("length"), "lent")
    mine = turns.withColumn("h", h).where("place > h").join(sizes, "conv_id")
    mine = mine.select("conv_id", "length", "lot", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "digest", "chars")
    lent = turns.where((F.col("conv_id") % group == 0) & (F.col("place") < heads)).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    taken = convs.join(lent, "base").where("place <= lent").select("conv_id", "length", F.lit(-1).alias("lot"), "place", "digest", "chars")
    return written(mine.union(taken)), convs.select("conv_id", "length")


def _named(place: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat_ws(",", place, *lanes), 256))


def _prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, length, depth, key, chars, upto): a row for each prefix of each conversation, the textless root included.

    upto: characters of the whole prefix. Sums run within a conversation's lots and are then moved on by the lots before.
    """
    names = [f"s{i}" for i in range(LANES)]
    hashed = rows.withColumn("hash", F.sha2(F.concat("digest", F.col("place").cast("string").cast("binary")), 256))
    lanes = [F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("long").alias(n) for i, n in enumerate(names)]
    rows = written(hashed.select("conv_id", "length", "lot", "place", "chars", *lanes))
    summed = [*names, "chars"]
    lots = rows.groupBy("conv_id", "lot").agg(*[F.sum(n).alias(n) for n in summed])
    earlier = Window.partitionBy("conv_id").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    moves = written(lots.select("conv_id", "lot", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in summed]))
    within = Window.partitionBy("conv_id", "lot").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("conv_id", "length", "lot", "place", "chars", *[F.sum(n).over(within).alias(f"sum_{n}") for n in summed])
    upto = {n: F.col(f"sum_{n}") + F.col(f"before_{n}") for n in summed}
    below = running.join(moves, ["conv_id", "lot"]).select("conv_id", "length", F.col("place").alias("depth"), _named(F.col("place"), [upto[n] for n in names]).alias("key"), "chars", upto["chars"].alias("upto"))
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", "length", zero.alias("depth"), _named(zero, [zero] * LANES).alias("key"), zero.alias("chars"), zero.alias("upto"))
    return written(below.union(roots))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id) in order to pieces (key, first, ids): decimal ids joined by commas, at most some PIECE characters."""
    key, first, ids, size, held = None, 0, [], 0, 0
    rows: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        cells = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cells, (pa.binary(), pa.int64(), pa.string()), strict=True)], ["key", "first", "ids"])

    for batch in batches:
        for k, c in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
            if ids and (k != key or size > PIECE):
                rows.append((key, first, ",".join(ids)))
                held += size
                if len(rows) >= ROWS or held > PIECE:
                    yield batch_of()
                    rows.clear()
                    held = 0
                ids, size = [], 0
            if not ids:
                key, first = k, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        rows.append((key, first, ",".join(ids)))
    if rows:
        yield batch_of()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of (key, first) to (key, ends_sha256), one key after another."""
    key, state = None, None
    rows: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        keys, digests = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests)], ["key", "ends_sha256"])

    for batch in batches:
        for k, ids in zip(batch[0].to_pylist(), batch[2].to_pylist(), strict=True):
            if k != key:
                if state:
                    rows.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if len(rows) >= ROWS:
            yield batch_of()
            rows.clear()
    if state:
        rows.append((key, state.hexdigest()))
    if rows:
        yield batch_of()


def _end_lists(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): ranges of the sorted ids become pieces, and only pieces meet by key."""
    dealt = ends.repartitionByRange(partitions(ends.sparkSession), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = dealt.mapInArrow(_listed, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, with its members, children, leaves and saving.

    ``conversations`` has longs conv_id and turn and strings role and text. Turns go by turn, a null one first, then
    by role and by the SHA-256 of role and text; null roles and texts are empty, repeated rows are turns of their
    own, and rows without a conv_id belong to no conversation. Conversation c is rebuilt as the first h turns of
    c - c % ``group`` (all if fewer, none if that is absent) and its own turns after its first h, where h is the
    CRC-32 of c in decimal modulo ``heads``; with ``heads`` 0 conversations stay as they are.

    Columns: conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens ((n_convs - 1) times the last text's code points, summed over the subtree), ends_sha256
    (of the sorted decimal ids that end here, comma-joined). A conversation may have any number of turns, a text
    any length, and any share of all conversations may be equal. Further columns do not matter, whatever they are
    called. An empty table gives an empty one.
    """
    prefixes = _prefixes(*_rebuilt(conversations, group, heads))
    ends = prefixes.where("depth = length").select("key", "conv_id", "length", "upto")
    whole = written(ends.groupBy("key").agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"), F.min("upto").alias("total")))
    paths = written(prefixes.join(whole.select("conv_id", "weight", "total"), "conv_id"))
    inner = paths.where("depth < length").select("key").distinct()
    leaves = whole.join(inner, "key", "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))

    owners = written(paths.groupBy("key").agg(F.min("conv_id").alias("owner")))
    owned = written(paths.join(owners, "key"))
    others = F.when(F.col("owner") != F.col("conv_id"), F.col("depth"))
    split = owned.groupBy("conv_id").agg(
        F.coalesce(F.max(others), F.lit(-1)).alias("shared"),
        F.max_by("owner", others).alias("above"),
        F.coalesce(F.max(F.when(others.isNotNull(), F.col("upto"))), F.lit(0)).alias("shared_chars"),
    )
    split = written(split.join(leaves, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0))))
    rows = owned.join(split, "conv_id")

    depth, before = F.col("depth"), F.col("upto") - F.col("chars")
    parent = F.when(F.col("owner") == F.col("conv_id"), F.when(depth == 0, None).when(depth - 1 > F.col("shared"), F.col("conv_id")).otherwise(F.col("above")))
    nodes = rows.groupBy("key").agg(
        F.min("owner").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.max(parent).alias("parent_conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum(F.when((F.col("length") > depth) & (depth >= F.col("shared")), 1).otherwise(0)).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * (F.col("total") - before) - F.col("total") + F.greatest(before, F.col("shared_chars"))).alias("saved_tokens"),
    )
    told = nodes.join(_end_lists(ends.select("key", "conv_id")), "key", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
