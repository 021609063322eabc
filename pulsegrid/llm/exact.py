"""Exact duplicates by content-defined chunk recipes, in Spark expressions only.

A text is cut where its content says so: after ``SHORTEST`` characters, at the first gap between two words whose
letters meet a rare condition (about one gap in a hundred). As that is rarer than the shortest chunk is long, cuts
in equal stretches of different documents soon fall in step, and a chunk has a bounded length whatever the text's.
Chunks are deduplicated once, by hash and full text; this is the only time that texts are shuffled, and each task
sends a chunk once however often it occurs. A hash that stands for one chunk text only is that chunk's identifier;
where several texts share a hash, their number among those texts is added to it. A document is then the ordered
list of its chunks' identifiers, some thousandth of its text, and all comparisons move these lists alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.store import cut, spread, written

#: Characters of a chunk before its end is looked for, and at most; a text without such an end is cut at the latter.
SHORTEST, LONGEST = 512, 8192
#: Behind a word that ends in a letter of code 4 modulo 16, before one that begins with 1 modulo 8 and goes on with 2
#: modulo 4; also behind a mark that ends a sentence of a script without gaps.
CUT = r"(?:[dtDT]\s(?=[aiqyAIQY][bfjnrvzBFJNRVZ])|[。！？])"
CHUNK = rf"(?s).{{{SHORTEST},{LONGEST}}}?{CUT}|.{{1,{LONGEST}}}"
#: Rows of chunk texts that share a hash, up to which they are broadcast.
FEW = 1_000


def chunks(text: Column) -> Column:
    """The chunks of a text in order; concatenated they are the text. Null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CHUNK), F.lit(0))


def _numbered_twins(distinct: DataFrame) -> DataFrame | None:
    """(h, chunk, number) of the chunk texts that share their hash with others; None if there are none."""
    several = cut(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    if several.isEmpty():
        return None
    place = F.row_number().over(Window.partitionBy("h").orderBy("chunk"))
    return cut(distinct.join(several, "h").select("h", "chunk", place.alias("number")))


def recipes(rows: DataFrame, text_col: str = "text", identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``rows`` with ``recipe`` in place of the text: an array of longs that equals another's exactly if the texts do.

    ``identify`` hashes a chunk to a long; a weak one costs time, never correctness. Null texts are as empty ones,
    whose recipe is empty; texts may be as long as a row can be. Other columns stay, one named recipe is replaced.
    """
    names = [c for c in rows.columns if c not in (text_col, "recipe")]
    parts = rows.select(F.explode(chunks(F.col(text_col))).alias("chunk"))
    twins = _numbered_twins(parts.select(identify(F.col("chunk")).alias("h"), "chunk").distinct())
    if twins is None:
        return rows.select(*names, F.transform(chunks(F.col(text_col)), lambda c: identify(c)).alias("recipe"))
    # A hash stands for several chunks: each identifier becomes two longs, the hash and the chunk's number.
    held = rows.select(F.struct(*names).alias("row"), F.monotonically_increasing_id().alias("own"), chunks(F.col(text_col)).alias("chunks"))
    each = held.select("own", F.posexplode("chunks").alias("place", "chunk")).withColumn("h", identify(F.col("chunk")))
    table = F.broadcast(twins) if twins.count() <= FEW else twins
    told = each.join(table, ["h", "chunk"], "left").select("own", F.struct("place", "h", F.coalesce("number", F.lit(0)).cast("long").alias("number")).alias("part"))
    lists = told.groupBy("own").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    listed = F.flatten(F.transform("parts", lambda p: F.array(p["h"], p["number"])))
    joined = held.drop("chunks").join(lists, "own", "left")
    return joined.select(*[F.col("row")[c].alias(c) for c in names], F.coalesce(listed, F.array().cast("array<long>")).alias("recipe"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical; a null text counts as empty, and all empty texts are equal. The row with the
    largest id of equal texts stays; null ids come before all others, and of repeated rows with that id one stays.
    Columns of other names do not matter, whatever they are called. Very long texts are compared as lists of
    identifiers. A group may hold any share of the rows: groups are counted before they are shuffled, and only
    those of two rows or more are joined back, so that adaptive execution can split them. An empty table gives an
    empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = spread(docs.select(F.col(id_col).alias("id"), text.alias("text"))).select("id", F.sha2("text", 256).alias("digest"), "text")
    rows = written(recipes(base, "text", identify).withColumn("own", F.monotonically_increasing_id()))
    groups = rows.groupBy("recipe").agg(F.count("*").alias("n"), F.max(F.struct("id", "own")).alias("last")).where("n > 1")
    met = rows.join(written(groups), "recipe", "left")
    return met.select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("last")["id"]).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("own") == F.col("last")["own"], F.lit(True)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
