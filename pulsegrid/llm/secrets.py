"""Secret scans in Spark expressions only.

Base kinds are regular expressions. The entropy kinds slide a window over candidate strings of each
character class and keep the window's symbol counts and their sum of c*log2(c) up to date as one
symbol leaves and one enters; a string holds one character for each count, so a step rewrites two of them
whatever the window's width. Candidates on the allow-list and those that read as words or paths of words are
suppressed. All patterns are free of repeated groups, which Java matches recursively, and every step's
time is near linear in the text and in the number of its matches.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.store import spread
from pulsegrid.llm.arrays import let, offsets

SPAN = "array<struct<start:long,rank:int,end:long>>"
#: Symbols of a candidate whose codes are in memory at once; neighbouring pieces share a window less one symbol.
PIECE = 1 << 16
#: Stand-ins for what was found, of which a text that follows Unicode holds none.
NONCHARACTERS = ("﷐", "﷑", "﷒", "﷓")


@dataclass(frozen=True)
class Kind:
    """A base kind: ``group`` of every match must have ``least`` characters; ``hint`` is a cheaper necessary test."""

    name: str
    pattern: str
    group: int
    least: int
    hint: str


# A run of the class is matched whole, so a minimum in its quantifier drops exactly the shorter matches.
# That does not hold for assignments: a short match still uses up its text.
BASE = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"(?i:passw|secret|token|api_?key)"),
    Kind("access", r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA[A-Z0-9]{14}"),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
)


@dataclass(frozen=True)
class Alphabet:
    """A character class whose runs of ``window`` or more symbols are candidates; ``bits`` is the entropy to reach."""

    name: str
    symbols: str
    pattern: str
    window: int
    bits: float


#: Of random keys of 20 symbols, 0.3 % of hexadecimal and 0.1 % of base64 ones stay below these bits.
ALPHABETS = (
    Alphabet("entropy_hex", "0123456789abcdef", r"(?:(?<![A-Za-z0-9])|(?<=\b0[xX]))[0-9A-Fa-f]{20,}+(?![A-Za-z0-9])", 20, 2.8),
    Alphabet("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", r"[A-Za-z0-9+/_-]{20,}={0,2}", 20, 3.5),
)

#: Candidates that are no secrets: without letters, UUIDs, alphabets, samples. Words and paths of words are told by ``_words``.
ALLOWED = (
    r"^[^A-Za-z]*$",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(?i)0123456789|abcdefghij|example",
)
#: What reads as words: whole segments (letters of one case or capitalised with up to two digits, or a number), then humps of
#: segments without digits.
SEGMENT = r"(?<![A-Za-z0-9])(?:(?:[A-Z]?[a-z]++|[A-Z]++)[0-9]{0,2}|[0-9]++)(?![A-Za-z0-9])"
LETTERS, DIGITS = r"(?<![A-Za-z0-9])[A-Za-z]++(?![A-Za-z0-9])", r"(?<![A-Za-z0-9])[A-Za-z]*+[0-9][A-Za-z0-9]*+"
HUMP = r"[A-Z]?[a-z]{3,}+"


def _matches(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """(gap, hit, keep) for each match of a pattern and what lies before it; the last gap has no hit."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), parts.alias("part"))
    return F.transform(zipped, lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), (F.coalesce(F.length(x["part"]), F.lit(0)) >= least).alias("keep")))


def _placed(matches: Column) -> Column:
    """(start, end, hit) of the matches to keep, from the lengths of what lies between them."""

    def placed(m: Column) -> Column:
        starts = offsets(F.transform(m, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))))
        both = F.zip_with(m, starts, lambda x, at: F.struct((at + F.length(x["gap"])).alias("start"), (at + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), x["keep"].alias("keep")))
        return F.filter(both, lambda x: x["keep"])

    return let(matches, placed)


def _masked(matches: Column, fill: Column) -> Column:
    """The text with as many ``fill`` characters in place of each match to keep."""
    return F.array_join(F.transform(matches, lambda x: F.concat(x["gap"], F.when(x["keep"], F.repeat(fill, F.length(x["hit"]))).otherwise(F.coalesce(x["hit"], F.lit(""))))), "")


def _window(alphabet: Alphabet, piece: Column) -> Column:
    """(first, last) position in a piece of the windows that reach the class's entropy, or nulls."""
    w = alphabet.window
    gain = F.array(*[F.lit((c + 1) * log2(c + 1) - (c * log2(c) if c else 0.0)) for c in range(w)])
    codes = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(alphabet.symbols), c))
    start = F.struct(F.repeat(F.lit("0"), F.lit(len(alphabet.symbols) + 1)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def slide(acc: Column, pair: Column) -> Column:
        old, new = pair["old"], pair["new"]  # old is 0 until the window is full
        count = lambda code: F.ascii(F.substring(acc["counts"], code + 1, F.lit(1))) - 48
        left = F.when(old > 0, -F.element_at(gain, count(old))).otherwise(F.lit(0.0))
        total = acc["sum"] + left + F.element_at(gain, count(new) + 1)
        fewer = F.when(old > 0, F.overlay(acc["counts"], F.char(count(old) + 47), old + 1, F.lit(1))).otherwise(acc["counts"])
        counts = F.overlay(fewer, F.char(count(new) + 49), new + 1, F.lit(1))
        moved = old != new
        return F.struct(
            F.when(moved, counts).otherwise(acc["counts"]).alias("counts"),
            F.when(moved, total).otherwise(acc["sum"]).alias("sum"),
            (acc["at"] + 1).alias("at"),
            *ends(acc),
        )

    def ends(acc: Column) -> tuple[Column, Column]:  # of the symbols so far
        passed = (acc["at"] >= w) & (acc["sum"] <= w * (log2(w) - alphabet.bits))
        return F.when(passed, F.coalesce(acc["first"], acc["at"] - w)).otherwise(acc["first"]).alias("first"), F.when(passed, acc["at"] - 1).otherwise(acc["last"]).alias("last")

    def slid(c: Column) -> Column:
        before = F.concat(F.array_repeat(F.lit(0), w), F.slice(c, F.lit(1), F.greatest(F.size(c) - w, F.lit(0))))
        pairs = F.zip_with(c, before, lambda new, old: F.struct(new.alias("new"), old.alias("old")))
        return F.aggregate(pairs, start, slide, lambda acc: F.struct(*ends(acc)))

    return let(codes, slid)


def _entropy(alphabet: Alphabet, hit: Column) -> Column:
    """(first, last) position of a candidate's windows that reach the class's entropy, or nulls; long candidates go in pieces."""

    def pieces(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(h) - alphabet.window, F.lit(0)), F.lit(PIECE))
        each = lambda at: let(_window(alphabet, F.substring(h, at + 1, F.lit(PIECE + alphabet.window - 1))), lambda r: F.struct((at + r["first"]).alias("first"), (at + r["last"]).alias("last")))
        found = lambda p: F.struct(F.array_min(F.transform(p, lambda r: r["first"])).alias("first"), F.array_max(F.transform(p, lambda r: r["last"])).alias("last"))
        return let(F.transform(starts, each), found)

    return let(hit if alphabet.symbols.lower() != alphabet.symbols else F.lower(hit), pieces)


def _words(hit: Column) -> Column:
    """Whether four fifths of the letters and digits read as words and no run of 8 others is left."""
    chars = lambda c: F.length(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    parts = lambda left: F.struct(F.regexp_replace(left, LETTERS, "").alias("mixed"), F.regexp_replace(F.regexp_replace(left, DIGITS, ""), HUMP, "").alias("plain"))
    few = lambda p: (5 * (chars(p["mixed"]) + chars(p["plain"])) <= chars(hit)) & ~p["mixed"].rlike("[A-Za-z0-9]{8}") & ~p["plain"].rlike("[A-Za-z0-9]{8}")
    return let(let(F.regexp_replace(hit, SEGMENT, ""), parts), few)


def _told(alphabet: Alphabet, matches: Column, allowed: tuple[str, ...]) -> Column:
    """The candidates with their windows' ends; those on the allow-list, of words or of low entropy are not kept."""
    known = lambda hit: F.greatest(*[hit.rlike(a) for a in allowed], _words(hit), F.lit(False))
    none = F.struct(F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    ends = F.transform(matches, lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), F.when(x["keep"] & ~known(x["hit"]), _entropy(alphabet, x["hit"])).otherwise(none).alias("e")))

    def cut(x: Column) -> Column:  # what lies before the first window belongs to the gap, what follows the last one to a match not kept
        first, last = x["e"]["first"], x["e"]["last"]
        inner = F.struct(F.concat(x["gap"], F.substring(x["hit"], F.lit(1), first)).alias("gap"), F.substring(x["hit"], first + 1, last + 1 - first).alias("hit"), F.lit(True).alias("keep"))
        rest = F.struct(F.lit("").alias("gap"), F.substring(x["hit"], last + 2, F.length(x["hit"])).alias("hit"), F.lit(False).alias("keep"))
        return F.when(first.isNotNull(), F.array(inner, rest)).otherwise(F.array(F.struct(x["gap"].alias("gap"), F.coalesce(x["hit"], F.lit("")).alias("hit"), F.lit(False).alias("keep"))))

    return F.flatten(F.transform(ends, cut))


def _scan(rows: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """``rows`` (row, text, fill) with ``found``, the sorted spans, and ``masked``, the text with ``fill`` over all of them."""
    none = F.array().cast(SPAN)
    text, masked = F.col("text"), F.col("masked")
    spans = lambda matches, rank: F.transform(_placed(matches), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))
    rows = rows.withColumn("masked", text)
    for rank, kind in enumerate(BASE):
        found = _matches(text, kind.pattern, kind.group, kind.least)
        rows = rows.withColumn(kind.name, F.when(text.rlike(kind.hint), spans(found, rank)).otherwise(none))
        rows = rows.withColumn("masked", F.when(F.size(kind.name) > 0, _masked(_matches(masked, kind.pattern, kind.group, kind.least), F.col("fill"))).otherwise(masked))
    for rank, alphabet in enumerate(ALPHABETS, len(BASE)):
        told = F.when(masked.rlike(alphabet.pattern), _told(alphabet, _matches(masked, alphabet.pattern), allowed))
        rows = rows.withColumn("told", told)
        hit = F.exists("told", lambda x: x["keep"])
        rows = rows.withColumn(alphabet.name, F.when(hit, spans(F.col("told"), rank)).otherwise(none))
        rows = rows.withColumn("masked", F.when(hit, _masked(F.col("told"), F.col("fill"))).otherwise(masked)).drop("told")
    return rows.withColumn("found", F.sort_array(F.concat(*[k.name for k in (*BASE, *ALPHABETS)])))


def find_secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``secrets``: array of (start, kind, end), sorted; code points, end exclusive.

    Whole texts are scanned, however long; a null or empty text has none. Base kinds come first among equal
    starts, in the order of BASE. Candidates for entropy are looked for in what the kinds before leave: an
    entropy span runs from the first to the last window of a candidate that reaches its class's entropy,
    unless the candidate is on the allow-list or reads as words. All other columns and repeated rows stay as
    they are; a column named secrets is replaced. An empty table gives an empty one.
    """
    rows = spread(docs).select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.lit("\n").alias("fill"))
    names = F.array(*[F.lit(k.name) for k in (*BASE, *ALPHABETS)])
    secrets = F.transform("found", lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["rank"] + 1).alias("kind"), s["end"].alias("end")))
    return _scan(rows, allowed).select("row", secrets.alias("secrets")).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "secrets"], "secrets")


def listed(secrets: Column) -> Column:
    """kind:start:end of each span, joined with commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", allowed: tuple[str, ...] = ALLOWED, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with ``mark`` in place of the secrets found, spans that touch or overlap by one, and the length column updated.

    Kinds are replaced one after another, in the order of BASE and then of the classes: what an earlier kind
    leaves of a later kind's match goes if it is still a match. Rows without secrets stay as they are, null and
    empty texts and repeated rows among them. What was found is first covered by a noncharacter that the text
    does not hold; a text with secrets that holds all of NONCHARACTERS has its first one replaced by U+FFFD.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    free = F.coalesce(*[F.when(~F.contains(text, F.lit(c)), F.lit(c)) for c in NONCHARACTERS])
    rows = spread(docs).select(F.struct("*").alias("row"), text.alias("text"), free.alias("fill"))
    lost = F.when(F.col("fill").isNull(), F.replace("text", F.lit(NONCHARACTERS[0]), F.lit("\ufffd"))).otherwise(F.col("text"))
    rows = rows.withColumn("text", lost).withColumn("fill", F.coalesce("fill", F.lit(NONCHARACTERS[0])))
    quoted = mark.replace("\\", "\\\\").replace("$", "\\$")
    marked = F.regexp_replace("masked", F.concat("fill", F.lit("++")), F.lit(quoted))
    done = _scan(rows, allowed).select("row", F.when(F.size("found") > 0, marked).alias("new"))
    own = {c: F.col("row")[c] for c in docs.columns}
    own[text_col] = F.coalesce("new", own[text_col])
    if chars_col in own:
        own[chars_col] = F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema[chars_col].dataType)).otherwise(own[chars_col])
    return done.select(*[v.alias(c) for c, v in own.items()])
