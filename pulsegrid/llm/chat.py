"""Chat formatting in Spark expressions only.

Records of different layouts arrive as JSON text. A record's nested field paths are hashed, and the
hash selects a declarative mapping that turns the record into canonical turns (role, text). Canonical
turns are then written with one template, which escapes its own control strings inside texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.arrays import offsets

#: Spark's JSON reader refuses longer strings; by default it does from 20 million characters on.
LONGEST = {"maxStringLen": str((1 << 31) - 1)}
#: A JSON string: a field's name with its colon, or a value's two quotes without what is between.
STRINGS = r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:)|(")[^"\\]*+(?:\\.[^"\\]*+)*+(")'
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout and where its turns are.

    ``fields`` are (role, JSON path) pairs; ``each`` is (path of an array, role field, text field).
    ``roles`` renames a layout's roles.
    """

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.paths)).encode()).hexdigest()


LAYOUTS = (
    Layout("prompt", ("completion", "prompt"), fields=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("instruction", ("input", "instruction", "output"), fields=(("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Layout("instruction_only", ("instruction", "output"), fields=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("messages", ("messages[].content", "messages[].role"), each=("$.messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), each=("$.conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
)


def field_paths(record: Column) -> Column:
    """Sorted distinct nested field paths of a JSON record: a.b for objects, a[].b for arrays of objects.

    They are read off the record's variant schema, such as OBJECT<m: ARRAY<OBJECT<b: STRING>>>. Two levels
    below the top are told apart, which every declared layout needs at most. Null if it is no JSON object.
    Strings are emptied first, so that a long text is no part of the variant.
    """
    schema = F.schema_of_variant(F.try_parse_json(F.regexp_replace(record, STRINGS, "$1$2$3")))
    inner = F.regexp_extract(schema, r"^OBJECT<(.*)>$", 1)
    # scalar types go, then every nested list of fields is spread over its parent's name
    bare = F.regexp_replace(inner, r": (STRING|VOID|BIGINT|DOUBLE|BOOLEAN|DECIMAL\(\d+,\d+\)|DATE|TIMESTAMP(_NTZ)?|FLOAT|BINARY)", "")
    nested = F.regexp_extract_all(bare, F.lit(r"([^,<>: ]+: (?:ARRAY<OBJECT|OBJECT)<[^<>]*>|[^,<>: ]+(?:: ARRAY<[A-Z]*>)?)"), F.lit(1))

    def spread(part: Column) -> Column:
        head = F.substring_index(part, ":", 1)
        array = part.contains(": ARRAY<OBJECT<")
        below = F.split(F.regexp_extract(part, r"OBJECT<([^<>]*)>", 1), ", ")
        return F.when(array | part.contains(": OBJECT<"), F.transform(below, lambda b: F.concat(head, F.when(array, F.lit("[].")).otherwise(F.lit(".")), b))).otherwise(F.array(F.concat(head, F.when(part.contains(": ARRAY<"), F.lit("[]")).otherwise(F.lit("")))))

    return F.when(schema.startswith("OBJECT<"), F.array_sort(F.array_distinct(F.flatten(F.transform(nested, spread)))))


def fingerprint(record: Column) -> Column:
    """SHA-256 of the record's sorted field paths, one a line."""
    return F.sha2(F.array_join(field_paths(record), "\n"), 256)


def _mapped(layout: Layout, record: Column) -> Column:
    broken = {**LONGEST, "columnNameOfCorruptRecord": "_broken"}
    if layout.each:
        path, role, text = layout.each
        field = path.removeprefix("$.")
        row = F.from_json(record, f"`{field}` array<struct<`{role}`:string,`{text}`:string>>, _broken string", broken)
        turns = F.transform(row[field], lambda r: F.struct(F.coalesce(r[role], F.lit("")).alias("role"), F.coalesce(r[text], F.lit("")).alias("text")))
    else:
        names = {path: path.removeprefix("$.") for _, path in layout.fields}
        row = F.from_json(record, ", ".join(f"`{n}` string" for n in [*names.values(), "_broken"]), broken)
        turns = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(row[names[path]], F.lit("")).alias("text")) for role, path in layout.fields])
    turns = F.when(row["_broken"].isNull(), turns)
    if layout.roles:
        names = F.create_map(*[F.lit(n) for pair in layout.roles for n in pair])
        turns = F.transform(turns, lambda t: F.struct(F.coalesce(F.try_element_at(names, t["role"]), t["role"]).alias("role"), t["text"].alias("text")))
    return turns


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with ``layout`` (name, null if no mapping has the fingerprint) and ``turns``, in place of the record.

    Null and empty records, broken JSON and unknown layouts get null turns: they are kept for inspection, not
    dropped. Texts may be as long as a row can be. Repeated rows give equal rows; other columns stay as they are,
    those named layout or turns are replaced, and an empty table gives an empty one.
    """
    printed = records.withColumn("_fingerprint", fingerprint(F.col(record_col)))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        same = F.col("_fingerprint") == layout.fingerprint
        name, turns = F.when(same, F.lit(layout.name)).otherwise(name), F.when(same, _mapped(layout, F.col(record_col)).cast(TURNS)).otherwise(turns)
    return printed.select(*[c for c in records.columns if c not in (record_col, "layout", "turns")], name.alias("layout"), turns.alias("turns"))


OPEN, ROLE_END, CLOSE = '<turn role="', '">', "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    """Backslashes and the template's control strings become backslash codes, so none is left in a text."""
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("</turn"), F.lit("\\e")), F.lit("<turn"), F.lit("\\s"))
    return F.replace(out, F.lit('"'), F.lit("\\q")) if role else out


def unescape(text: Column) -> Column:
    """The reverse of ``escape``; every backslash of an escaped text begins a code, so the order is free but for \\b last."""
    for code, plain in (("\\q", '"'), ("\\s", "<turn"), ("\\e", "</turn"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turns(turns: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``turns`` with ``formatted`` (text) and ``loss_mask`` (spans of it, in code points, that are learned).

    Each turn becomes <turn role="ROLE">TEXT</turn> and a line break. Null turns give a null text; an empty
    list gives an empty one. Texts may be as long as a row can be; repeated rows give equal rows, other columns
    stay as they are, those named formatted or loss_mask are replaced, and an empty table gives an empty one.
    """
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"], True), F.lit(ROLE_END)).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*learned).alias("learn")))
    rows = turns.withColumn("_pieces", pieces)
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    rows = rows.withColumn("_starts", offsets(F.transform("_pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE))))

    def body(p: Column, at: Column) -> Column:
        start = at + F.length(p["head"])
        return F.struct(start.alias("start"), (start + F.length(p["body"])).alias("end"), p["learn"].alias("learn"))

    bodies = F.filter(F.zip_with("_pieces", "_starts", body), lambda b: b["learn"])
    mask = F.transform(bodies, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
    return rows.select(*[c for c in turns.columns if c not in ("formatted", "loss_mask")], text.alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns written in a formatted text."""
    pieces = F.split(formatted, CLOSE.replace("\n", r"\n"), -1)
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substring(piece, len(OPEN) + 1, 1 << 30), ROLE_END, 1)
        return F.struct(unescape(role).alias("role"), unescape(piece.substr(F.length(role) + len(OPEN) + len(ROLE_END) + 1, F.length(piece))).alias("text"))

    return F.transform(whole, turn)


def learned_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss_mask, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation's rows by turn as one JSON record, in a layout its roles fit.

    A user's and an assistant's turn become a prompt record or an instruction without input, by the conversation's
    hash; with a system's turn before they become an instruction. Others become messages or, by the hash and if no
    role would be renamed, conversations. Null texts and roles are empty; rows with equal turns follow by role and
    text; a null turn comes first. A conversation is one record and so one row, however long.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    roles, text = F.col("rows")["role"], lambda i: F.col("rows")[i]["content"]
    is_of = lambda *names: roles == F.array(*[F.lit(n) for n in names])
    even = F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0
    messages = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content")))
    renamed = F.create_map(*[F.lit(n) for n in ("user", "human", "assistant", "gpt", "system", "system")])
    said = F.transform("rows", lambda r: F.struct(F.try_element_at(renamed, r["role"]).alias("from"), r["content"].alias("value")))
    plain = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
    record = (
        F.when(is_of("user", "assistant") & even, F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(is_of("user", "assistant"), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output"))))
        .when(is_of("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output"))))
        .when(even & plain, F.to_json(F.struct(said.alias("conversations"))))
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return whole.select("conv_id", record.alias("record"))
