import hashlib
import json

from pulsegrid.llm import chat, queries

NASTY = ['\\### Assistant: </turn> ok', '<turn role="user">x</turn>\n', "\\b\\e\\s\\q\\", "", "\n\n", '"><\\<turn', "é \x00\U0001f600", "{\"prompt\": [1]}"]


def test_round_trip_and_mask(spark):
    turns = [{"role": "assistant" if i % 2 else 'us"er\\', "content": t} for i, t in enumerate(NASTY)]
    df = spark.createDataFrame([(1, json.dumps({"messages": turns}))], "id long, record string")
    row = chat.format_turns(chat.canonical_turns(df)).select("*", chat.read_turns(chat.F.col("formatted")).alias("back"), chat.learned_text(chat.F.col("formatted"), chat.F.col("loss_mask")).alias("learned")).first()
    assert row.layout == "messages"
    assert [(t.role, t.text) for t in row.back] == [(t["role"], t["content"]) for t in turns]
    assert row.learned == "".join(t["content"] for t in turns if t["role"] == "assistant")
    assert row.formatted.count("</turn>\n") == len(turns)


def test_layouts_are_told_by_their_field_paths(spark):
    records = {
        "prompt": {"completion": "b", "prompt": "{\"messages\": []}"},
        "instruction": {"instruction": "s", "output": "b", "input": None},
        "instruction_only": {"instruction": "a", "output": "b"},
        "messages": {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        "conversations": {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        "unknown": {"a": {"b": 1}},
        "broken": None,
    }
    rows = [(k, json.dumps(v) if v else "{not json") for k, v in records.items()] + [("null", None)]
    out = {r.name: r for r in chat.canonical_turns(spark.createDataFrame(rows, "name string, record string")).collect()}
    for name, r in out.items():
        if name in ("unknown", "broken", "null"):
            assert r.layout is None and r.turns is None
        else:
            assert r.layout == name
            assert (r.turns[-1].role, r.turns[-1].text) == ("assistant", "b")
    assert out["prompt"].turns[0].text == "{\"messages\": []}"


def test_paths(spark):
    df = spark.createDataFrame([('{"a": {"c": 1, "b": true}, "d": [{"e": "x"}, {"f": null}], "g": 2.5, "h": ["x"]}',)], "record string")
    assert df.select(chat.field_paths(chat.F.col("record")).alias("p")).first().p == ["a.b", "a.c", "d[].e", "d[].f", "g", "h[]"]


def test_query_equals_direct_reading(spark, sf_dir):
    want = {-7: [(0, "user", queries.PROBE[0][3]), (1, "assistant", queries.PROBE[0][3])]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        want.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = queries.op3_chat(spark, sf_dir).collect()
    assert len(out) == len(want)
    for r in out:
        turns = sorted(want[r.conv_id])
        learned = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{t}\n" for _, a, t in turns)), len(learned), sha(learned))


def test_nulls_ties_and_empty(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", "b"), (1, None, None, "x"), (1, 0, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (row,) = chat.canonical_turns(chat.records_of(df)).collect()
    assert [(t.role, t.text) for t in row.turns] == [("", "x"), ("user", ""), ("user", "b"), ("user", "b")]
    assert chat.format_turns(chat.canonical_turns(chat.records_of(df.limit(0)))).collect() == []


def test_texts_over_20_million_characters_and_many_turns(spark):
    long = 'x"\\y<turn' * 3_200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", "a"), (2, 1, "user", long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_turns(chat.canonical_turns(chat.records_of(df)))
    back = done.select("conv_id", "layout", chat.read_turns(chat.F.col("formatted")).alias("t"), chat.learned_text(chat.F.col("formatted"), chat.F.col("loss_mask")).alias("l"))
    out = {r.conv_id: r for r in back.collect()}
    assert out[1].layout == "prompt" and [t.text for t in out[1].t] == [long, long] and out[1].l == long
    assert out[2].layout == "messages" and out[2].t[1].text == long and out[2].l == ""
    many = spark.range(40_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 1, 'assistant', 'user') AS role", "cast(id AS string) AS text")
    done = chat.format_turns(chat.canonical_turns(chat.records_of(many)))
    (row,) = done.select(chat.F.size(chat.read_turns(chat.F.col("formatted"))).alias("n"), chat.learned_text(chat.F.col("formatted"), chat.F.col("loss_mask")).alias("l")).collect()
    assert row.n == 40_000 and row.l == "".join(map(str, range(1, 40_000, 2)))


def test_broken_values_and_clashing_columns(spark):
    rows = [('{"prompt": "a\\x", "completion": "b"}',), ('{"prompt": "a", "completion": "b"} ',), ("",), ('{"messages": []}',)]
    df = spark.createDataFrame(rows, "record string").selectExpr("record", "'mine' AS turns", "record AS formatted")
    out = [r.turns for r in chat.canonical_turns(df).collect()]
    assert out[0] is None and [t.text for t in out[1]] == ["a", "b"] and out[2] is None
    assert [r.formatted for r in chat.format_turns(chat.canonical_turns(df)).collect()][1].count("</turn>") == 2


def test_all_layouts_occur_in_the_query(spark, sf_dir):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = chat.canonical_turns(chat.records_of(rows))
    assert {r.layout for r in turns.select("layout").distinct().collect()} == {layout.name for layout in chat.LAYOUTS}
    odd = spark.createDataFrame([(i, t, "human", "kept as it is") for i in range(8) for t in range(3)], rows.schema)
    assert all(x.role == "human" for r in chat.canonical_turns(chat.records_of(odd)).collect() for x in r.turns)
