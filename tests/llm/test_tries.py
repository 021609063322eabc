import hashlib
import random
import zlib

import pytest

from pulsegrid.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, group=100, heads=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads if heads else 0
        base = c - (c % group if c >= 0 else -(-c % group))
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    kids, below = {}, {n: [0, 0] for n in nodes}
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], set()).add(n)
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            below[n[:d]][0] += n not in kids
            below[n[:d]][1] += (len(members) - 1) * (len(n[-1][1]) if n else 0)
    out = []
    for n, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if built[c] == n)))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids.get(n, ())), *below[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, **kw):
    out = tries.prefix_trie(spark.createDataFrame(rows, SCHEMA), **kw)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def conversations(seed, n=260):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 500), n):
        rows += [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["", "a", "bé", "ccc", None])) for t in range(r.choice([1, 2, 3, 8]))]
    return rows


@pytest.mark.parametrize("heads", [6, 0, 2])
def test_equals_a_plain_trie(spark, heads):
    rows = conversations(heads)
    assert trie(spark, rows, heads=heads) == brute(rows, heads=heads)


def test_one_long_conversation_over_many_lots_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(tries, "PIECE", 50)
    r = random.Random(4)
    long = [(100, t, "user", f"t{t // 3}") for t in range(900)] + [(101, t, "user", f"t{t // 3}") for t in range(700)]
    copies = [(c, t, "user", f"copy {t}") for c in range(1000, 1400) for t in range(3)]
    rows = long + copies + conversations(9, 30)
    r.shuffle(rows)
    assert trie(spark, rows, heads=0) == brute(rows, heads=0)


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "user", "lost with its head") for c in range(1, 60)]  # no conversation 0, so short ones are emptied
    out = trie(spark, rows)
    root = next(r for r in out if r[1] == 0)
    assert out == brute(rows) and root[3] == 59 and root[7] != hashlib.sha256(b"").hexdigest()


def test_edge_cases(spark):
    rows = [(None, 0, "user", "no conversation"), (1, 5, "user", "x" * 200_000), (1, 5, "user", "x" * 200_000), (2, None, None, None), (2, 5, "user", "y")]
    assert trie(spark, rows, heads=0) == brute(rows, heads=0)
    df = spark.createDataFrame(rows, SCHEMA)
    assert tries.prefix_trie(df.limit(0)).collect() == []
    extra = tries.prefix_trie(df.selectExpr("*", "1 AS lot", "2 AS depth", "3 AS digest", "4 AS key"), heads=0)
    assert sorted((tuple(r) for r in extra.collect()), key=str) == brute(rows, heads=0)
