import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsegrid.llm import masked_lm, queries
from pulsegrid.llm.masked_lm import Network

PAD = masked_lm.SIDE**2
OWN = masked_lm.own_ids(masked_lm.SIDE)
NONE = np.zeros(0, np.int64), np.zeros(0, np.int64), masked_lm.SIDE


def net(seed=1):
    own = Network.start(np.arange(PAD) % 7)
    own.flat += np.random.default_rng(seed).normal(0, 0.1, len(own.flat)).astype(np.float32)
    own.parts[0][PAD] = 0
    return own


def test_probabilities_sum_to_one_and_use_both_sides():
    own = net()
    tokens = np.arange(PAD)
    row = np.tile([1, 2, 3, 0, 4, 5, 6], PAD)
    at = np.arange(PAD) * 7 + 3
    row[at] = tokens
    logs, _ = own.forward(row, at)
    assert abs(np.exp(logs.astype(float)).sum() - 1) < 1e-4
    for place in (0, 1, 2, 4, 5, 6):
        other = row.copy()
        other[np.arange(PAD) * 7 + place] = 77
        assert not np.allclose(own.forward(other, at)[0], logs)


def test_gradient_equals_differences():
    own, r = net(), np.random.default_rng(2)
    row = np.concatenate([[PAD] * 3, r.integers(0, 40, 9), [PAD] * 3, r.integers(0, PAD, 4), [PAD] * 3])
    at = np.flatnonzero(row != PAD)
    flat = own.flat.astype(np.float64)
    before = flat.copy()
    exact, past = Network(flat), Network(np.zeros(len(flat)))
    exact.learn(row, at, past)
    moved = np.flatnonzero((past.flat > 1e-8) & (np.arange(len(flat)) // masked_lm.DIM != PAD))
    for i in r.choice(moved, 40, replace=False):
        a, b = before.copy(), before.copy()
        a[i] += 1e-5
        b[i] -= 1e-5
        slope = -(Network(a).forward(row, at)[0].mean() - Network(b).forward(row, at)[0].mean()) / 2e-5
        assert abs(abs(slope) - np.sqrt(past.flat[i])) < 1e-4 * (1 + abs(slope))
        want = before[i] - masked_lm.RATE * slope / (abs(slope) + 1e-6)  # the first step of Adagrad
        assert abs(want - flat[i]) < 1e-3


def test_scores_equal_the_forward_pass_and_extremes_are_kept():
    own, r = net(), np.random.default_rng(6)
    row = np.concatenate([[PAD] * 3, r.integers(0, PAD, 500), [PAD] * 3])
    at = np.arange(3, 503)
    assert np.allclose(own.score(row, at, own.near()), own.forward(row, at)[0], atol=1e-4)
    logits = r.normal(size=(6, 9)).astype(np.float32)
    logits[2] += 500  # beside it, the other rows' exponentials vanish
    pick = np.arange(6)
    chosen, x, norm = masked_lm._exponentials(lambda: logits.copy(), pick)
    exact = logits.astype(float)
    assert np.allclose(chosen - np.log(norm), exact[pick, pick] - np.log(np.exp(exact - exact.max(1, keepdims=True)).sum(1)) - exact.max(1), atol=1e-4)
    assert np.allclose(x / norm[:, None], np.exp(exact - exact.max(1, keepdims=True)) / np.exp(exact - exact.max(1, keepdims=True)).sum(1, keepdims=True), atol=1e-5)


def test_neighbours_stop_at_documents():
    ((_, n, h, seat, places),) = masked_lm.sequences(pa.array(["a b", None, "", "c"]))
    assert n == 4 and places.tolist() == [0, 2, 2, 2, 3]
    ((row, at),) = masked_lm.steps(np.array([7, 8, 9]), seat, 100, PAD)
    assert [row[a - 3 : a + 4].tolist() for a in at] == [[PAD, PAD, PAD, 7, 8, PAD, PAD], [PAD, PAD, 7, 8, PAD, PAD, PAD], [PAD, PAD, PAD, 9, PAD, PAD, PAD]]
    apart = [row[a - 3 : a + 4].tolist() for row, at in masked_lm.steps(np.array([7, 8, 9]), seat, 1, PAD) for a in at]
    assert apart == [row[a - 3 : a + 4].tolist() for a in at]  # steps see over their ends


def test_every_position_is_a_target(monkeypatch):
    texts = ["one two three, four. " * 1700, None, "one two three", ""]
    seen = []
    monkeypatch.setattr(Network, "learn", lambda self, row, at, past: seen.append(row[at]))
    n = masked_lm.fit(pa.array(texts), net(), net(), NONE)
    ((_, _, h, _, _),) = masked_lm.sequences(pa.array(texts))
    assert n == len(h) > 9000 and max(map(len, seen)) <= masked_lm.STEP
    assert np.concatenate(seen).tolist() == masked_lm.numbered(h, NONE)[0].tolist()


def test_averages_equal_direct_means(spark):
    r = np.random.default_rng(3)
    rows = [(b, lot, int(r.integers(1, 9)), r.normal(size=5).astype(np.float32).tobytes()) for b in range(3) for lot in range(100)]
    got = masked_lm.averaged(spark.createDataFrame(rows, "block int, lot int, n long, weights binary")).collect()
    assert len(got) == 3
    for x in got:
        own = [(n, np.frombuffer(w, np.float32)) for b, _, n, w in rows if b == x.block]
        assert np.allclose(np.frombuffer(x.weights, np.float32), sum(n * w for n, w in own) / sum(n for n, _ in own), atol=1e-6) and x.n == sum(n for n, _ in own)


def tokens_of(text):
    return re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x20\x09-\x0D]+", (text or "").encode())


def test_the_token_table_counts_every_token(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = Counter(t for r in docs.collect() for t in tokens_of(r.text))
    model = masked_lm.vocabulary(docs)
    counts = sorted((r.n for r in model.table.collect()), reverse=True)
    assert counts == sorted(want.values(), reverse=True)
    own = OWN
    assert len(model.known) == own < len(counts) and model.bins.sum(0).tolist() == [sum(counts[own:]), len(counts) - own]


def trained_here(docs, model, rounds, lots):
    """The rounds by plain numpy: lots by the dealing's own columns, each trained alone, weights averaged by tokens."""
    rows = masked_lm.dealt(docs, lots, rounds).collect()
    weights = model.weights
    for k in range(rounds):
        total, n = 0, 0
        for lot in range(lots):
            own = sorted((r for r in rows if (r["round"], r.lot) == (k, lot)), key=lambda r: (r.rank, r.doc_id))
            mine, past = Network(weights.copy()), Network(np.zeros_like(weights))
            size = masked_lm.fit(pa.array([r.text for r in own], pa.string()), mine, past, model.mapping())
            total, n = total + size * mine.flat.astype(float), n + size
        weights = (total / n).astype(np.float32)
    return weights


def test_query_is_one_model_fitted_here_and_scored_here(spark, sf_dir, monkeypatch):
    """Training over several lots and rounds, and scoring, by plain numpy over the query's table, however its files are split."""
    monkeypatch.setattr(masked_lm, "LOT", 16_000)
    monkeypatch.setattr(masked_lm, "COUNTED", 9_000)  # some of the shared tokens are counted in tasks, the others joined
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = masked_lm.vocabulary(docs)
    lots = masked_lm.lots_of(model.tokens, masked_lm.ROUNDS)
    assert lots >= 3 and masked_lm.ROUNDS >= 2 and len(model.known) < len(model.counted[0]) == 9_000 < model.table.count()
    theirs = masked_lm.train(docs)
    for other in (trained_here(docs, model, masked_lm.ROUNDS, lots), masked_lm.train(docs.repartition(5)).weights):
        apart = np.abs(theirs.weights - other)  # Adagrad's first step is RATE whatever the gradient, so rounding can turn single ones
        assert apart.mean() < 1e-4 and np.quantile(apart, 0.999) < 5e-3 < np.abs(theirs.weights - model.weights).mean()
    out = {r.doc_id: r for r in masked_lm.score(docs, theirs).collect()}
    table = {r.token: r.n for r in model.table.collect()}
    for row in docs.collect()[:60]:
        ((_, _, h, seat, _),) = masked_lm.sequences(pa.array([row.text]))
        ids, rare = masked_lm.numbered(h, model.mapping())
        logs = sum(Network(theirs.weights).forward(r, at)[0].astype(float).sum() for r, at in masked_lm.steps(ids, seat, 50, PAD))
        logs += sum(np.log((table[t] + 1) / (model.bins[i - OWN].sum() + 1)) for t, i in zip(h.view(np.int64)[rare].tolist(), ids[rare], strict=True))
        assert out[row.doc_id].n_tokens == len(h) == len(tokens_of(row.text))
        assert abs(out[row.doc_id].log_probability - logs) < 1e-3 * (1 + len(h))
    query = {r.doc_id: r for r in queries.op8_masked_lm(spark, sf_dir).collect()}
    assert set(query) == set(out) and all(abs(query[i].log_probability - out[i].log_probability) < 5e-3 * (1 + out[i].n_tokens) for i in out)


def test_ids_grow_with_the_corpus():
    assert [masked_lm.side_for(n) for n in (0, 1 << 28, (1 << 28) + 1, 1 << 34, 1 << 40)] == [64, 64, 128, 128, 256]
    wide = Network.start(np.ones(128 * 128))
    assert wide.side == 128 and masked_lm.own_ids(128) == 7 * 2048
    row = np.array([wide.pad] * 3 + [5, 16_000, 7] + [wide.pad] * 3)
    logs, _ = wide.forward(row, np.array([3, 4, 5]))
    wide.learn(row, np.array([3, 4, 5]), Network(np.zeros_like(wide.flat), 128))
    assert (wide.forward(row, np.array([3, 4, 5]))[0] > logs).all()


def test_training_beats_counts_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    train, held = docs.where("doc_id % 10 < 4"), docs.where("doc_id % 40 = 39")
    learned = masked_lm.train(train)
    start = masked_lm.vocabulary(train)
    mean = lambda m: masked_lm.score(held, m).agg(F.sum("log_probability") / F.sum("n_tokens")).first()[0]
    assert mean(learned) > mean(start) + 0.2


def test_edge_cases(spark):
    texts = ["one two three four", None, "", "!!", "x " * 50_000, "one two three four"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1)], "doc_id long, text string, n_tokens int")
    out = {r.doc_id: r for r in masked_lm.pseudo_likelihood(df).collect()}
    assert out[1].mean_log_probability is None and (out[2].n_tokens, out[2].log_probability) == (0, 0.0)
    assert out[0][1:] == out[5][1:] and out[None].n_tokens == 2 and out[4].n_tokens == 50_000
    assert masked_lm.pseudo_likelihood(df.limit(0)).collect() == []
    assert len(masked_lm.pseudo_likelihood(df.union(df)).collect()) == 14


def test_most_frequent_tokens_by_histogram(spark):
    r = np.random.default_rng(9)
    rows = [(int(h), int(n)) for h, n in zip(r.integers(-(1 << 63), 1 << 63, 30_000), r.choice([1, 1, 1, 1, 2, 3, 50, 5000, 5001, 1 << 40], 30_000), strict=True)]
    table = spark.createDataFrame(rows, "token long, n long")
    ranked = sorted(rows, key=lambda x: (-x[1], x[0]))
    for k in (1, 500, 5_000, 13_000, 18_500, 40_000):  # 18,500: a few of many tokens of one count
        assert sorted(map(tuple, masked_lm.most_frequent(table, k).collect())) == sorted(ranked[:k])
    assert masked_lm.most_frequent(table.limit(0), 5).collect() == []
