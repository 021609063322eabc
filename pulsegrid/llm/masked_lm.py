"""Masked pseudo-likelihood of documents under a bidirectional window network.

Tokens (words and runs of marks) are predicted from the WINDOW tokens on each side. What is gathered from
the corpus grows with it: a table of every distinct token's count. Of a network's side * side ids, whose number
follows the corpus's size (see ``side_for``), seven in eight go to the most frequent tokens; all others share the
rest by hash. The network multiplies each neighbour's embedding by its place's matrix, passes the sum through tanh,
and predicts the token's class and then its member of the class; output biases start at the corpus's own counts. The inputs never hold the token itself, so every position of
every document is a target. A token of a bin is then told from the others of its bin by its
share of the bin's counts, joined from the table. A document's score is the sum over all positions of the log
probability of its token given both sides (Wang and Cho, 2019; Salazar et al., 2020).

Rows are dealt by hash to lots of about LOT tokens, and lots to rounds, so each position is trained on once. A round
trains each of its lots from the weights of the round before, and averages the weights by the number of tokens. Lots,
their order and the averages follow from the rows alone, not from files or machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import hashing
from pulsegrid.llm.store import partitions, spread, written

WINDOW, DIM = 3, 16
#: Classes of the smallest network, and members of each; one id in so many is shared.
SIDE, SHARED = 64, 8
#: Learning rate, tokens in a step, weights in one averaged block, and partial means of a block.
RATE, STEP, BLOCK, LOTS = 0.15, 4096, 8192, 32
#: Counts of so many tokens go to every task; those of rarer ones are joined.
COUNTED = 1 << 17
#: Tokens of a lot, at least, lots of a round, at most, and rounds.
LOT, MOST_LOTS, ROUNDS = 1 << 19, 1 << 16, 2
PLACES = [k for k in range(-WINDOW, WINDOW + 1) if k]


def side_for(tokens: int) -> int:
    """Classes, and members of each, for a corpus: ids grow with the cube root of its tokens, four times as many at a time."""
    side = SIDE
    while tokens > 1 << 28:
        side, tokens = 2 * side, tokens >> 6
    return side


def own_ids(side: int) -> int:
    return side * side - side * side // SHARED


def shapes(side: int) -> tuple[tuple[int, ...], ...]:
    """Embeddings, places' matrices, their bias, class outputs, class biases, class inputs, member outputs, and their biases."""
    return (side * side + 1, DIM), (len(PLACES) * DIM, DIM), (DIM,), (DIM, side), (side,), (side, DIM), (DIM, side), (side, side)


#: Sums of exponentials from here on are taken as they are; a smaller one is worked out from its own row's maximum.
SMALLEST = 1e-25


def _exponentials(logits, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of logits() less a maximum: the picked column of each row, all exponentials, and each row's sum of them."""
    x = logits()
    flat = np.arange(len(pick)) * x.shape[1] + pick
    x -= x.max(initial=0)  # one maximum for all rows is cheap
    chosen = x.reshape(-1).take(flat)
    np.exp(x, out=x)
    norm = x @ np.ones(x.shape[1], x.dtype)
    if len(norm) and norm.min() < SMALLEST:
        x = logits()
        x -= x.max(1, keepdims=True)
        chosen = x.reshape(-1).take(flat)
        np.exp(x, out=x)
        norm = x.sum(1)
    return chosen, x, norm


def _plus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x += y
    return x


class Network:
    """The weights of ``shapes``, in one flat array."""

    def __init__(self, flat: np.ndarray, side: int = SIDE) -> None:
        self.flat, self.side, self.pad, self.parts, at = flat, side, side * side, [], 0
        for shape in shapes(side):
            n = int(np.prod(shape))
            self.parts.append(flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Small fixed random weights, and biases that give the counts' own distribution; counts: side * side of them."""
        side = round(len(counts) ** 0.5)
        flat = np.zeros(sum(int(np.prod(s)) for s in shapes(side)), np.float32)
        net, rng = cls(flat, side), np.random.default_rng(7)
        for i, scale in ((0, 0.3), (1, 0.25), (3, 0.1), (5, 0.1), (6, 0.1)):
            net.parts[i][:] = rng.normal(0, scale, net.parts[i].shape)
        net.parts[0][net.pad] = 0  # beyond a document's ends
        share = (counts.reshape(side, side) + 1.0) / (counts.sum() + side * side)
        net.parts[4][:], net.parts[7][:] = np.log(share.sum(1)), np.log(share / share.sum(1, keepdims=True))
        return net

    def near(self) -> np.ndarray:
        """What each token's embedding adds to the hidden sum at each place beside it: fixed weights need this once."""
        emb, mix = self.parts[:2]
        return np.stack([emb @ mix[i * DIM : (i + 1) * DIM] for i in range(len(PLACES))])

    def score(self, row: np.ndarray, at: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Log probabilities of the tokens at some places of a padded row; ``near`` is that of the weights."""
        total = near[0].take(row.take(at + PLACES[0]), 0)
        for table, k in zip(near[1:], PLACES[1:], strict=True):
            total += table.take(row.take(at + k), 0)
        total += self.parts[2]
        return self._read(np.tanh(total, out=total), row.take(at))[0]

    def _read(self, hidden: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
        """Log probabilities, joint inputs, classes and members of tokens, and both outputs as (exponentials, their sums)."""
        out, out_bias, inner, last, last_bias = self.parts[3:]
        group, member = token // self.side, token % self.side
        joint = inner.take(group, 0)
        joint += hidden
        logs, both = np.zeros(len(token), hidden.dtype), []
        for logits, pick in ((lambda: _plus(hidden @ out, out_bias), group), (lambda: _plus(joint @ last, last_bias.take(group, 0)), member)):
            chosen, exponentials, norm = _exponentials(logits, pick)
            logs += chosen - np.log(norm)
            both.append((exponentials, norm))
        return logs, joint, group, member, both

    def forward(self, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Log probabilities of the tokens at some places of a padded row, and what the gradient needs."""
        emb, mix, bias = self.parts[:3]
        x = emb.take(row, 0)
        near = np.empty((len(at), len(PLACES) * DIM), x.dtype)
        for i, k in enumerate(PLACES):
            near[:, i * DIM : (i + 1) * DIM] = x.take(at + k, 0)
        hidden = _plus(near @ mix, bias)
        np.tanh(hidden, out=hidden)
        logs, joint, group, member, both = self._read(hidden, row.take(at))
        return logs, (near, hidden, joint, group, member, both)

    def learn(self, row: np.ndarray, at: np.ndarray, past: Network) -> None:
        """One step of Adagrad; ``past`` holds the squared gradients so far."""
        _, (near, hidden, joint, group, member, both) = self.forward(row, at)
        rows, n = np.arange(len(at)), len(at)
        for (grad, norm), pick in zip(both, (group, member), strict=True):  # of the mean loss: probabilities, less one where the token is
            grad *= (1 / (norm * n))[:, None]
            grad[rows, pick] -= 1 / n
        of_class, of_member = both[0][0], both[1][0]
        mix, out, last = self.parts[1], self.parts[3], self.parts[6]
        to_joint = of_member @ last.T
        to_total = (of_class @ out.T + to_joint) * (1 - hidden * hidden)
        spaced = np.zeros((len(row), DIM), near.dtype)
        spaced[at] = to_total
        to_x = np.zeros((len(row), DIM), near.dtype)
        for i, k in enumerate(PLACES):  # seats are WINDOW away from either end
            own = spaced @ mix[i * DIM : (i + 1) * DIM].T
            to_x[max(k, 0) : len(row) + min(k, 0)] += own[max(-k, 0) : len(row) - max(k, 0)]
        for i, grad in ((1, near.T @ to_total), (2, to_total.sum(0)), (3, hidden.T @ of_class), (4, of_class.sum(0)), (6, joint.T @ of_member)):
            self._step(i, slice(None), grad, past)
        self._sparse(group, ((5, to_joint), (7, of_member)), past)
        self._sparse(row, ((0, to_x),), past)
        self.parts[0][self.pad] = 0

    def _step(self, i: int, at, grad: np.ndarray, past: Network) -> None:
        past.parts[i][at] += grad * grad
        self.parts[i][at] -= RATE * grad / (np.sqrt(past.parts[i][at]) + 1e-6)

    def _sparse(self, ids: np.ndarray, grads: tuple[tuple[int, np.ndarray], ...], past: Network) -> None:
        order = np.argsort(ids.astype(np.uint16) if self.pad < 1 << 16 else ids, kind="stable")  # short numbers sort by digits
        own = ids[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for i, grad in grads:
            self._step(i, own[first], np.add.reduceat(grad.take(order, 0), first), past)


@dataclass
class Model:
    """Hashes of the tokens with ids of their own (sorted) and their ids, each shared id's (count, distinct tokens), the token table, and weights.

    counted: hashes of the COUNTED most frequent tokens (sorted) and the logarithms of their counts plus one.
    """

    known: np.ndarray
    ids: np.ndarray
    bins: np.ndarray
    table: DataFrame
    weights: np.ndarray
    side: int
    tokens: int
    counted: tuple[np.ndarray, np.ndarray]

    def mapping(self) -> tuple[np.ndarray, np.ndarray, int]:
        return self.known, self.ids, self.side


def numbered(h: np.ndarray, mapping: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of hashed tokens, and which of them are shared."""
    known, ids, side = mapping
    h = h.view(np.int64)
    shared = own_ids(side) + (h & (side * side // SHARED - 1))
    if not len(known):
        return shared, np.ones(len(h), bool)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    rare = known[at] != h
    return np.where(rare, shared, ids[at]), rare


def sequences(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, how many, hashed tokens, their seats in a padded row, offsets of documents) over a column of texts."""
    for at, n, (h, _), places in hashing.grouped(column, hashing.tokens):
        seat = np.arange(len(h)) + WINDOW * (np.repeat(np.arange(n), np.diff(places)) + 1)
        yield at, n, h, seat, places


def steps(ids: np.ndarray, seat: np.ndarray, size: int, pad: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Padded rows of up to ``size`` tokens with their neighbours, and the tokens' places in them."""
    if not len(ids):
        return
    row = np.full(seat[-1] + WINDOW + 1, pad)
    row[seat] = ids
    for lo in range(0, len(ids), size):
        own = seat[lo : lo + size]
        yield row[own[0] - WINDOW : own[-1] + WINDOW + 1], own - own[0] + WINDOW


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> pa.RecordBatch:
        h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        u, back = np.unique(h, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(back, n).astype(np.int64))], ["token", "n"])

    for batch in batches:
        for _, _, h, _, _ in sequences(batch.column(0)):
            held.append(np.unique(h, return_counts=True))
            if sum(len(x) for x, _ in held) > 1_000_000:
                yield merged()
                held = []
    if held:
        yield merged()


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights averaged by their tokens; columns block, lot, n, weights, sorted by block and lot. One sum is held at a time."""
    key, n, total = None, 0, np.zeros(0)

    def done() -> pa.RecordBatch:
        cells = ([key[0]], pa.int32()), ([key[1]], pa.int32()), ([n], pa.int64()), ([(total / n).astype(np.float32).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cells], ["block", "lot", "n", "weights"])

    for batch in batches:
        for block, lot, count, blob in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if key != (block, lot):
                if key is not None:
                    yield done()
                key, n, total = (block, lot), 0, np.zeros(len(blob) // 4)
            n += count
            total += count * np.frombuffer(blob, np.float32)
    if key is not None:
        yield done()


def averaged(parts: DataFrame) -> DataFrame:
    """One row for each block of ``parts`` (block, lot, n, weights), by way of partial means of LOTS lots, so no task meets all parts of a block."""
    for lot in (F.pmod("lot", F.lit(LOTS)), F.lit(0)):
        rows = parts.withColumn("lot", lot.cast("int")).repartition(partitions(parts.sparkSession), "block", "lot").sortWithinPartitions("block", "lot", "n", "weights")
        parts = rows.mapInArrow(_mean, "block int, lot int, n long, weights binary")
    return parts


def fit(column: pa.Array, net: Network, past: Network, mapping: tuple[np.ndarray, np.ndarray, int]) -> int:
    """Trains ``net`` on every position of a column of texts, and tells how many there were."""
    total = 0
    for _, _, h, seat, _ in sequences(column):
        for row, at in steps(numbered(h, mapping)[0], seat, STEP, net.pad):
            net.learn(row, at, past)
        total += len(h)
    return total


#: Counts up to here are bins of their own when the most frequent tokens are looked for; larger ones share 64 bins an octave.
EXACT = 4096


def most_frequent(table: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of ``table`` (token, n) of the largest n, ties by token, found by a histogram of n.

    Only tokens that can be among them are sorted, so what tasks send on does not grow with their number: of the tokens
    of the last bin, if that holds many of one count, only those with small hashes.
    """
    n = F.col("n")
    of = F.when(n <= EXACT, n).otherwise(EXACT + 1 + F.floor(F.log2(n / EXACT) * 64)).cast("long")
    sizes = dict(table.groupBy(of.alias("bin")).count().collect())  # some EXACT + 64 * 50 rows at most
    above = 0
    for last in sorted(sizes, reverse=True):
        if above + sizes[last] >= k:
            break
        above += sizes[last]
    else:
        return table
    wanted = of >= last
    need = k - above
    share = (2 * need + 1000) / sizes[last]
    if last <= EXACT and share < 0.5:
        wanted = (of > last) | ((of == last) & (F.col("token") < -(1 << 63) + int(share * (1 << 64))))
    return table.where(wanted).orderBy(F.desc("n"), "token").limit(k)


def vocabulary(docs: DataFrame) -> Model:
    """The token table of the texts of ``docs``, ids for the most frequent tokens, and a network that knows the counts alone."""
    texts = spread(docs.select(F.col("text").cast("string").alias("text")))
    table = written(texts.mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    tokens = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    side = side_for(tokens)
    own, bins = own_ids(side), side * side // SHARED
    first = most_frequent(table, max(own, COUNTED)).toPandas()  # two numbers of COUNTED tokens at most
    first = first.sort_values(["n", "token"], ascending=[False, True])
    hashes, times = first["token"].to_numpy(np.int64), first["n"].to_numpy(np.int64)
    counts, of_bin = np.zeros(side * side), np.zeros((bins, 2))
    top = min(own, len(hashes))
    counts[:top] = times[:top]
    if top:
        least, last = int(times[top - 1]), int(hashes[top - 1])
        rare = (F.col("n") < least) | ((F.col("n") == least) & (F.col("token") > last))
        for b, n, distinct in table.where(rare).groupBy(F.col("token").bitwiseAND(bins - 1)).agg(F.sum("n"), F.count("*")).collect():  # a row for each shared id at most
            of_bin[b] = n, distinct
    counts[own:] = of_bin[:, 0]
    ids = np.argsort(hashes[:top])
    order = np.argsort(hashes)
    counted = hashes[order], np.log(times[order] + 1.0)
    return Model(hashes[:top][ids], ids.astype(np.int64), of_bin, table, Network.start(counts).flat, side, tokens, counted)


def lots_of(tokens: int, rounds: int) -> int:
    """Lots of a round."""
    return max(1, min(MOST_LOTS, -(-tokens // (rounds * LOT))))


def dealt(docs: DataFrame, lots: int, rounds: int) -> DataFrame:
    """(round, lot, rank, doc_id, text): rows dealt by a hash of their id and text; within a lot they go by rank, then id."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("rank"))
    place = F.pmod("rank", F.lit(lots * rounds))
    return rows.select((place % rounds).cast("int").alias("round"), F.floor(place / rounds).cast("int").alias("lot"), "rank", "doc_id", "text")


def _trained(shared) -> object:
    """A task's function: from rows (lot, text) in order to the weights of each lot, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, mapping = shared.value
        lot, net, past, n = None, None, None, 0

        def done() -> pa.RecordBatch:
            parts = [net.flat[lo : lo + BLOCK].tobytes() for lo in range(0, len(net.flat), BLOCK)]
            cells = (range(len(parts)), pa.int32()), ([lot] * len(parts), pa.int32()), ([n] * len(parts), pa.int64()), (parts, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cells], ["block", "lot", "n", "weights"])

        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1), len(own)] if len(own) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if own[lo] != lot:
                    if n:
                        yield done()
                    lot, net, n = int(own[lo]), Network(weights.copy(), mapping[2]), 0
                    past = Network(np.zeros_like(net.flat), mapping[2])
                n += fit(batch.column(1).slice(lo, hi - lo), net, past, mapping)
        if n:
            yield done()

    return run


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """A model trained on the texts of all of ``docs`` (doc_id, text); of an empty table, an untrained one."""
    model = vocabulary(docs)
    lots = lots_of(model.tokens, rounds)
    rows = dealt(docs, lots, rounds)
    for k in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.mapping()))
        own = rows.where(F.col("round") == k).repartitionById(lots, F.col("lot")).sortWithinPartitions("lot", "rank", "doc_id").select("lot", "text")
        fitted = averaged(own.mapInArrow(_trained(shared), "block int, lot int, n long, weights binary")).collect()  # as many rows as the network has blocks
        if fitted:
            model.weights = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(fitted, key=lambda r: r["block"])])
    return model


def _lists(own: np.ndarray, h: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Each document's distinct tokens and how often it has them."""
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    ends = pa.array(np.searchsorted(own[first], np.arange(n + 1)).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(ends, pa.array(v)) for v in (h[first].view(np.int64), np.diff(np.append(first, len(h))).astype(np.int64)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, mean_log_probability, log_probability, n_tokens); a text without tokens has a null mean and 0.

    Of a shared id with N counts and D distinct tokens, a token seen n times has the share (n + 1) / (N + D + 1), which
    leaves one part for tokens never seen.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.mapping(), np.log(model.bins.sum(1) + 1), model.counted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, mapping, norms, (frequent, log_counts) = shared.value
        net, own_from = Network(weights, mapping[2]), own_ids(mapping[2])
        near = net.near()
        for batch in batches:
            for first, k, h, seat, places in sequences(batch.column(1)):
                ids, rare = numbered(h, mapping)
                logs = np.concatenate([np.zeros(0), *[net.score(row, at, near) for row, at in steps(ids, seat, STEP, net.pad)]])
                logs[rare] -= norms[ids[rare] - own_from]
                if len(frequent):
                    place = np.flatnonzero(rare)
                    at = np.minimum(np.searchsorted(frequent, h[place].view(np.int64)), len(frequent) - 1)
                    found = frequent[at] == h[place].view(np.int64)
                    logs[place[found]] += log_counts[at[found]]
                    rare[place[found]] = False  # the rest is joined from the table
                sums = np.append(0.0, np.cumsum(logs, dtype=np.float64))
                own = np.repeat(np.arange(k), np.diff(places))
                tokens, times = _lists(own[rare], h[rare], k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, k), pa.array(np.diff(places).astype(np.int64)), pa.array(sums[places[1:]] - sums[places[:-1]]), tokens, times], ["doc_id", "n_tokens", "known", "tokens", "times"])

    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = written(texts.mapInArrow(run, "doc_id long, n_tokens long, known double, tokens array<long>, times array<long>").withColumn("own", F.monotonically_increasing_id()))
    met = rows.select("own", F.explode(F.arrays_zip("tokens", "times")).alias("t")).select("own", "t.*").withColumnRenamed("tokens", "token")
    shares = met.join(model.table, "token", "left").groupBy("own").agg(F.sum(F.col("times") * F.log(F.coalesce("n", F.lit(0)) + 1.0)).alias("shares"))
    total = F.col("known") + F.coalesce("shares", F.lit(0.0))
    return rows.join(shares, "own", "left").select("doc_id", F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_probability"), total.alias("log_probability"), "n_tokens")


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text) under a model trained on all of them, as of ``score``.

    Null and empty texts have no tokens; repeated rows count and are scored each, alike; rows without doc_id are
    scored too. Texts may be as long as a row can be: they are read in pieces. Other columns are not read, and an
    empty table gives an empty one.
    """
    return score(docs, train(docs, rounds))
