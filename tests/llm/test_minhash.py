import random
import re

from pulsegrid.llm import minhash


def brute(rows, percent=85):
    """component_id by doc_id from all pairs of full shingle sets."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return {i: (len(sets[i]), comp[i]) for i in ids}


def corpus(seed, groups, copies, words):
    r = random.Random(seed)
    vocabulary = [f"w{r.randrange(10**6)}é" for _ in range(3000)]
    rows = []
    for _ in range(groups):
        base = r.choices(vocabulary, k=words)
        for _ in range(copies):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append(" ".join(own).upper() if r.random() < 0.1 else " \n".join(own))
    r.shuffle(rows)
    return list(enumerate(rows))


def found(spark, rows, **more):
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()
    assert len(out) == len(rows)
    assert all(x.kept == (x.doc_id == x.component_id) for x in out if x.doc_id is not None)
    return {x.doc_id: (x.n_shingles, x.component_id) for x in out}


def test_groups_equal_brute_force(spark):
    rows = corpus(1, 25, 6, 120)
    assert found(spark, rows) == brute(rows)


def test_clusters_over_a_block_take_both_passes(spark):
    rows = corpus(2, 2, 90, 110)
    assert found(spark, rows, block=16) == brute(rows)


def test_edge_cases(spark):
    long = " ".join(str(i) for i in range(60_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "a b"), (3, "A  B"), (9, "a b c"), (10, long), (2, long + " end"), (11, "\x00 x y")]
    assert found(spark, rows) == brute(rows)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeats_null_ids_and_other_columns(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 2), (None, "a b c d e f", 3), (4, "a b c d e f", 4)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id long"))
    assert sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in out.collect()) == [(0, 0, True), (1, 1, True), (1, 1, True), (4, 1, False)]


def test_posterior_bounds_rise_with_the_batches():
    least = minhash.least_matches(0.85, 1e-6)
    assert least == sorted(least) and 0 < least[0] < 24 * 0.85 and least[-1] < 120 * 0.85


def test_bands_follow_from_the_threshold():
    for t in (0.5, 0.8, 0.85, 0.95):
        n = minhash.bands_needed(t, 1e-6)
        assert (1 - t**minhash.ROWS) ** n <= 1e-6 < (1 - t**minhash.ROWS) ** (n - 1)


def test_pairs_between_080_and_085_and_texts_of_one_id(spark):
    from pulsegrid.llm import stages

    rows = []
    for k in range(300):  # 104 words, 100 runs; 9 or 10 other words at an end leave 91 or 90 of 109 or 110: 0.83 and 0.82
        base = [f"w{k}_{i}" for i in range(104)]
        other = base[: -9 - k % 2] + [f"x{k}_{i}" for i in range(9 + k % 2)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    near = " ".join(f"w0_{i}" for i in range(100)) + " z z1 z2 z3"
    rows += [(9001, "a text of its own that nothing resembles"), (9001, rows[0][1]), (9002, near), (9002, "another clean text under an id used twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    single = stages.near_dedup(spark, df, "").collect()
    want = [r for r in rows if r[0] < 9000 and r[0] % 2 == 0] + [rows[-4], rows[-1]]
    assert sorted(map(tuple, single)) == sorted(want)
    out = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(df, threshold=(80, 100)).collect()}
    assert out[9002, 100] == 0 and out[9001, 100] == 0 and {c for (i, n), c in out.items() if i > 9000 and n < 100} == {9001, 9002}
    assert all(c == c0 for c, c0 in ((out[2 * k + 1, 100], 2 * k) for k in range(300)))
