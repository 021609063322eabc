import random

import pytest

from pulsegrid.llm import components


def brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("small", [100_000, 0])
def test_components_equal_union_find(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL_EDGES", small)
    r = random.Random(1)
    edges = [(r.randrange(900), r.randrange(900)) for _ in range(600)] + [(2000, 2000 + i) for i in range(1, 200)] + [(3000 + i, 3001 + i) for i in range(20)]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3), edges[0]], "a long, b long")
    assert {x.node: x.component for x in components.connected(df).collect()} == brute([e for e in edges if e[0] != e[1]])
    assert components.connected(df.limit(0)).collect() == []
