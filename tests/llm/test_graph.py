import random

import pytest

from sonarlake.llm import graph


def plain(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = top(a), top(b)
            parent[max(p, q)] = min(p, q)
    return {x: top(x) for x in list(parent)}


@pytest.mark.parametrize("small", [graph.SMALL, 0])
def test_components(spark, small):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, k) for k in range(1001, 1100)]
    loose = [(rng.randrange(-3000, -1000), rng.randrange(-3000, -1000)) for _ in range(900)]
    edges = chain + star + loose + loose[:50] + [(7, 7), (-(2**63), 2**63 - 1), (5000, 5000)]
    rng.shuffle(edges)
    table = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = graph.connected_components(table, small=small).collect()
    assert {r["node"]: r["component"] for r in got} == plain(edges) and len(got) == len(plain(edges))
    assert graph.connected_components(table.limit(0), small=small).count() == 0
