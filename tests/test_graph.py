"""Components against union-find."""

import random

from carteggio.operators.graph import connected_components


def brute(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
    return {x: find(x) for x in p if find(x) != x}


def run(spark, edges):
    return {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}


def test_random_chain_star(spark):
    rng = random.Random(3)
    sparse = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    order = list(range(1000, 1200))
    rng.shuffle(order)
    edges = sparse + list(zip(order, order[1:])) + [(5000, 5000 + i) for i in range(1, 300)] + [(7, 7), (None, 3), (9, None)] + sparse
    assert run(spark, edges) == brute(edges)


def test_empty(spark):
    assert run(spark, []) == {}
