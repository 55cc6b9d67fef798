"""Connected components, and how few steps they take."""

import random

from evenkeel.llm.common import Scratch
from evenkeel.llm.components import components


def least(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def run(spark, edges):
    scratch = Scratch(spark)
    try:
        return dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), scratch).collect())), scratch.n
    finally:
        scratch.close()


def test_against_union_find(spark):
    rng = random.Random(4)
    chain = list(range(60))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(rng.randrange(100, 260), rng.randrange(100, 260)) for _ in range(90)]
    edges = [(a, b) for a, b in edges if a != b]
    more = edges + edges[::3] + [(b, a) for a, b in edges[::4]] + [(5, 5), (900, 900), (None, 5), (901, None)]
    assert run(spark, more)[0] == least(edges)
    assert run(spark, [(None, 1), (2, 2)])[0] == {}


def test_labels_that_are_settled_end_it(spark):
    # every node sees the least of its component at once: one look at the neighbours and no further step
    edges = [(0, k) for k in range(1, 30)] + [(100, 101)]
    got, written = run(spark, edges)
    assert got == least(edges) and written <= 3
