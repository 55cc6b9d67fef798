"""Every link between different texts is counted, beyond those that join a component."""

import random

import numpy as np
import pytest
from evenkeel.llm import jaccard
from test_jaccard import brute, corpus


def counted(docs, words, percent):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links = [0] * len(docs)
    for i, x in enumerate(sets):
        for j in range(i):
            o = len(x & sets[j])
            if x and sets[j] and docs[i][0] is not None and docs[j][0] is not None and 100 * o >= percent * (len(x) + len(sets[j]) - o):
                links[i] += 1
                links[j] += 1
    parts = {(d, n): c for d, n, c in brute(docs, words, percent)}
    return sorted(((d, len(x), n, parts[d, len(x)]) for (d, _), x, n in zip(docs, sets, links)), key=str)


def near_copies(n):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    docs = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    return docs


EDGE = [(1, None), (2, ""), (4, "A b"), (5, "a B"), (5, "a b"), (None, "a b"), (7, "x y z"), (8, "x Y z")]


@pytest.mark.parametrize("docs,words,percent,side", [(corpus(2), 5, 80, 1024), (near_copies(300) + EDGE, 3, 90, 64)])
def test_links_by_brute_force(spark, monkeypatch, docs, words, percent, side):
    monkeypatch.setattr(jaccard, "PRODUCT", side)
    got = jaccard.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), words, percent, count_links=True)
    assert got.columns == ["doc_id", "n_shingles", "n_links", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == counted(docs, words, percent)


def test_overlaps_over_several_blocks_of_columns():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, n)).astype(np.uint64) for n in (1, 40, 3000, 5000, 8000)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]
    assert jaccard.overlaps(sets[:3], sets).tolist() == want
    assert jaccard.overlaps([sets[0]], [sets[0] + np.uint64(9001)]).tolist() == [[0]]
