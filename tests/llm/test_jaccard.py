import random

import pytest
from evenkeel.llm import jaccard


def brute(docs, words, percent):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            o = len(x & sets[j])
            if x and sets[j] and docs[i][0] is not None and docs[j][0] is not None and 100 * o >= percent * (len(x) + len(sets[j]) - o):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(docs):
        mine = [docs[j][0] for j in range(len(docs)) if find(j) == find(i)]
        out.append((d, len(sets[i]), None if d is None else min(mine)))
    return sorted(out, key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.7:
            base = rng.choice(docs)[1] or ""
            w = base.split(" ")
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((i, " ".join(w)))
        else:
            docs.append((i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 12, 80, 300])))))
    return docs


@pytest.mark.parametrize("words,percent,seed", [(3, 90, 1), (5, 80, 2), (3, 50, 3)])
def test_brute_force(spark, words, percent, seed):
    docs = corpus(seed)
    got = jaccard.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), words, percent).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, words, percent)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a B"), (5, "a b"), (6, "a b c d"), (None, "a b"), (7, "x " * 30_000), (8, "x y z"), (9, "x Y z"), (10, "À b c"), (11, "à b c")]
    frame = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, id string, component_id int")
    got = jaccard.similar_groups(frame, 3, 90).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, 3, 90)
    assert jaccard.similar_groups(frame.limit(0), 3, 90).count() == 0


def test_hot_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    docs = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    got = jaccard.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, 3, 90)


@pytest.mark.parametrize("block,stars", [(2, 0), (3, 1), (64, 3)])
def test_large_columns(spark, monkeypatch, block, stars):
    monkeypatch.setattr(jaccard, "STARS", stars)
    monkeypatch.setattr(jaccard, "TILE", 7)
    docs = corpus(7)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard.similar_groups(frame, 3, 80, block=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, 3, 80)


def test_one_passage_in_very_many_documents(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, " ".join(f"u{rng.randrange(10**7)}" for _ in range(rng.randint(5, 12))) + " " + passage) for i in range(6000)]
    docs += [(10_000 + i, docs[i][1] + " end") for i in range(0, 600, 3)]
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), 5, 90).collect()}
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in docs}
    for i in range(0, 600, 3):
        assert got[10_000 + i] == got[i] == i
    # no two others are within the threshold: 36 of their 41 n-grams or more are common, 90 percent need more
    assert all(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.9 for a, b in ((1, 2), (2, 4), (4, 5)))
    assert sum(d != c for d, c in got.items()) == 200


def test_rows_within_the_threshold_share_a_column_and_may_meet():
    import numpy as np

    rng = np.random.default_rng(4)
    for percent in (50, 80, 90):
        bound = jaccard.Bound(percent)
        for n in list(range(1, 60)) + [500, 3000]:
            x = rng.permutation(10**6)[:n]
            drop = int(rng.integers(0, n - n * percent // 100 + 1))
            y = np.r_[x[drop // 2 :], 10**6 + np.arange(drop - drop // 2)]
            if not len(y) or not bound.near(len(np.intersect1d(x, y)), len(x), len(y)):
                continue
            rank = rng.permutation(2 * 10**6)
            a, b = rank[x][np.argsort(rank[x])], rank[y][np.argsort(rank[y])]
            p, q = a[: bound.prefix(len(a))], b[: bound.prefix(len(b))]
            both = np.intersect1d(p, q)
            assert len(both)
            assert bound.can(len(a), len(b), np.searchsorted(a, both[0]), np.searchsorted(b, both[0]))
            rest = max(len(a) - len(p), len(b) - len(q))
            assert len(both) + rest >= bound.least(len(a) + len(b))


def test_marks_keep_few_rows_that_are_not_needed(spark):
    import numpy as np
    from pyspark.sql import functions as F

    # 3 million ids: all of them pass, and under 5 in 100 others
    bits = jaccard.marks(spark.range(0, 3_000_000, 1, 8))
    at = F.xxhash64("id").bitwiseAND(jaccard.MARKS - 1).alias("at")
    given, others = (spark.range(a, a + 200_000).select(at).toArrow().column("at").to_numpy() for a in (1_000_000, 5_000_000))
    assert jaccard.marked(bits, given).all()
    assert np.mean(jaccard.marked(bits, others)) < 0.05
    assert bits.nbytes == 8 << 20 and not jaccard.marks(spark.range(0)).any()


def test_a_large_column_is_given_back_as_it_comes():
    import numpy as np
    import pyarrow as pa

    gram = np.r_[np.repeat(1, 3), np.repeat(2, 900), np.repeat(3, 2)]
    ids = np.r_[[1, 2, 2], np.repeat(np.arange(300), 3), [5, 6]]
    x = np.full(len(gram), 10 << 32)
    batches = [pa.record_batch([pa.array(c[k : k + 70]) for c in (gram, ids, x)], names=["gram", "id", "x"]) for k in range(0, len(gram), 70)]
    for block in (4, 64, 299, 300):
        got = [r for b in jaccard.products(iter(batches), jaccard.Bound(90), block) for r in b.to_pylist()]
        back = [(r["gram"], r["a"]) for r in got if r["b"] is None]
        assert back == ([(2, k) for k in range(300)] if block < 300 else [])
        pairs = {(r["a"], r["b"]) for r in got if r["b"] is not None}
        assert pairs == ({(a, b) for b in range(300) for a in range(b)} if block == 300 else {(1, 2), (5, 6)})


def test_rows_dealt_by_id_stay_for_joins(spark):
    scratch = jaccard.Scratch(spark)
    rows = scratch.dealt(spark.range(1000).selectExpr("id", "id * 2 as n"), "id")
    plan = rows.hint("merge").join(spark.range(50, 70), "id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 20 and text.count("Exchange hashpartitioning") == 1
    scratch.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("scratch_")]


def test_signatures_never_differ_in_more_than_the_rows():
    import numpy as np

    rng = np.random.default_rng(6)
    sets = []
    for n in (1, 2, 63, 64, 65, 128, 500, 520, 3000, 9000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets += [np.unique(x), np.unique(np.r_[x[n // 10 :], rng.integers(0, 1 << 63, n // 8).astype(np.uint64)])]
    marks = [jaccard.signature(x) for x in sets]
    got = jaccard.all_apart(marks, marks[3:])
    assert got.tolist() == [[jaccard.apart(a, b) for b in marks[3:]] for a in marks]
    assert all(got[i, j] <= len(np.setxor1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets[3:]))
    a, b = (rng.integers(0, 1 << 63, 500).astype(np.uint64) for _ in "ab")  # and unlike rows are told apart
    assert jaccard.apart(jaccard.signature(a), jaccard.signature(b)) > jaccard.Bound(90).most(1000)


def test_pairs_of_a_large_column_are_not_handed_on(spark, monkeypatch):
    # 150 texts with the same passage, all alike but hardly any within the threshold: 11,175 pairs in each column of it
    rng = random.Random(9)
    base = [f"p{i}" for i in range(200)]
    docs = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(200), 3 if i % 15 else 1):
            w[k] = f"u{rng.randrange(10**9)}"
        docs.append((i, " ".join(w)))
    moved = []
    whole = jaccard.linked_pairs
    monkeypatch.setattr(jaccard, "linked_pairs", lambda pairs, *rest: moved.append(pairs.count()) or whole(pairs, *rest))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard.similar_groups(frame, 3, 90).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, 3, 90)
    assert sum(moved) <= 2 * len(docs)


def test_a_tile_gives_no_more_links_than_rows():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.r_[base[k % 9 :], rng.integers(0, 1 << 63, k % 3).astype(np.uint64)]) for k in range(80)]
    n = np.array([len(x) for x in sets])
    at = np.arange(80) % 2
    bound, ids = jaccard.Bound(90), np.arange(80) * 7
    for i, j in ((0, 0), (0, 1)):
        here = np.flatnonzero((at == i) | (at == j))
        one = np.zeros(len(here), np.int64)
        tile = {"gram": one, "i": one + i, "j": one + j, "at": at[here], "id": ids[here], "x": n[here] << 32, "comp": ids[here], "early": [[0]] * len(here), "signature": [jaccard.signature(sets[k]) for k in here]}
        some = pa.Table.from_batches(jaccard.tile_partners(iter(pa.table(tile).to_batches()), bound))
        assert some.column("id").to_pylist() == ids[here].tolist()
        wide = some.append_column("n", pa.array(n[here])).append_column("row", pa.array([jaccard.packed(sets[k]) for k in here]))
        links = pa.Table.from_batches(jaccard.tile_links(iter(wide.combine_chunks().to_batches()), bound))
        assert links.num_rows == len(here) - 1
        # a pair that both rows have met before is left to that column
        tile["early"] = [[5, 0]] * len(here)
        assert not list(jaccard.tile_partners(iter(pa.table(tile).to_batches()), bound))


@pytest.mark.parametrize("few,block", [(0, 2), (0, 20), (200, 20)])
def test_components_are_worked_out_anew_only_after_new_links(spark, monkeypatch, few, block):
    # one row against its column joins a group of near copies; what is left apart shares a passage and has no partner
    rng = random.Random(12)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    docs = []
    for i in range(120):
        w = list(base)
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(base[:30] + [f"v{rng.randrange(10**6)}" for _ in range(30)])) for i in range(60)]
    calls = []
    whole = jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda *rest: calls.append(1) or whole(*rest))
    monkeypatch.setattr(jaccard, "FEW", few)
    got = jaccard.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90, block=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, 3, 90)
    assert len(calls) <= 2
