import random

import numpy as np
from evenkeel.llm import decontaminate as d


def passages():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([3, 30, 60])))) for i in range(30)]
    return rng, say, items


def test_planted(spark):
    rng, say, items = passages()
    docs, want, clean = [], set(), set()
    for i in range(120):
        body = say(rng.randint(50, 600))
        if i % 3 == 0:
            key, text = items[rng.randrange(len(items))]
            part = text.split()
            if i % 2 and len(part) > 50:
                part[7] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + "," if i % 4 == 0 else w for w in part]
            want.add((i, key))
        else:
            clean.add(i)
        docs.append((i, " ".join(body)))
    docs += [(200, None), (201, ""), (202, "w1"), (203, items[1][1] * 1), (204, " ".join(say(40_000)))]
    want.add((203, items[1][0]))
    frame = spark.createDataFrame([(a, t, "x", 1) for a, t in docs], "doc_id long, text string, item_id string, first_word int")
    bench = spark.createDataFrame([*items, items[0], (77, None), (78, ""), (None, "a b c d e f g")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.leaks(frame, bench).collect()}
    assert want <= got
    assert not {x for x, _ in got} & clean
    kept = d.drop_leaks_of(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {a for a, _ in docs} - {x for x, _ in got}
    assert d.leaks(frame.limit(0), bench).count() == 0
    assert d.leaks(frame, bench.limit(0)).count() == 0


def item_frame(spark, items):
    rows = d.fingerprinted(spark.createDataFrame(items, "item_id long, text string")).collect()
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "item long, item_id long, size int, mark long, grams binary")


def test_index_finds_all_within_radius_and_few_others(spark):
    rng, say, _ = passages()
    items = item_frame(spark, [(i, " ".join(say(40))) for i in range(300)])
    rows = [r for r in items.collect()]
    probes, want = [], set()
    for k in range(400):
        r = rows[rng.randrange(len(rows))]
        mark = r.mark
        for bit in rng.sample(range(64), rng.randint(0, d.RADIUS)):
            mark ^= -(1 << 63) if bit == 63 else 1 << bit
        probes.append((k, 40, 0, 40, mark))
        want |= {(k, x.item) for x in rows if bin((x.mark ^ mark) & (1 << 64) - 1).count("1") <= d.RADIUS}
    found = spark.createDataFrame(probes, "row long, size int, first int, n int, mark long")
    assert {(r.row, r.item) for r in d.near_items(found, d.index(items)).collect()} == want
    # what the index offers, before the distance is looked at, is a small share of all pairs
    blocks = [(k, b, mark >> 16 * b & 0xFFFF) for k, _, _, _, mark in probes for b in range(d.BLOCKS)]
    near = set(d.NEAR.tolist())
    offered = sum(any(((x.mark >> 16 * b & 0xFFFF) ^ v) in near for b, v in [(b, v) for j, b, v in blocks if j == k]) for k in range(60) for x in rows)
    assert offered / (60 * len(rows)) < 0.08


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    near = []
    for _ in range(2000):
        both = rng.integers(0, 2**63, 40, dtype=np.uint64)
        a, b = both[:36], np.r_[both[:32], both[36:]]
        assert d.similarity(a, b) >= 0.8
        near.append(bin((d.fingerprint(a) ^ d.fingerprint(b)) & (1 << 64) - 1).count("1") <= d.RADIUS)
    assert np.mean(near) > 0.95


def test_best_windows_equal_brute_force(spark):
    rng, say, items = passages()
    ids = d.PlainWords()
    docs, want = [], {}
    for n in range(25):
        key, text = rng.choice(items)
        part = text.split()
        for _ in range(len(part) // 30):
            part[rng.randrange(len(part))] = "other"
        docs.append((n, " ".join(say(rng.choice([0, 30])) + part[: len(part) - n % 3] + say(rng.choice([0, 30])))))
        words = d.word_ids(docs[-1][1], ids)
        for k, item in items:
            grams = d.shingles(d.word_ids(item, ids), d.WORDS)
            size = len(item.split())
            for at in range(1 - size, len(words)):
                alike = d.similarity(d.shingles(words[max(at, 0) : at + size], d.WORDS), grams)
                if alike >= d.SIMILAR:
                    want[n, k] = max(want.get((n, k), 0), alike)
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r.similarity for r in got}
    assert len(found) == len(got) and found.keys() <= want.keys() and len(found) > 0.95 * len(want)
    assert all(abs(found[k] - want[k]) < 0.05 and found[k] <= want[k] + 1e-12 for k in found)


def test_one_repeated_shingle(spark):
    docs = [(1, "same " * 5000), (None, "same " * 40), (None, "same " * 40), (1, "same " * 40), (2, "same same same")]
    items = [(7, "same " * 40), (8, "same same"), (9, "other words " * 20)]
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == sorted([("1", 7), ("1", 8), ("None", 7), ("None", 8), ("None", 7), ("None", 8), ("1", 7), ("1", 8), ("2", 8)])


def test_a_hundred_times_the_items(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"x{rng.randrange(5000)}" for _ in range(rng.choice([30, 31, 45])))) for i in range(3000)]
    docs = [(i, " ".join(f"y{rng.randrange(5000)}" for _ in range(50)) + " " + items[7 * i][1]) for i in range(100)]
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, 7 * i) for i in range(100)}
