"""Toxicity, quality, language and the mix: edge cases, and held-out accuracy on small planted corpora."""

import random
import zlib

import numpy as np
from evenkeel.llm import language, mixing, quality, toxicity
from pyspark.sql import functions as F

EDGES = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "1234 !!"), (9005, "a"), (None, "some words here"), (3, "again the same id"), (3, "again the same id"), (9006, "word " * 30_000), (9007, "x" * 50_000)]


def frame(spark, docs, **more):
    return spark.createDataFrame([(d, t, "k", 1, 2.0) for d, t in docs], "doc_id long, text string, label string, predicted int, score double")


def say(rng, n, letters="abcdefghijklmnop"):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(1)) for _ in range(n)]


def test_toxicity(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(500):
        words, toxic = say(rng, rng.randint(15, 120)), i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["badword,", "Nastyone", "vileness!"])
        docs.append((i, " ".join(words)))
        labels.append((i, None, int(toxic), "x"))
    labels += [(3, None, 0, "x"), (None, None, 1, "x"), (12345, None, 1, "x"), (4, None, None, "x"), (5, None, 7, "x")]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.tag_documents(frame(spark, docs + EDGES), labels).collect()
    assert len(got) == len(docs) + len(EDGES)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in got)
    mine = [r for r in got if r.doc_id is not None and r.doc_id < 500 and r.doc_id != 3 and r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in mine]) > 0.95
    text = dict(docs)
    for r in mine:
        if r.doc_id % 4 == 0 and r.predicted:
            assert any(w in text[r.doc_id][s.begin : s.end] for s in r.spans for w in ("badword", "Nastyone", "vileness"))
    assert toxicity.tag_documents(frame(spark, docs).limit(0), labels).count() == 0
    assert len({round(r.score, 6) for r in toxicity.tag_documents(frame(spark, EDGES), labels.limit(0)).collect()}) == 1


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(0)
    moves, begin = rng.normal(size=(2, 2)), 0.3
    lengths = np.array([3, 0, 1, 7])
    e = rng.normal(size=lengths.sum()) * 2
    got, want = toxicity.marginals(e, lengths, moves, begin), []
    for x in np.split(e, np.cumsum(lengths)[:-1]):
        n = len(x)
        total, on = 0.0, np.zeros(n)
        for k in range(1 << n) if n else ():
            s = [k >> i & 1 for i in range(n)]
            w = np.exp(begin * s[0] + sum(x[i] * s[i] for i in range(n)) + sum(moves[a, b] for a, b in zip(s, s[1:])))
            total += w
            on += w * np.array(s)
        want += list(on / total) if n else []
    assert np.allclose(got, want)
    long = rng.normal(size=5000) * 3
    assert np.isfinite(toxicity.marginals(long, np.array([5000]), moves, begin)).all()


def test_quality(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        words = say(rng, rng.randint(40, 200))
        docs.append((i, " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), 0, "x"))
    labels = spark.createDataFrame(labels + [(1, 0, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = quality.score_quality(frame(spark, docs + EDGES), labels).collect()
    assert len(got) == len(docs) + len(EDGES)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in got)
    mine = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id != 3 and r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in mine]) > 0.95
    assert quality.score_quality(frame(spark, docs).limit(0), labels).count() == 0
    assert {r.score for r in quality.score_quality(frame(spark, EDGES), labels.limit(0)).collect()} == {0.5}


def test_language(spark):
    rng = random.Random(3)
    kinds = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstü"}
    docs = [(i, " ".join(say(rng, rng.randint(5, 60), kinds[c])), c) for i in range(300) for c in [list(kinds)[i % 3]]]
    rows = docs + [(d, t, None) for d, t in EDGES] + [(700, "abc", None)]
    df = spark.createDataFrame([(d, t, c, "k", 1.0) for d, t, c in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = language.identify(df).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == "und" for d in (9001, 9002, 9003, 9004)) and by[9005].lang_pred != "und"
    assert np.mean([r.lang_pred == list(kinds)[r.doc_id % 3] for r in got if r.doc_id is not None and r.doc_id < 300 and r.held_out and r.doc_id != 3]) > 0.97
    assert language.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def water(sizes, weights, budget):
    target = {}
    left, open_ = budget, dict(weights)
    while True:
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) >= 2 * sizes[s]]
        if not over:
            break
        s = min(over, key=lambda s: 2 * sizes[s] / open_[s])
        target[s] = 2 * sizes[s]
        left -= target[s]
        del open_[s]
        if not open_:
            break
    return target | {s: left * w / sum(open_.values()) for s, w in open_.items()}


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "b", "b", "c", "", "Z", None, "é"])) for i in range(400)] + [(5, "x y", "a"), (5, "x y", "a"), (None, "one two", "b"), (990, None, "c"), (991, "big " * 20_000, "c")]
    df = spark.createDataFrame([(d, t, s, 1, "k") for d, t, s in docs], "doc_id long, text string, source string, size int, key string")
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs) and sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water(sizes, {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for s in order:
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size for r in mine)
        # a source has begun no more than one document beyond, or wants no more than one to, its target
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1 + 2 * max(r.size for r in rows)
    assert sum(r.taken for r in rows) == 1.5 * sum(sizes.values()) // 1
    assert mixing.mix(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(df.where("doc_id = 990")).collect()] == [0]
