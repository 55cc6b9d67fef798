"""Language filters and the quality discriminant against plain rebuilds; samples; the layout of a table changes nothing."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from evenkeel.llm import common, language, quality, toxicity


def lang_docs(n=240):
    rng = random.Random(3)
    kinds = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstü"}
    word = lambda c: "".join(rng.choice(kinds[c]) for _ in range(rng.randint(1, 7)))
    return [(i, " ".join(word(c) for _ in range(rng.choice([1, 5, 60]))), c) for i in range(n) for c in [list(kinds)[i % 3]]]


def gram_list(text):
    raw = " " + " ".join("".join(ch if ord(ch) > 127 or ch.isalpha() else " " for ch in text.lower()).split()) + " "
    raw = raw.encode()
    return [raw[i : i + k] for k in language.SIZES for i in range(len(raw) - k + 1)]


def test_language_equals_sets_of_ngrams(spark):
    docs = lang_docs()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(frame).collect()}
    learn = [d for d in docs if not got[d[0]].held_out]
    counts = {c: Counter(g for _, t, x in learn if x == c for g in gram_list(t)) for c in ("aa", "bb", "cc")}
    share = {c: {g: n / sum(v.values()) for g, n in v.items() if n / sum(v.values()) >= language.FREQUENT} for c, v in counts.items()}
    most = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    sets = {c: {g for g, x in s.items() if x >= language.SHARE * most[g]} for c, s in share.items()}
    for d, text, _ in docs:
        hits = {c: sum(g in s for g in gram_list(text)) for c, s in sets.items()}
        best = max(hits, key=hits.get)
        if not re.search(r"[^\W\d_]", text) or sorted(hits.values())[-1] == sorted(hits.values())[-2]:
            continue
        assert got[d].lang_pred == best
        # false positives of the filters are rare and corrected for
        assert abs(got[d].score - hits[best] / sum(hits.values())) < 0.03


def test_false_positives_are_corrected():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**62, 300_000, dtype=np.uint64) for _ in range(3)]
    found = language.Filters(["a", "b", "c"], np.array([1, 1, 1]), sets)
    probe = rng.integers(0, 2**62, 20_000, dtype=np.uint64)
    hits = np.bitwise_and.reduce([found.slots[at] for at in found.places(probe)])[:, 0]
    for k in range(3):
        seen = ((hits >> np.uint64(k)) & np.uint64(1)).mean()
        assert seen > 0.1 and abs(seen - found.false[k]) < 0.02


@pytest.mark.parametrize("parts", [4, 120])
def test_language_is_one_model_for_one_table(spark, parts):
    docs = lang_docs(120) + [(500, "a", "aa"), (501, "zz", None), (502, None, "bb"), (None, "abc", "aa"), (None, "abc", "aa")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1)
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(language.identify(frame).collect()) == key(language.identify(frame.repartition(parts)).collect())


def test_language_sample_keeps_every_language(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 20)
    got = language.identify(spark.createDataFrame(lang_docs(), "doc_id long, text string, lang string")).collect()
    want = {d: c for d, _, c in lang_docs()}
    assert np.mean([r.lang_pred == want[r.doc_id] for r in got]) > 0.9


def test_shares_of_very_large_tables():
    assert common.limit(1.0) == common.limit(7.0) == (1 << 63) - 1
    for n in (10**4, 10**11, 10**15):
        part = (common.limit(3000 / n) + (1 << 63)) / (1 << 64)
        assert abs(part * n - min(n, 3000)) < 1e-3 * 3000 and common.limit(3000 / n) > -(1 << 63)


def plain_discriminant(x, y, pool, ridge, at=None):
    """Log density differences (of the rows `at`, or of x) by the textbook: inverse and determinant of each shrunken covariance."""
    mid, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mid) / scale
    out = []
    covs = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    both = sum(np.mean(y == c) * covs[c] for c in (0, 1))
    for c in (0, 1):
        s = (1 - pool) * covs[c] + pool * both
        s = (1 - ridge) * s + ridge * np.trace(s) / len(s) * np.eye(len(s)) + 1e-9 * np.eye(len(s))
        d = (z if at is None else (at - mid) / scale) - z[y == c].mean(0)
        out.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1] + np.log(np.mean(y == c)))
    return out[1] - out[0]


def test_quality_equals_an_independent_discriminant(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(200):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(5, 90))]
        docs.append((i, " ".join(w.upper() + "!" if i % 2 and rng.random() < 0.5 else w for w in words)))
        labels.append((i, i % 2))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(frame, marks).collect()}
    learn = [d for d, _ in docs if not got[d].held_out]
    x = np.array([quality.statistics(docs[d][1]) for d in range(200)])
    model = quality.Discriminant(x[learn], np.array([d % 2 for d in learn]))
    raw = model.difference(x)
    want = plain_discriminant(x[learn], np.array([d % 2 for d in learn]), quality.POOL, quality.RIDGE)
    assert np.allclose(raw[learn], want, rtol=1e-6, atol=1e-6)
    assert all(abs(got[d].score - 1 / (1 + np.exp(-np.clip(raw[d] * model.temperature, -500, 500)))) < 1e-9 for d in range(200))


def test_repeated_ids_do_not_unbalance_a_sample(spark):
    docs = [(1, f"copy {k} of one id") for k in range(300)] + [(i, f"text number {i}") for i in range(2, 40)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    for found in (lambda d: quality.score_quality(d, labels), lambda d: toxicity.tag_documents(d, labels)):
        a = sorted((r.doc_id, r.score) for r in found(one).collect())
        assert len(a) == len(docs) and a == sorted((r.doc_id, r.score) for r in found(one.repartition(9)).collect())


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4000)
    monkeypatch.setattr(toxicity, "LONGEST", 500)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows: seen.append(rows) or toxicity.Field())
    docs = [(i, f"w{i} " * (20 if i % 9 else 400)) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    toxicity.fitted(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert 1000 < sum(len(t) for t, _ in seen[0]) < 8000 and max(len(t) for t, _ in seen[0]) <= 500
    assert {y for _, y in seen[0]} == {0, 1}
