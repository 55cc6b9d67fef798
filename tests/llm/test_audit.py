import random
import re
from itertools import permutations

import numpy as np
from evenkeel.llm import audit


def brute(docs, labels):
    """Every order applied to every document, one step after the other."""
    failing = {}
    for k, (doc_id, text, _) in enumerate(docs):
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        f = set()
        if len(words) < 100:
            f.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            f.add("C")
        if set(text) & set("#$%&*|"):
            f.add("D")
        if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs):
            f.add("E")
        failing[k] = f
    out = {}
    for part in {lang or "" for *_, lang in docs}:
        rows = [k for k, (*_, lang) in enumerate(docs) if (lang or "") == part]
        good, toxic = ({k for k in rows if any(d == docs[k][0] and d is not None and x[m] == 1 for d, *x in labels)} for m in (0, 1))
        for order in map("".join, permutations("ABCDE")):
            left = set(rows)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if f in failing[k]}
                fails = {k for k in rows if f in failing[k]}
                left -= gone
                out[part, order, step] = [len(left), len(gone), len(fails) - len(gone), sum(failing[k] == {f} for k in rows), len(gone & good), len(gone & toxic)]
        for f in "ABCDE":
            steps = [key for key in out if key[0] == part and key[1][key[2] - 1] == f]
            total = sum(out[key][1] for key in steps)
            for key in steps:
                out[key].append(total)
    return out


def frames(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "x", True) for r in docs], "doc_id long, text string, lang string, MASK int, `a.b` string, Good boolean")
    return d, spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, part int")


def test_against_every_order(spark):
    rng = random.Random(1)
    texts = [None, "", " ", " \n lead", "trail\t", "A B C", "abc # d", "é" * 40, "word " * 120, " ".join(str(i) for i in range(130)), " ".join("W%d" % i for i in range(110)), "x" * 100_000]
    texts += [" ".join(rng.choice(["a", "Bee", "see", "D", "e$", "long"]) + str(rng.randrange(60)) for _ in range(rng.randrange(80, 140))) for _ in range(40)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(160)]
    docs += [(7, docs[7][1], "en"), (7, docs[7][1], "en"), (8, "other", "de"), (None, texts[9], "en"), (None, texts[9], None), (None, "", "fr"), (-3, texts[9], "en"), (500, None, "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (9999, 1, 1)]
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in audit.audit(*frames(spark, docs, labels)).collect()}
    assert got == brute(docs, labels)


def test_no_rows(spark):
    docs, labels = frames(spark, [(1, "a", "en")], [(1, 1, 1)])
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert audit.audit(docs, labels.limit(0)).count() == 600


def test_inversion():
    """Exact patterns come back from joint failures."""
    exact = np.random.default_rng(1).integers(0, 50, 32)
    joint = np.array([sum(exact[t] for t in range(32) if t & s == s) for s in range(32)])
    assert (audit.moebius() @ joint == exact).all()
