import random

import pytest
from evenkeel.llm import lines
from evenkeel.llm.common import Scratch


def brute(docs, min_words):
    """Maximal runs along the diagonals of all pairs of equal non-blank lines."""
    order = sorted({(d, t) for d, t in docs}, key=lambda x: x[0])
    seqs = {x: [(k, tuple(line.split())) for k, line in enumerate((x[1] or "").split("\n")) if line.split()] for x in order}
    out = {}
    for n, x in enumerate(order):
        gone, seq = set(), seqs[x]
        for y in order[: n + 1]:
            other = seqs[y]
            for shift in range(1 if y == x else 1 - len(other), len(seq)):
                run = []
                for i in range(max(0, shift), len(seq) + 1):
                    j = i - shift
                    if i < len(seq) and j < len(other) and seq[i][1] == other[j][1]:
                        run.append(seq[i])
                        continue
                    if sum(len(s) for _, s in run) >= min_words:
                        gone |= {at for at, _ in run}
                    run = []
        parts = None if x[1] is None else x[1].split("\n")
        out[x] = (None if parts is None else "\n".join(p for k, p in enumerate(parts) if k not in gone), len(gone))
    return [(d, *out[d, t]) for d, t in docs]


def removed(spark, texts, min_words=5):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, lines.without_repeats(frame, min_words).collect()))
    assert got == brute(list(enumerate(texts)), min_words)
    return [n for _, _, n in got]


def test_words_are_those_of_the_maximal_run(spark):
    assert removed(spark, ["a b\nc d\ne f\nu1", "v2\na b\nc d\ne f\nw2"]) == [0, 3]
    assert removed(spark, ["a b\nc d\nu1", "v2\na b\nc d\nw2"]) == [0, 0]
    assert removed(spark, ["\n".join("abcdefg"), "x\n" + "\n".join("abcdefg") + "\ny", "bcd\ne"]) == [0, 7, 0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_of_every_length(spark, seed):
    rng = random.Random(seed)
    base = [f"l{i}" for i in range(70)]
    texts = []
    for _ in range(25):
        text = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(len(base))
            text += base[a : a + rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 13, 17, 33])] + [f"own{rng.random()}"] * rng.randint(0, 1)
        texts.append("\n".join(text))
    removed(spark, texts, rng.choice([3, 5, 11]))


def test_two_equal_documents_of_very_many_lines(spark):
    text = "\n".join(f"line {i}" for i in range(2_500))
    frame = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    scratch = Scratch(spark)
    rows = scratch.write(lines.line_rows(frame.selectExpr("doc_id as doc", "1L as h", "text")))
    assert lines.repeated_runs(rows, 5, scratch).count() <= 2_500
    scratch.close()
    assert {r.doc_id: r.removed for r in lines.without_repeats(frame).collect()} == {1: 0, 2: 2_500}


def test_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(1, 7))) for _ in range(14)]
    docs = []
    for i in range(40):
        text = [rng.choice([*pool, "", f"own {i} {rng.random()} x y z"]) for _ in range(rng.randint(1, 14))]
        docs.append((i, "\n".join(text)))
    docs += [(90, docs[3][1]), (91, docs[3][1] + "\nmore"), (92, None), (93, ""), (94, "\n\n"), (3, docs[3][1]), (95, ("same line of six words here\n" * 400)[:-1])]
    frame = spark.createDataFrame([(d, t, "k", 5, 1) for d, t in docs], "doc_id long, text string, name string, i int, gone int")
    got = lines.without_repeats(frame, 5)
    assert got.columns == ["doc_id", "text", "name", "i", "gone", "removed"]
    assert sorted(map(tuple, got.select("doc_id", "text", "removed").collect()), key=str) == sorted(brute(docs, 5), key=str)
    assert lines.without_repeats(frame.limit(0)).count() == 0


def test_null_doc_id_is_last(spark):
    frame = spark.createDataFrame([(None, "one two three four five six"), (8, "one two three four five six")], "doc_id long, text string")
    assert sorted(map(tuple, lines.without_repeats(frame).collect()), key=str) == [(8, "one two three four five six", 0), (None, "", 1)]
