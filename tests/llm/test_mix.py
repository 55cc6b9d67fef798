"""The pipeline's result is the mix up to its budget, with texts."""

import math

import __spark_entry__
import corpus_pipeline as P
from evenkeel.llm import mixing

DOCS = [(i, f"d{i} " * (3 + i % 5), f"s{i % 3}") for i in range(90)] + [(7, "another text of seven", "s1"), (7, "another text of seven", "s1"), (None, "no id", "s1"), (None, "no id either", "s1"), (91, None, None)]


def test_the_mix_ends_at_its_budget_and_has_texts(spark, monkeypatch):
    frame = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    ranked = mixing.mix(frame).collect()
    past = [r for r in ranked if not r.taken and r.size]
    assert past
    monkeypatch.setattr(P, "STAGES", P.STAGES[-1:])
    monkeypatch.setattr(P, "table", lambda *a: frame)
    got = __spark_entry__.queries()["pipeline"](spark, "").collect()
    assert all(r.taken > 0 for r in got)
    assert sum(r.taken for r in got) == math.floor(1.5 * sum(r.size for r in ranked))
    for s, goal in {r.source: r.target for r in ranked}.items():
        assert abs(sum(r.taken for r in got if r.source == s) - goal) <= 2 * max(r.size for r in ranked)
    key = lambda r: (r.doc_id or -1, r.size, r.taken, r.finish)
    assert sorted(map(key, got)) == sorted(key(r) for r in ranked if r.taken)
    assert {(r.doc_id, r.text) for r in got} <= {(d, t) for d, t, _ in DOCS}
    assert all(len(r.text.split()) == r.size and r.passes == -(-r.taken // r.size) for r in got)
    assert [r.finish for r in got] == sorted(r.finish for r in got)


def plain(rows, budget):
    """Passes in order of virtual time until the budget is used up."""
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted({r.source for r in rows}, key=lambda s: (s is None, s or "")))}
    every = sorted((r.finish + e * r.source_size / weights[r.source], r.source or "", e, k) for k, r in enumerate(rows) for e in (0, 1) if r.size)
    taken = [0] * len(rows)
    for *_, k in every:
        part = min(rows[k].size, budget)
        taken[k] += part
        budget -= part
    return taken


def test_virtual_time_decides(spark):
    docs = [(i, "w " * (1 + i * 7 % 13), f"s{i % 4}") for i in range(300)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert [r.taken for r in rows] == plain(rows, math.floor(1.5 * sum(r.size for r in rows)))


def test_very_many_rows_without_an_id(spark):
    docs = [(None, f"text number {i}", "a") for i in range(3000)] + [(1, "x", "b")] * 5
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(frame).collect()
    assert len(rows) == 3005 and len({r.finish for r in rows if r.source == "a"}) == 3000
    assert sum(r.taken for r in rows) == math.floor(1.5 * sum(r.size for r in rows))
    assert mixing.mix(frame.where("text = 'x'"), share=3.0).agg({"taken": "sum"}).first()[0] == 10
