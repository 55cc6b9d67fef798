"""Columns of any names reach the other end of every operator that keeps columns."""

import corpus_pipeline
import pytest
from evenkeel.llm import chunks, decontaminate, jaccard, lines

ODD = ["Key", "H", "AGAIN", "a.b", "row", "_other0", "again_doc", "kept_id"]
PASSAGE = " ".join(f"word{k}" for k in range(40))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [PASSAGE, PASSAGE + " more", "quite another text with words " * 3, None, "", f"{PASSAGE}\nline of words that is here"]
    rows = [(i, t, "en", "s", *[f"{c}{i}" for c in range(len(ODD))]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "Doc_ID long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in ODD)).cache()


def kept(before, after):
    """The other columns of each row are those that it had."""
    want = {r[0]: r[2:] for r in before.collect()}
    rows = [r.asDict() for r in after.collect()]
    assert len(rows)
    for r in rows:
        assert tuple(r[c] for c in before.columns[2:]) == tuple(want[r["Doc_ID"]])


def test_operators(spark, docs):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    for out in (lines.without_repeats(docs), chunks.without_passages(docs), jaccard.keep_one(docs), decontaminate.drop_leaks_of(docs, items)):
        assert out.columns[: len(docs.columns)] == docs.columns
        kept(docs, out)


def test_replaced_in_any_case(docs):
    odd = docs.withColumn("Removed", docs.lang).withColumn("SPANS", docs.lang)
    assert lines.without_repeats(odd).columns == [*docs.columns, "SPANS", "removed"]
    assert chunks.without_passages(odd).columns == [*docs.columns, "Removed", "spans", "removed_words"]


def test_pipeline(spark, docs, tmp_path):
    labels = [(i, i % 2, 0) for i in range(6)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing like it at all in here anywhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = out
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns
        if out.count():
            kept(before, out)
    assert "text" in corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).columns
