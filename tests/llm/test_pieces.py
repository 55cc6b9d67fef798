import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from evenkeel.llm import pieces

PATH = public_tokenizers.path(pieces.TOKENIZER)
LETTERS = ["a", "the", " ", " ", "  ", "\n", "\t", "\r", "▁", "é", "ß", "中", "😀", "<s>", "</s>", "\x00", ".", "x" * 30, "0", "Ing", "ﬁ", "́", "<0x0A>", "\x0b", "()", "{", " " * 17, "=" * 20, "-", "/", "*", "　", "\xa0"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_are_the_librarys(model, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 20_000)
    monkeypatch.setattr(pieces, "PAIRS", 500)
    table = pieces.PrefixTable(PATH)
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 25)))
        assert pieces.np.frombuffer(table.ids(text), pieces.np.int32).tolist() == model.encode(text), repr(text)


def test_each_prefix_has_one_fitting_last_token(model):
    """What the method rests on: of the tokens that end a prefix, one fits the token before it."""
    table = pieces.PrefixTable(PATH)
    rng = random.Random(2)
    for _ in range(200):
        text = table.model.normalize("".join(rng.choice("thea ing.no") for _ in range(12)))
        last = {0: None}
        for stop in range(1, len(text) + 1):
            ends = [(start, table.model.piece_to_id(text[start:stop])) for start in range(stop) if text[start:stop] in table.score and table.merged(text[start:stop]) == [text[start:stop]]]
            fit = [t for start, t in ends if last[start] is None or table.pair_fits(last[start], t)]
            assert len(fit) == 1
            last[stop] = fit[0]


def test_documents(spark, model):
    texts = [None, "", " ", "  two", "hello world", "hello world", "a\n\nb  c", "é中😀 <s> </s>", "word " * 30_000, "x" * 20_000, "中文" * 9000, "▁lead", "\x00", "trail \n "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "hello world"), (4, "hello"), (None, "null id"), (None, "null id")]
    frame = spark.createDataFrame([(d, t, [1], "k", 1) for d, t in rows], "doc_id long, text string, ids array<int>, `a.b` string, TOKENS int")
    out = pieces.decode(pieces.encode(frame, PATH), PATH)
    got = [(r.doc_id, r.ids, r.text) for r in out.collect()]
    ids = [model.encode(t or "") + [model.eos_id()] for _, t in rows]
    assert sorted(got, key=str) == sorted([(d, i, model.decode(i)) for (d, _), i in zip(rows, ids)], key=str)
    assert pieces.decode(pieces.encode(frame.limit(0), PATH), PATH).count() == 0


def test_decodes_any_ids(spark, model):
    rng = random.Random(3)
    rows = [[rng.randrange(model.vocab_size()) if rng.random() < 0.6 else rng.randrange(3, 259) for _ in range(rng.randrange(0, 12))] for _ in range(300)]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(999, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in pieces.decode(frame, PATH).collect()}
    assert got.pop(999) is None
    for i, r in enumerate(rows):
        # a control id hides from the library that what follows is the beginning; encode never puts one there
        if not any(model.is_control(x) for x in r):
            assert got[i] == model.decode(r), r


def test_query(spark, model, tmp_path):
    texts = ["one text", None, "", "ends \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in pieces.op13(spark, str(tmp_path)).collect():
        ids = model.encode(texts[r.doc_id] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())


def test_the_query_takes_one_worker_a_task_and_one_table_a_worker(spark, model, tmp_path):
    texts = ["one text", None, "", " two  ", "é中😀 <s>", "ends \n"] * 8
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    assert pieces.op13(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.doc_id: (r.ids, r.text) for r in pieces.round_trip(spark.read.parquet(f"{tmp_path}/documents.parquet"), PATH).collect()}
    assert got == {i: (ids := model.encode(t or "", add_eos=True), model.decode(ids)) for i, t in enumerate(texts)}
    assert pieces.prefix_table(PATH) is pieces.prefix_table(PATH)
    assert list(pieces.decoded(pieces.encoded(iter([]), PATH), PATH)) == []
