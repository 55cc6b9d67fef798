import random

import public_tokenizers
import sentencepiece
from evenkeel.llm import tokens

PATH = public_tokenizers.path(tokens.TOKENIZER)


def test_counts_add_up():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    count = tokens.load(PATH)
    rng = random.Random(1)
    letters = ["a", "the", " ", " ", "  ", "\n", "\t", "\r", "▁", "é", "ß", "中", "😀", "<s>", "\x00", ".", "x" * 30, " ", "0", "Ing", "ﬁ", "́", "<0x0A>", "\x0b", "()", "{", "}", ";"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 25)))
        assert sum(count(tokens.pieces_of(text))) == len(model.encode(text)), repr(text)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(tokens, "COMMON", 3)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [None, "", " ", "hello world", "hello world", "a\n\nb  c", "é中😀 <s>", "word " * 30_000, "x" * 20_000, "again " + "y" * 9000, "y" * 9000 + " again " + "y" * 9000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "hello world"), (3, "hello"), (None, "null id"), (None, "another null id"), (None, "null id")]
    frame = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n_tokens int, piece string")
    got = tokens.count_tokens(frame, PATH).collect()
    want = [(d, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for d, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.count_tokens(frame.limit(0), PATH).count() == 0
