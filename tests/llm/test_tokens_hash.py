import public_tokenizers
import sentencepiece
import xxhash
from evenkeel.llm import tokens

PATH = public_tokenizers.path(tokens.TOKENIZER)


def test_texts_of_one_id_whose_short_hashes_are_equal(spark):
    seen: dict[int, str] = {}
    for i in range(1 << 20):
        text = f"{i} " * (1 + i % 9)
        if other := seen.get(h := xxhash.xxh32_intdigest(text.encode())):
            break
        seen[h] = text
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pair = [(None, other), (None, text)]
    assert len(model.encode(other)) != len(model.encode(text))
    got = tokens.count_tokens(spark.createDataFrame(pair, "doc_id long, text string"), PATH).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len(t), len(model.encode(t))) for _, t in pair)
