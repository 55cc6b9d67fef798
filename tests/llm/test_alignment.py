import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from evenkeel.llm import alignment
from evenkeel.llm.common import Scratch

A, B = public_tokenizers.path(alignment.TOKENIZER_A), public_tokenizers.path(alignment.TOKENIZER_B)
LETTERS = ["a", "the", " ", " ", "  ", "\n", "\t", "\r", "▁", "é", "ß", "中", "😀", "<s>", "<|endoftext|>", "\x00", ".", "x" * 30, "0", "Ing", "ﬁ", "́", "<0x0A>", "\x0b", "()", "'s", "'ll", ";", " " * 17, "\x1c", "\x85", "᠎", "​", "\xa0", "　", " "]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def brute(both, text):
    """Groups and links by comparing every token's bytes with every other's; None for a text without tokens."""
    if not text:
        return None
    raw = (" " + text).encode()
    sides = []
    for ids, names in ((both.a.encode(" " + text, add_special_tokens=False).ids, both.bytes_a), (both.b.encode(text), both.bytes_b)):
        if b"".join(names[i] for i in ids) != raw:
            return None
        ends = np.cumsum([len(names[i]) for i in ids]).tolist()
        sides.append(list(zip(ids, [0, *ends], ends)))
    a, b = sides
    links = [(i, j) for i, lo, hi in a for j, low, high in b if max(lo, low) < min(hi, high)]
    groups, begin = [], 0
    for end in sorted({x[2] for x in a} & {x[2] for x in b}):
        groups.append("|".join(",".join(str(i) for i, _, hi in side if begin < hi <= end) for side in sides))
        begin = end
    return len(a), len(b), ";".join(groups), links


def test_one_text_at_a_time(aligner, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 20_000)
    rng = random.Random(1)
    for _ in range(150):
        texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 15))) or None for _ in range(20)]
        numbers, groups, ends, pairs, times = aligner.batch(texts)
        for k, text in enumerate(texts):
            n_a, n_b, want, links = brute(aligner.both, text) or (0, 0, "", [])
            at = slice(ends[k - 1] if k else 0, ends[k])
            got = Counter({(p // aligner.width, p % aligner.width): n for p, n in zip(pairs[at].tolist(), times[at].tolist())})
            assert (numbers[:, k].tolist(), groups[k], got) == ([n_a, n_b, len(want.split(";")) if want else 0, len(links)], want, Counter(links)), repr(text)


@pytest.mark.parametrize("partial", [50, 1 << 20])
def test_query(spark, tmp_path, aligner, monkeypatch, partial):
    monkeypatch.setattr(alignment, "PARTIAL", partial)
    rng = random.Random(2)
    words = ["the", "alignment", "of", "tokens", "straße", "中文", "qzxv", "1234", "don't", "\n", "  "]
    texts = [None, "", " ", "▁", "has ▁ mark", "hello <|endoftext|> <s>", "x" * 5000, "word " * 5000] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[9]), (None, texts[9])]
    frame = spark.createDataFrame([(d, t, 1, "x", [2]) for d, t in rows], "doc_id long, text string, N_A int, `a.b` string, Pairs array<int>")
    frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    each = [(d, brute(aligner.both, t) or (0, 0, "", [])) for d, t in rows]
    counts = Counter(p for _, (*_, links) in each for p in set(links))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    want = []
    for d, (n_a, n_b, groups, links) in each:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        want.append((d, n_a, n_b, len(groups.split(";")) if groups else 0, len(links), digest, sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links)))
    got = alignment.op11(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_counts_table_and_no_rows(spark, aligner):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a c", "b", None])], "doc_id long, text string")
    scratch = Scratch(spark)
    rows = scratch.write(alignment.align(frame, A, B))
    counts = alignment.PairCounts(rows, aligner.width, scratch)
    want = Counter(p for t in ("a b", "a c", "b") for p in set(brute(aligner.both, t)[3]))
    assert {(r.a, r.b): r.n for r in counts.table(spark).collect()} == want
    none = scratch.write(alignment.align(frame.limit(0), A, B))
    empty = alignment.PairCounts(none, aligner.width, scratch)
    assert empty.table(spark).count() == 0
    assert empty.scores(none.withColumn("groups_sha256", none.groups)).count() == 0
    # texts without any tokens: no shards, and rows of zeros
    blank = scratch.write(alignment.align(frame.where("doc_id = 3"), A, B))
    got = alignment.PairCounts(blank, aligner.width, scratch).scores(blank.withColumn("groups_sha256", blank.groups)).collect()
    assert [tuple(r) for r in got] == [(3, 0, 0, 0, 0, "", 0, 0)]
    scratch.close()


def test_lookup_over_shards_and_batches(tmp_path):
    """Keys found in the right file and batch, whatever their number."""
    keys = np.unique(np.random.default_rng(1).integers(0, 10**9, 5000))
    files = []
    for k, part in enumerate(np.array_split(keys, 7)):
        batches = [alignment.pa.record_batch([x, x % 97], names=["pair", "n"]) for x in np.array_split(part, 3)]
        rows = [r for b in alignment.shard_writer(f"{tmp_path}/s", 1000)(iter(batches)) for r in b.to_pylist()]
        files.append((rows[0]["first"], rows[0]["last"], rows[0]["file"]))
    shards = alignment.Shards(f"{tmp_path}/s", files)
    for some in (keys, keys[::13], keys[:1], keys[-1:], keys[:0]):
        assert (shards.counts(some) == some % 97).all()
