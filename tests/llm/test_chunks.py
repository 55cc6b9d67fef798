import random

from evenkeel.llm import chunks


def brute(docs, min_words):
    """Chunk by chunk in the order of doc_id, with the texts' own chunks; another scan than the operator's."""
    out = []
    of = {k: [(t or "").encode()[a:b] for a, b in zip([0, *chunks.cuts((t or "").encode())[:-1]], chunks.cuts((t or "").encode()))] for k, (_, t) in enumerate(docs)}
    for k, (d, t) in enumerate(docs):
        before = {c for j, (e, _) in enumerate(docs) if (e is None, e or 0) < (d is None, d or 0) for c in of[j]}
        text, run, n = b"", [], 0
        for c in [*of[k], None]:
            if c is not None and c in before:
                run.append(c)
                continue
            joined = b"".join(run)
            if len(joined.split()) >= min_words:
                n += len(joined.split())
            else:
                text += joined
            run = []
            if c is not None:
                before.add(c)
                text += c
        out.append((d, t if not t else text.decode(), n))
    return out


def test_brute_force_and_planted_passages(spark):
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passages = [say(60) for _ in range(4)]
    docs = [(i, say(rng.randint(1, 150)) + (" " + rng.choice(passages) + " " + say(40) if i % 3 == 0 else "")) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "x"), (73, docs[2][1]), (None, docs[2][1]), (74, say(30_000)), (75, "ab " * 20_000), (2, docs[2][1])]
    frame = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, again string, h int")
    got = chunks.without_passages(frame)
    assert got.columns == ["doc_id", "text", "again", "h", "spans", "removed_words"]
    rows = got.collect()
    assert sorted([(r.doc_id, r.text, r.removed_words) for r in rows], key=str) == sorted(brute(docs, chunks.MIN_WORDS), key=str)
    clean = {d for d, _ in docs if d is not None and d < 60 and d % 3}
    assert all(r.removed_words == 0 for r in rows if r.doc_id in clean)
    later = {r.doc_id: r.removed_words for r in rows if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 3 == 0}
    assert sum(n > 0 for n in later.values()) >= len(later) - len(passages)
    whole = {d: t for d, t in docs}
    for r in rows:
        if r.spans and r.doc_id not in (2, None):
            raw = whole[r.doc_id].encode()
            assert sum(len(raw[s.begin : s.end].split()) for s in r.spans) == r.removed_words
    assert chunks.without_passages(frame.limit(0)).count() == 0


def test_characters_stay_whole(spark):
    text = "ñandú über 中文字符 😀 " * 60
    other = "ünd " + text + "früher 中"
    got = {r.doc_id: r.text for r in chunks.without_passages(spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")).collect()}
    assert len(got[2]) < len(other) / 2


def test_documents_without_an_id_are_copies_of_others(spark):
    rng = random.Random(12)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200))
    rows = [(None, "one " + passage), (None, "two " + passage), (5, "three " + passage)]
    got = chunks.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.removed_words for r in got if r.doc_id == 5] == [0]
    assert all(r.removed_words > 180 for r in got if r.doc_id is None)
