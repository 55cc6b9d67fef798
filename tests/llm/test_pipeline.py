"""The pipeline against brute force, stage by stage, and over its edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import corpus_pipeline as P
import numpy as np
from evenkeel.llm import lines, quality
from test_jaccard import brute as similar
from test_lines import brute as line_brute
from test_models import plain_discriminant


def leaks(text, item):
    """Whether a window of the item's length has weighted 5-word shingles that are 0.8 alike, by going through all of them."""
    plain = lambda t: [w for w in (x.strip(".,;:!?\"'()[]{}*#%$&|-_<>/\\") for x in t.lower().split()) if w]
    bag = lambda w: Counter(tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4)) if w)
    words, theirs, size = plain(text), bag(plain(item)), len(plain(item))
    for at in range(1 - size, len(words)):
        mine = bag(words[max(at, 0) : at + size])
        if mine and sum((mine & theirs).values()) >= 0.8 * sum((mine | theirs).values()):
            return True
    return False


def mixed(rows):
    """(id, text, words taken) of a mix to 150 % of all words, pass by pass in order of virtual time."""
    size = lambda r: len((r.text or "").split())
    name = lambda r: f"mix-1:{'' if r.doc_id is None else r.doc_id}:{r.text or ''}"
    every, budget = [], sum(map(size, rows)) * 3 // 2
    for k, source in enumerate(sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))):
        mine = sorted((r for r in rows if r.source == source), key=lambda r: hashlib.md5(name(r).encode()).hexdigest())
        end, whole = 0, sum(map(size, mine))
        for r in mine:
            end += size(r)
            every += [((end + e * whole) / (3, 1, 2)[k % 3], source or "", e, r) for e in (0, 1) if size(r)]
    taken = Counter()
    for *_, r in sorted(every, key=lambda x: x[:3]):
        part = min(size(r), budget)
        taken[str(r.doc_id), r.text] += part
        budget -= part
    return sorted((d, t, n) for (d, t), n in taken.items() if n)


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = say(40)
    docs = []
    for i in range(240):
        text = "\n".join(say(rng.randint(8, 30)) + "." for _ in range(rng.randint(2, 6)))
        if i % 5 == 0:
            text = text.upper().replace(" ", "!! ")
        elif i % 7 == 0:
            text += "\nThis line of boilerplate is in many of them."
        elif i % 11 == 0:
            text += "\n" + item + "\n" + say(9)
        elif i % 13 == 1 and docs:
            text = docs[-1][1].replace("a", "o", 1)
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
    docs += [(500, None, None, None, None), (501, "", "en", "s1", 0), (None, say(50), "en", "s1", 9), (7, docs[7][1], "en", "s1", 9)]
    folder = str(tmp_path)
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kinds).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(240) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    now = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)
    for k, (name, stage) in enumerate(P.STAGES):
        before = now.collect()
        out = stage(spark, now, folder)
        if k < len(P.STAGES) - 1:
            assert out.columns == now.columns
            out.write.parquet(f"{folder}/stage{k}")
            out = spark.read.parquet(f"{folder}/stage{k}")
        after = out.collect()
        if name == "quality_filter":
            label = {i: int(i % 5 != 0) for i in range(240) if i % 2}
            learn = [r for r in before if r.doc_id in label and zlib.crc32(str(r.doc_id).encode()) % 5]
            learn = sorted({r.doc_id: min(quality.statistics(s.text) for s in learn if s.doc_id == r.doc_id) for r in learn}.items())
            x, y = np.array([v for _, v in learn]), np.array([label[d] for d, _ in learn])
            at = plain_discriminant(x, y, quality.POOL, quality.RIDGE, np.array([quality.statistics(r.text) for r in before]))
            scores = 1 / (1 + np.exp(-np.clip(at * quality.Discriminant(x, y).temperature, -500, 500)))
            assert key(after) == key([r for r, s in zip(before, scores) if s >= quality.CUT])
            assert not [r for r in after if r.doc_id is not None and r.doc_id < 240 and r.doc_id % 5 == 0]
        elif name == "line_dedup":
            want = [(d, t) for (d, t, n) in line_brute([(r.doc_id if r.doc_id is not None else 1 << 62, r.text) for r in before], lines.MIN_WORDS) if not n or (t or "").split()]
            assert key(after) == sorted((((None if d == 1 << 62 else d), t) for d, t in want), key=str)
        elif name == "jaccard_dedup":
            parts = similar([(r.doc_id, r.text) for r in before], 5, 80)
            heads = {d for d, n, c in parts if n and d is not None and d == c}
            assert sorted(r.doc_id for r in after if r.doc_id is not None and (r.text or "").split()) == sorted(heads)
            assert sum(r.doc_id is None or not (r.text or "").split() for r in after) == sum(r.doc_id is None or not (r.text or "").split() for r in before)
        elif name == "decontamination":
            leaked = [r for r in before if leaks(r.text or "", item)]
            assert leaked and key(after) == key([r for r in before if r not in leaked])
        else:
            assert sorted((str(r.doc_id), r.text, r.taken) for r in after) == mixed(before)
            assert all(r.passes == -(-r.taken // r.size) and r.size == len(r.text.split()) for r in after)
        now = out
    assert sorted(map(str, P.run(spark, folder).collect())) == sorted(map(str, now.collect()))
