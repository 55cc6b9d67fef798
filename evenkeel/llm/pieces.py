"""Operator 13: exact merge-type sentencepiece ids by a table of last tokens, and texts back from ids."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, parts_by_bytes, table

TOKENIZER = "piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of segments and ids that a worker process remembers, once among those met of late and once among those before;
#: characters from which a segment isn't remembered; pairs of tokens that it remembers until it forgets all.
REMEMBERED, LONG, PAIRS = 40 << 20, 1 << 10, 300_000


class PrefixTable:
    """Encoder of one merge-type vocabulary.

    A token sequence is what merging gives exactly if each two neighbours are what merging gives
    for their own text, so every prefix of a text has one last token that fits the last token of
    what stands before it. Those are stored by prefix, and the ids are read from the end.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.vocab_size())
        self.bytes_from = self.model.piece_to_id("<0x00>")
        special = [i for i in ids if self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)]
        plain = {self.model.id_to_piece(i): i for i in sorted(set(ids) - set(special))}
        letters = {c for p in plain for c in p}
        if any(self.model.is_unused(i) for i in plain.values()) or not self.model.is_byte(self.bytes_from) or letters - set(plain):
            raise ValueError("needs a merge-type model with byte pieces, without unused pieces, that has each of its characters as a piece")
        self.text = {i: p for p, i in plain.items()}
        self.sizes = {i: len(p) for p, i in plain.items()}
        self.score = {p: self.model.get_score(i) for p, i in plain.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in plain.items():
            if self.merged(p) == [p]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        # where no piece has a space mark or line feed inside, no merge goes over the start of a run of marks, or a line feed
        cuts = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in plain)
        self.segments = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if cuts else "(?s:.+)").findall
        self.n, self.fits = len(ids), {}
        self.held: dict[str, bytes] = {}
        self.older, self.size = self.held, 0

    def merged(self, text: str) -> list[str]:
        """What merging gives for a few characters: the best pair first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pair_fits(self, left: int, right: int) -> bool:
        key = left * self.n + right
        out = self.fits.get(key)
        if out is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            a, b = self.text[left], self.text[right]
            out = self.fits[key] = self.merged(a + b) == [a, b]
        return out

    def segment_ids(self, text: str) -> list[int]:
        """Ids of a text in the model's normal form."""
        last = array("i", bytes(4 * len(text) + 4)) if len(text) > 1 << 16 else [0] * (len(text) + 1)
        known, n, sizes = self.fits.get, self.n, self.sizes
        for end, (size, token) in self.automaton.iter(text):
            stop = end + 1
            if not last[stop]:
                left = last[stop - size]
                # nothing before it, or a character that no piece has
                if not left:
                    last[stop] = token
                    continue
                fit = known(left * n + token)
                if fit or fit is None and self.pair_fits(left, token):
                    last[stop] = token
        out, at = [], len(text)
        while at:
            token = last[at]
            if token:
                out.append(token)
                at -= sizes[token]
            else:
                at -= 1
                out.extend(self.bytes_from + b for b in reversed(text[at].encode()))
        out.reverse()
        return out

    def ids(self, text: str) -> bytes:
        """Ids of a text, as 32-bit numbers in a row."""
        segments = self.segments(self.model.normalize(text)) if text else []
        found = list(map(self.held.get, segments))
        if None in found:
            found = [self.fresh(s) if raw is None else raw for s, raw in zip(segments, found)]
        return b"".join(found)

    def fresh(self, segment: str) -> bytes:
        """Ids of a segment that isn't among those met of late; it is from now on."""
        raw = self.held.get(segment) or self.older.get(segment)
        if raw is None:
            raw = array("i", self.segment_ids(segment)).tobytes()
            if len(segment) > LONG:
                return raw
        self.size += len(segment) + len(raw) + 200
        if self.size > REMEMBERED:
            self.older, self.held, self.size = self.held, {}, 0
        self.held[segment] = raw
        return raw


@lru_cache(maxsize=1)
def prefix_table(path: str) -> PrefixTable:
    """One for a worker process, which hands what it remembers on from task to task."""
    return PrefixTable(path)


@lru_cache(maxsize=1)
def piece_bytes(path: str) -> pa.Array:
    """What each id gives in a decoded text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first = model.piece_to_id("<0x00>")
    pieces = [bytes([i - first]) if model.is_byte(i) else b"" if model.is_control(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(model.vocab_size())]
    if model.unk_id() >= 0:
        pieces[model.unk_id()] = model.decode([model.unk_id()]).encode()
    return pa.array(pieces, pa.binary())


def encoded(batches, path: str):
    """Batches that begin with doc_id and have a text, to doc_id and ids."""
    encoder = prefix_table(path)
    end = np.array([encoder.model.eos_id()], np.int32).tobytes()
    for whole in batches:
        for batch in parts_by_bytes(whole):
            rows = [encoder.ids(t or "") + end for t in column(batch, "text")]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(rows))])
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "ids"])


def decoded(batches, path: str):
    """Batches of doc_id and ids, to those with the text."""
    pieces = piece_bytes(path)
    for batch in batches:
        ids = batch.column(1)
        parts = pa.ListArray.from_arrays(ids.offsets, pieces.take(ids.values))
        raw = pc.binary_join(parts, b"").to_pylist()
        texts = [None if not known.as_py() else _text(r[1:] if r[:1] == b" " else r) for r, known in zip(raw, ids.is_valid())]
        yield pa.record_batch([batch.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each document's whole text, the end id last.

    As the sentencepiece library gives them for the model at `path`, which must be of merge type
    with byte pieces. No shuffle: a worker process remembers the ids of segments that no merge can cross (a run
    of spaces with the word after it), up to twice REMEMBERED bytes. A text is held whole, with some 60 bytes
    a character of the longest segment. Needs doc_id and text; other columns are ignored. A null text
    counts as empty: the end id alone. Null, equal and repeated doc_id: a row each. No rows: no rows.
    """
    return _texts(docs).mapInArrow(lambda batches: encoded(batches, path), "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows (doc_id and ids) with the text of the ids, as the library's decode gives it.

    Pieces are put together, control ids give nothing, and one space that begins the text is the
    model's own and goes. Bytes that aren't UTF-8 become U+FFFD, one each. Null ids: null text; an
    id that the model doesn't have is an error. No rows: no rows.
    """
    return rows.select("doc_id", "ids").mapInArrow(lambda batches: decoded(batches, path), "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """What decode gives for what encode gives: doc_id, ids and text, by one worker process for a task instead of two."""
    return _texts(docs).mapInArrow(lambda batches: decoded(encoded(batches, path), path), "doc_id long, ids array<int>, text string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out = []
        while raw:
            try:
                out.append(raw.decode())
                break
            except UnicodeDecodeError as e:
                out.append(raw[: e.start].decode() + "�")
                raw = raw[e.start + 1 :]
        return "".join(out)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    rows = round_trip(table(spark, sf_dir, "documents"), path)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
