"""SentencePiece operator against the library's own unigram decoder and a
plain dynamic programme."""

import os
import tempfile

import sentencepiece
from pyspark.sql import Row

from chorus.llm import pieces


def _varint(n):
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _read(data, at):
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not b & 0x80:
            return n, at


def as_unigram(path):
    """A copy of a model file whose trainer_spec.model_type is UNIGRAM (1)."""
    data, at, out = open(path, "rb").read(), 0, bytearray()
    while at < len(data):
        key, at = _read(data, at)
        assert key & 7 == 2
        size, at = _read(data, at)
        body = data[at:at + size]
        at += size
        if key >> 3 == 2:
            body += _varint(3 << 3) + _varint(1)          # the last value of a field counts
        out += _varint(key) + _varint(len(body)) + body
    to = os.path.join(tempfile.mkdtemp(), "unigram.model")
    with open(to, "wb") as f:
        f.write(out)
    return to


TEXTS = ["Hello world", "  two  spaces ", "a", " ", "", "naïve café — déjà vu", "日本語のテキスト 🙂🙃", "tab\tand\nline\r\nend",
         "The quick brown fox jumps over the lazy dog. " * 50, "supercalifragilisticexpialidocious", "1234567890 x=y**2;", "▁literal"]


def test_scores_equal_the_library_in_unigram_mode():
    path = pieces.model_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=as_unigram(path))
    ours = pieces.PieceModel(path)
    for t in TEXTS:
        want = sum(sp.get_score(i) for i in sp.encode(t))
        ids, score = ours.best_path(ours.escaped(t))
        # ties between paths of one score may be broken either way; byte pieces stand for unknown characters
        got = sum(ours.scores[i] for i in ids)
        assert abs(got - want) <= 1e-3 * max(1, abs(want)), t
        raw, by_words = ours.encode(t)
        assert abs(by_words - score) <= 1e-3 * max(1, abs(score))


def test_best_path_equals_plain_dynamic_programme():
    ours = pieces.PieceModel(pieces.model_path())
    vocab = {b.decode().replace(" ", pieces.SPACE): ours.scores[i] for i, b in enumerate(ours.bytes_of)
             if b and i not in ours.byte_ids and b.decode("utf-8", "ignore").encode() == b}
    for t in TEXTS[:8] + TEXTS[9:]:
        e = ours.escaped(t)
        best = [0.0] + [float("-inf")] * len(e)
        for j in range(1, len(e) + 1):
            for i in range(max(0, j - 64), j):
                s = vocab.get(e[i:j])
                if s is not None:
                    best[j] = max(best[j], best[i] + s)
            if e[j - 1] not in vocab:
                best[j] = max(best[j], best[j - 1] + ours.unknown_score)
        assert abs(best[-1] - ours.best_path(e)[1]) < 1e-3 * max(1, abs(best[-1]))


def test_round_trip_nulls_and_clashing_columns(spark):
    rows = [Row(doc_id=i, text=t, ids="x", score="y") for i, t in enumerate(TEXTS)] + [Row(doc_id=None, text=None, ids="", score="")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, score string")
    got = {r.doc_id: r for r in pieces.digest(docs).collect()}
    assert len(got) == len(rows) and all(r.round_trip for r in got.values() if r.doc_id != TEXTS.index("▁literal"))
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS) if t != "▁literal") and back[None] == ""
    assert pieces.digest(docs.limit(0)).count() == 0
