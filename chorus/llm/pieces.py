"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the vocabulary's pieces drives a Viterbi pass
over the text: at each position the output links give every piece that ends
there, and each relaxes the best score of that position from the one where
it starts.  The path of the greatest sum of piece scores wins, pieces found
first (longest first) on ties.  A character that no piece of its own covers
costs ten below the least score and is written as byte pieces.

Spaces are escaped, a dummy prefix is put before the text if the model asks
for it, and a piece holds an escaped space at its front only (checked when
the model is loaded), so the best path of a text is that of its words in a
row; words recur, and at most ``CACHE_WORDS`` of them are kept with their
ids.  A model with other pieces is run over whole texts.

This is the unigram decoder over the scores that the model file has; the
library's merges for a BPE file can give other pieces.  Decoding gives the
text back exactly, for a model that does not normalise, but for the case below.

Cases: null or empty text has no pieces and decodes to empty text; repeated
rows are encoded each; extra columns are not read.  A text that holds the
sign that stands for a space, U+2581, decodes to a space there: the file has
no other spelling for it, and ``round_trip`` is false.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import small_batches, table, worker_state

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CACHE_WORDS = 600_000
UNKNOWN_PENALTY = 10.0


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class PieceModel:
    def __init__(self, path: str):
        import re

        import ahocorasick
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.scores = [sp.get_score(i) for i in range(n)]
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = [0] * 256
        self.unknown = sp.unk_id()
        auto = ahocorasick.Automaton()
        plain = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b], self.bytes_of[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                auto.add_word(piece, (i, len(piece), self.scores[i]))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                plain.append(i)
        auto.make_automaton()
        self.matches = auto.iter
        self.unknown_score = min((self.scores[i] for i in plain), default=0.0) - UNKNOWN_PENALTY
        self.dummy_prefix = sp.encode("a", out_type=str)[0].startswith(SPACE) if plain else True
        self.by_word = all(SPACE not in sp.id_to_piece(i).lstrip(SPACE) for i in plain)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$").findall
        self.single = frozenset(p for i in plain if len(p := sp.id_to_piece(i)) == 1)
        self.known: dict[str, tuple[bytes, float]] = {}
        self.older: dict[str, tuple[bytes, float]] = {}

    def best_path(self, text: str) -> tuple[list[int], float]:
        """Ids and score of the best path over escaped text."""
        n, worst = len(text), float("-inf")
        best, back, ids = [worst] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(text):          # a piece for every character: none is unknown
            for end, (i, size, score) in self.matches(text):
                e = end + 1
                s = best[e - size] + score
                if s > best[e]:
                    best[e], back[e], ids[e] = s, e - size, i
            out, e = [], n
            while e:
                out.append(ids[e])
                e = back[e]
            out.reverse()
            return out, best[n]
        reached = 0
        unknown = self.unknown_score

        def skip(upto):
            # positions no piece of one character covers: an unknown character
            for e in range(reached + 1, upto + 1):
                s = best[e - 1] + unknown
                if not single[e] and s > best[e]:
                    best[e], back[e], ids[e] = s, e - 1, -1

        single = [False] * (n + 2)
        for end, (i, size, score) in self.matches(text):
            e = end + 1
            if e - 1 > reached:
                skip(e - 1)
                reached = e - 1
            s = best[e - size] + score
            if size == 1:
                single[e] = True
            if s > best[e]:
                best[e], back[e], ids[e] = s, e - size, i
        skip(n)
        out, e = [], n
        while e:
            b = back[e]
            if ids[e] >= 0:
                out.append(ids[e])
            else:
                out.extend(self.byte_ids[x] or self.unknown for x in reversed(text[b:e].encode()))
            e = b
        out.reverse()
        return out, best[n]

    def escaped(self, text: str) -> str:
        t = text.replace(" ", SPACE)
        return SPACE + t if self.dummy_prefix and text else t

    def encode(self, text: str | None) -> tuple[bytes, float]:
        """Little-endian 32-bit ids of a text, and its path's score."""
        if not text:
            return b"", 0.0
        t = self.escaped(text)
        words = self.words(t) if self.by_word else [t]
        if len(self.known) > CACHE_WORDS // 2:     # words not met since the last change of halves go
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for w in set(words).difference(known):
            held = older.get(w)
            if held is None:
                ids, score = self.best_path(w)
                held = struct.pack(f"<{len(ids)}I", *ids), score
            known[w] = held
        got = [known[w] for w in words]
        return b"".join([g[0] for g in got]), float(sum(g[1] for g in got))

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.bytes_of[i] for i in ids])
        return (raw[1:] if self.dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def model(path: str) -> PieceModel:
    return worker_state(f"pieces:{path}", lambda: PieceModel(path))


def encode_column(path: str, text: str = "text"):
    """``struct<ids, score>`` of each whole text."""

    @F.arrow_udf("struct<ids:array<int>,score:double>")
    def encode(column: pa.Array) -> pa.Array:
        got = [model(path).encode(t) for t in column.to_pylist()]
        sizes = np.cumsum([0] + [len(g[0]) // 4 for g in got])
        flat = np.frombuffer(b"".join(g[0] for g in got), dtype="<u4").astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))
        return pa.StructArray.from_arrays([ids, pa.array([g[1] for g in got], pa.float64())], names=["ids", "score"])

    return encode(F.col(text))


def decode_column(path: str, ids: str = "ids"):
    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        return pa.array([model(path).decode(x or []) for x in column.to_pylist()], pa.string())

    return decode(F.col(ids))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids, score``."""
    return docs.select(F.col(doc_id).alias("doc_id"), encode_column(path or model_path(), text).alias("e")).select("doc_id", "e.*")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of the output of ``encode``."""
    return encoded.select("doc_id", decode_column(path or model_path()).alias("text"))


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, score, round_trip``: encodes and
    decodes every text in one pass, so ids need not leave the task."""
    where = path or model_path()
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_pieces:bigint,ids_crc32:bigint,score:double,round_trip:boolean>")
    def both(column: pa.Array) -> pa.Array:
        m, out = model(where), []
        for t in column.to_pylist():
            raw, score = m.encode(t)
            back = m.decode(np.frombuffer(raw, dtype="<u4").tolist())
            out.append((len(raw) // 4, zlib.crc32(raw), score, back == (t or "")))
        cols = list(zip(*out)) if out else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          names=["n_pieces", "ids_crc32", "score", "round_trip"])

    return docs.select(F.col(doc_id).alias("doc_id"), both(F.col(text)).alias("e")).select("doc_id", "e.*")


def op2_sentencepiece(spark, sf_dir):
    return digest(table(spark, sf_dir, "documents"))
