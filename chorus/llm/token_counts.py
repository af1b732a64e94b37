"""Token counts of whole texts by the whole-token shortcut.

The tokenizer cuts a normalised text into pre-tokens and merges each of them
on its own.  Before any text is read, every vocabulary string that can be a
whole pre-token is merged once; those that come out as one token are the
proven ones (``prove``), a set bounded by the vocabulary, which is broadcast.
Counting then looks a pre-token up: a proven one is one token, all others are
merged, and the number of their tokens is kept for the worker's life
(``CACHE`` entries at most, then forgotten).

White space is dropped by this tokenizer and no pre-token holds any, so a
text is first split at blanks and line ends, and a chunk that a worker has
met is not cut again.  Added tokens (``<|startoftext|>``, ``<|endoftext|>``)
that stand literally in a text are one token each, the library's default.

Cases: null or empty text, and text of white space only, has no token;
repeated rows are counted each; extra columns are not read; an empty table
gives an empty result; a text without any blank is one chunk, however long.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import full_text, small_batches, table, worker_state

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
CACHE = 300_000                  # chunks, and pre-tokens, a worker remembers
CACHED_CHARS = 100               # longer ones are cut anew each time
BLANKS = re.compile("[ \n]+")    # white space to every reading of \\s


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Library:
    """The parts of a tokenizer file: normaliser, cutter, merges, added
    tokens and the mark at a word's end."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or not spec["normalizer"] or any(t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("a BPE tokenizer whose added tokens are found before normalisation is wanted")
        tok = Tokenizer.from_file(path)
        self.normalise, self.cut = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        self.merge = tok.model.tokenize
        self.word_end = spec["model"]["end_of_word_suffix"] or ""
        self.vocabulary = spec["model"]["vocab"]
        self.added = [t["content"] for t in spec["added_tokens"]]


def prove(path: str) -> frozenset[str]:
    """The pre-tokens (as the merges see them) that are one token: every
    vocabulary string with the word-end mark, without that mark, merged."""
    lib = Library(path)
    end = len(lib.word_end)
    whole = (v[:len(v) - end] for v in lib.vocabulary if v.endswith(lib.word_end) and len(v) > end)
    return frozenset(w for w in whole if len(lib.merge(w)) == 1)


class Counter:
    def __init__(self, path: str, proven: frozenset[str]):
        self.lib, self.proven = Library(path), proven
        self.chunks: dict[str, int] = {}
        self.merged: dict[str, int] = {}
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.lib.added)) + ")").split if self.lib.added else None
        self.met = {"whole": 0, "merged": 0}          # pre-tokens by how they were counted

    def pre_token(self, piece: str) -> int:
        if piece in self.proven:
            self.met["whole"] += 1
            return 1
        n = self.merged.get(piece)
        if n is None:
            self.met["merged"] += 1
            n = len(self.lib.merge(piece))
            if len(piece) <= CACHED_CHARS:
                if len(self.merged) >= CACHE:
                    self.merged.clear()
                self.merged[piece] = n
        return n

    def chunk(self, chunk: str) -> int:
        parts = self.split_added(chunk) if self.split_added else [chunk]
        n = len(parts) // 2                            # every second part is an added token
        for part in parts[::2]:
            if part:
                n += sum(self.pre_token(p) for p, _ in self.lib.cut(self.lib.normalise(part)))
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, n = self.chunks, 0
        for c in BLANKS.split(text):
            k = known.get(c)
            if k is None:
                k = self.chunk(c)
                if len(c) <= CACHED_CHARS:
                    if len(known) >= CACHE:
                        known.clear()
                    known[c] = k
            n += k
        return n


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                 limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""
    path = tokenizer or tokenizer_path()
    small_batches(docs.sparkSession)
    proven = docs.sparkSession.sparkContext.broadcast(prove(path))

    @F.arrow_udf("bigint")
    def n_tokens(column: pa.Array) -> pa.Array:
        counter = worker_state(f"token-counts:{path}", lambda: Counter(path, proven.value))
        return pa.array([counter.count(t.as_py()) for t in column], pa.int64())

    t = full_text(text)
    out = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(t).cast("bigint").alias("n_bytes"), n_tokens(t).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
