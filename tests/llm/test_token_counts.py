"""Token counts against the library itself."""

import duckdb
from tokenizers import Tokenizer

from chorus.llm import token_counts as TC

TEXTS = [None, "", " \n\t ", "Hello, World!", "it's we'll DON'T", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>c",
         "été ÀÉ İstanbul ΣΑΣ", "a\x1cb c d​e", "日本語 🙂🙃 ①½ ²", "x" * 5000, "ab" * 40_000, " " * 30_000 + "z",
         "1234567890", "!!!???...", "́ ́a", "don't<|end", "A\r\nB\x0bC\x0cD\x85E", "ﬁ ﬂ Ⅳ", "the the the", "the the the"]


def library_count(tok, text):
    return len(tok.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(spark, sf):
    tok = Tokenizer.from_file(TC.tokenizer_path())
    rows = [(i, t, "u", "v", "w") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes string, tokens string")
    got = {r.doc_id: r for r in TC.count_tokens(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert (got[i].n_tokens, got[i].n_bytes) == (library_count(tok, t), len((t or "").encode())), (i, t and t[:40])
        assert got[i].over_limit == (got[i].n_tokens > 2048)
    assert TC.count_tokens(docs.limit(0)).count() == 0
    real = {r.doc_id: r.n_tokens for r in TC.op11_token_counts(spark, sf).collect()}
    for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall():
        assert real[i] == library_count(tok, t)


def test_proven_strings_and_the_rest():
    path = TC.tokenizer_path()
    tok, proven = Tokenizer.from_file(path), TC.prove(path)
    ascii_words = sorted(w for w in proven if w.isascii() and w.isalpha() and w.islower())
    assert len(ascii_words) > 20_000
    assert all(library_count(tok, w) == 1 for w in ascii_words)
    counter = TC.Counter(path, proven)
    assert counter.count("the qzxqzx the") == library_count(tok, "the qzxqzx the")
    assert counter.met == {"whole": 1, "merged": 1}                   # the second "the" is a chunk already met
    for text in ("Σ" * 300, "word " * 500 + "qqqq" * 500):
        assert counter.count(text) == library_count(tok, text)
