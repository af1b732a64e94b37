"""Alignment against a plain version that compares all pairs of tokens."""

import collections
import hashlib

import duckdb
import sentencepiece
from tokenizers import Tokenizer

from chorus.llm import token_alignment as TA

TEXTS = [None, "", " ", "Hello world", "  two  spaces ", "naïve café — déjà vu", "日本語のテキスト 🙂🙃", "tab\tand\nline\r\nend\n\n",
         "a <|endoftext|> b </s> <s>", "▁literal mark", "mark ▁ inside", "nul\x00l", "The quick brown fox. " * 40, "aaaa" * 3000, "x" + " " * 4000 + "y",
         "same text", "same text", "１２３ ﬁ Å"]


def plain(texts):
    """Rows of the contract by comparing every end of A with every end of B."""
    tok = Tokenizer.from_file(TA.library_path(TA.LEFT))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=TA.library_path(TA.RIGHT))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    byte_a = lambda i: bytes(of[c] for c in tok.id_to_token(i))

    def byte_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    rows, count = [], collections.Counter()
    for t in texts:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        want = (" " + t).encode() if t else b""
        if b"".join(map(byte_a, a)) != want or b"".join(map(byte_b, b)) != want:
            a, b = [], []
        ends = lambda ids, f: [sum(len(f(x)) for x in ids[:i + 1]) for i in range(len(ids))] if len(ids) < 400 else _ends(ids, f)
        ea, eb = ends(a, byte_a), ends(b, byte_b)
        where = {e: j for j, e in enumerate(eb)}
        links = [(i, where[e]) for i, e in enumerate(ea) if e in where]
        groups, pa, pb = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, a[pa:i + 1])) + "|" + ",".join(map(str, b[pb:j + 1])))
            pa, pb = i + 1, j + 1
        pairs = [(a[i], b[j]) for i, j in links]
        count.update(pairs)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(groups), len(links), pairs, sha))
    top = collections.Counter()
    for (x, y), n in count.items():
        top[y] = max(top[y], n)
    return [(na, nb, g, ln, sum(count[p] == top[p[1]] for p in ps), sum(count[p] for p in ps), sha) for na, nb, g, ln, ps, sha in rows]


def _ends(ids, f):
    out, at = [], 0
    for x in ids:
        at += len(f(x))
        out.append(at)
    return out


def rows_of(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def test_alignment_equals_plain_version(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a int, pairs string")
    want = dict(enumerate(plain(TEXTS)))
    assert rows_of(TA.alignment(docs)) == want
    assert rows_of(TA.alignment(docs.repartition(3), broadcast_pairs=0)) == want          # counts joined by shuffle
    assert want[9][0] == 0 and want[3][2] > 0
    assert TA.alignment(docs.limit(0)).count() == 0


def test_given_documents(spark, sf):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    want = {i: row for (i, _), row in zip(texts, plain([t for _, t in texts]))}
    assert rows_of(TA.op13_token_alignment(spark, sf)) == want
