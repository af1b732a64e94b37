"""Collocations against a plain version and against the DuckDB twin."""

import collections
import random
import re

import duckdb

from chorus.llm import collocations as CO


def plain(rows, min_count, top, drop):
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    count[lang, tuple(w[i:i + n])] += 1
    candidates = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= min_count}
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        longer = [b for (g, q), b in candidates.items() if g == lang and len(q) > len(p)
                  and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= drop * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = count[lang, p[:k]], count[lang, p[k:]]
            cuts.append((1000000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, v in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(v)[:top], 1))


def corpus():
    rng = random.Random(9)
    vocab = ["new", "york", "city", "Hall", "of", "the", "in", "été", "zoë", "𝒳y", "a-b", "x"] + [f"w{i}" for i in range(30)]
    rows = [(None, None), ("en", ""), ("en", " \t.\n,"), (None, "only words. " * 12), ("und", "only words. " * 12), ("en", "new york city hall " * 30)]
    for i in range(150):
        words = []
        for _ in range(rng.randint(1, 60)):
            words += rng.choice((["New", "York"], ["new", "york", "city"], ["city", "hall", "of"], [rng.choice(vocab)], [rng.choice(vocab)], ["été", "zoë"]))
            if rng.random() < 0.15:
                words.append(rng.choice((".", ",", "\n", "\x0b", "!", "\t", "  ")))
        rows.append((rng.choice(("en", "fr", None)), " ".join(words)))
    return rows + rows[10:40]


def test_equal_plain_version(spark):
    rows = corpus()
    docs = spark.createDataFrame([(g, t, 1, "y", 3) for g, t in rows], "lang string, text string, w1 int, a string, score int").repartition(5)
    for min_count, top, drop, width, pairs in ((10, 2000, 50, None, 10**6), (5, 3, 50, 2, 10**6), (3, 7, 80, 3, 0), (4, 12, 50, 40, 5)):
        got = CO.collocations(docs, min_count=min_count, top=top, drop_percent=drop, width=width, broadcast_pairs=pairs)
        assert sorted(tuple(r) for r in got.collect()) == plain(rows, min_count, top, drop), (min_count, top)
    assert CO.collocations(docs.limit(0)).count() == 0
    assert CO.collocations(docs.filter("text is null")).count() == 0


def test_a_small_frontier_is_not_all_grown(spark, monkeypatch):
    """The first round settles a language without growing every pair."""
    grown = []
    real = CO.stage
    monkeypatch.setattr(CO, "stage", lambda df, name: grown.append(x.count()) or x if (x := real(df, name)) is not None and name == "grow" else x)
    rows = [("en", f"left{i} right{i}. ") for i in range(40) for _ in range(3)] + [("en", f"common w{i % 7}. ") for i in range(210)]
    rows += [("en", f"w{j} v{i}. ") for i in range(7) for j in range(7) for _ in range(4)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = CO.collocations(docs, min_count=3, top=10, width=10).collect()
    assert len(got) == 10 and all(r.score == 1000000 for r in got)
    assert len(grown) == 1 and grown[0] < 40 + 7 + 49


def test_score_arithmetic_is_exact(spark):
    big = 3_000_000_000_000
    row = spark.range(1).select(CO.ratio(CO.F.lit(big - 1), CO.F.lit(big), CO.F.lit(big + 7)).alias("s")).first()
    assert row.s == 1000000 * (big - 1) ** 2 // (big * (big + 7))


def test_duckdb_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(CO.OP12_SQL).fetchall())
    got = sorted(tuple(r) for r in CO.op12_phrase_collocations(spark, sf).collect())
    assert got == want and len(got) > 0
