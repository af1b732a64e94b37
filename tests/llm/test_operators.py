"""Operators against brute force on small fixtures, with the odd rows: nulls,
empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.llm import (exact_dedup, jaccard_join, language_id, line_crf, packing, quality_model, suffix_dedup, url_filter, warc)
from chorus.llm.grouping_sort import neighbour_matches, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ref string, kept string, rank int, n string"


def docs_of(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i), "s", len(t) if t else 0, "x", "y", "z", 0, "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = ["of", "the", "and"] + ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = words(120), words(90)
    out = [None, "", " \n\t ", "...", "one", "one two three", "ONE  two three", words(3000)]
    for _ in range(25):                                   # near copies at every distance about the threshold
        w = base.split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    out += [words(rng.randint(5, 200)) for _ in range(25)]
    out += [words(30) + " " + passage + " " + words(30) for _ in range(6)]
    out += ["on he. Is " * 200, words(20) + " on he. Is" * 150, base, base]
    return out


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    odd = docs_of(spark, [None, "", "123 !?", "the of and"], {3: "en"})
    assert {r.doc_id: r.lang_pred for r in language_id.identify(odd).collect()} == {0: "und", 1: "und", 2: "und", 3: "en" if not _out(3) else "und"}
    assert language_id.identify(odd.limit(0)).count() == 0


def _out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_phrases_equal_plain_cross_parsing():
    samples = [("a", "the cat sat on the mat and the hat"), ("b", "le chat est sur la table et le chapeau")]
    model = language_id.PhraseModel(samples)
    for text in ("the chat on la table", "zebra the", "cat", "x" * 3000 + " the cat"):
        symbols, first = language_id.read_symbols([text], model.classes())
        want = []
        for lang, sample in samples:
            known, _ = language_id.read_symbols([sample], model.classes())
            hay, s, n = known.tolist(), symbols.tolist(), 0
            subs = {tuple(hay[i:j]) for i in range(len(hay)) for j in range(i + 1, len(hay) + 1)}
            for a in range(0, len(s), language_id.SEGMENT):
                piece, at = s[a:a + language_id.SEGMENT], 0
                n, cur = n + 1, ()
                for c in piece:
                    if (*cur, c) in subs:
                        cur = (*cur, c)
                    else:
                        n, cur = n + 1, ((c,) if (c,) in subs else ())
            want.append(n)
        assert model.phrases(symbols, first)[0].tolist() == want


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.net/en/x?q#f", "https://a.example.net/de/", "ftp://x.example.com/de/1", "http://b.org/fr/",
            "http://org.fr/fr/", "http://notexample.net", "http://h?x/y", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(3, urls[3])], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.labelled_table(spark)).collect()}
    assert [got[i].host for i in range(len(urls))] == ["", "", "", "example.net", "a.example.net", "x.example.com", "b.org", "org.fr", "notexample.net", "h", "b:"]
    assert [got[i].path for i in range(len(urls))] == ["", "", "", "/en/x", "/de/", "/de/1", "/fr/", "/fr/", "", "", "//c/d"]
    assert [got[i].rule for i in range(3, 9)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None]
    assert [got[i].verdict for i in range(3, 7)] == ["allow", "block", "block", "allow"]
    assert all(r.verdict in ("allow", "block") for r in got.values())
    weights, bias = url_filter.train(url_filter.labelled_table(spark))
    known = url_filter.judge(spark.createDataFrame(url_filter.LABELLED_URLS, "url string, page_id long"), url_filter.labelled_table(spark), rules=())
    assert known.filter((F.col("verdict") == "block") != (F.col("page_id") == 1)).count() == 0
    assert url_filter.judge(pages.limit(0), url_filter.labelled_table(spark)).count() == 0


def test_packing(spark, texts):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(packing.tokenizer_path())
    coder.encode_special_tokens = True
    docs = docs_of(spark, texts)
    got = packing.pack(docs, window=256).collect()
    ids = {i: np.array(coder.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in enumerate(texts)}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    for i in ids:
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    pad = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        pad += 0 if at & (at - 1) == 0 else 256 - at
    assert pad <= 0.02 * sum(map(len, ids.values()))
    some = packing.with_ids(docs, packing.pack(docs, window=256)).filter("length < 50").limit(5).collect()
    assert all(r.ids == ids[r.doc_id][r.start:r.start + r.length].tolist() for r in some)
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(docs.unionByName(docs)).agg(F.sum("length")).first()[0] == 2 * sum(map(len, ids.values()))


def test_warc(spark):
    html = [None, "", "a\r\n\r\nb", "x\r\n", "\r\n\r\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "é" * 5000, "x\r\n", ""]
    rows = [(i, f"http://www.b{i % 3}.org/p?{i}" if i else None, h) for i, h in enumerate(html)] + [(None, "u\r\nv", "q"), (8, "again", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("run", F.lit(1)).withColumn("digest", F.lit(1))
    got = warc.archive(pages).collect()
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                   "response" if i is None or best[h or ""] == i else "revisit", str(None if i is None or best[h or ""] == i else best[h or ""])) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == want
    keys = [(r.url_key, r.capture_time) for r in sorted(got, key=lambda r: (r.order_part, r.order_no))]
    assert keys == sorted(keys)
    assert warc.archive(pages.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted((rng.randint(0, 9), k) for k in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_quality_rules(spark, sf, texts):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = line_crf.judge(docs, labels).join(labels, "doc_id").filter("quality = 1 and not base_failed").collect()
    assert sum(r.kept for r in got) / len(got) > 0.98
    mine = docs_of(spark, texts + ["a b\n\na b\n c \n a b\nx # <y> a b c d a b c"])
    rows = {r.doc_id: r for r in line_crf.judge(mine, labels).collect()}
    for i, t in enumerate(texts + ["a b\n\na b\n c \n a b\nx # <y> a b c d a b c"]):
        w = (t or "").encode().split()
        often = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j for k, x in enumerate(zip(w, w[1:], w[2:])) if often[x] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert line_crf.judge(mine.limit(0), labels.limit(0)).count() == 0


def test_viterbi_equals_brute_force():
    import itertools
    rng = np.random.default_rng(3)
    field = line_crf.ChainField(2)
    field.emit, field.move, field.begin = rng.normal(size=2), rng.normal(size=(2, 2)), rng.normal(size=2)
    sizes = [0, 1, 5, 3]
    x, row = rng.normal(size=(sum(sizes), 2)), np.repeat(range(4), sizes)
    got = field.viterbi(x, row, 4)
    for k, n in enumerate(sizes):
        g = x[row == k] @ field.emit
        score = lambda p: field.begin[p[0]] + sum(g[t] * p[t] for t in range(n)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        if n:
            assert got[row == k].tolist() == list(max(itertools.product((0, 1), repeat=n), key=score))


def test_quality_classifier(spark, sf, texts):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_model.classify(docs).join(labels, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1]
    assert sum(good) / len(good) > 0.9
    assert quality_model.classify(docs_of(spark, texts)).count() == len(texts)
    assert quality_model.classify(docs.limit(0)).count() == 0


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, texts, keep):
    docs = docs_of(spark, texts + texts[5:12]).unionByName(docs_of(spark, texts[:9])).repartition(5)
    groups = collections.defaultdict(list)
    rows = docs.collect()
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    best = max if keep == "largest" else min
    for parts in (None, 1, 70):
        got = exact_dedup.deduplicate(docs, keep=keep, partitions=parts).collect()
        want = sorted((r.doc_id, best(groups[r.text or ""]), len(groups[r.text or ""]), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
    left = exact_dedup.keep_one(docs, keep=keep).collect()
    assert sorted((r.text or "", r.doc_id) for r in left) == sorted((t, best(i)) for t, i in groups.items())
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cap", [3000, 6])
def test_jaccard_join(spark, texts, cap):
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs_of(spark, texts), family_cap=cap).collect()}
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    links = {i: [j for j in range(len(sets)) if i != j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])] for i in range(len(sets))}
    for i in links:
        seen, front = {i}, [i]
        while front:
            front = [k for j in front for k in links[j] if k not in seen]
            seen.update(front)
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (len(sets[i]), min(seen), len(links[i])), i
    assert jaccard_join.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_region_join_recurses():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        core = rng.integers(0, 1 << 40, 60)
        sets += [np.unique(np.concatenate([core[rng.random(60) < 0.93], rng.integers(0, 1 << 40, 3)])).astype(np.uint64) for _ in range(20)]
    got = jaccard_join.RegionJoin(sets).linked
    plain = [set(s.tolist()) for s in sets]
    for i in rng.integers(0, len(sets), 60):
        want = [j != i and 100 * len(plain[i] & plain[j]) >= 85 * len(plain[i] | plain[j]) for j in range(len(sets))]
        assert got[i].tolist() == want


@pytest.mark.parametrize("cap", [2000, 2])
def test_suffix_dedup(spark, texts, cap):
    got = {r.doc_id: r for r in suffix_dedup.digest(docs_of(spark, texts), min_len=100, group_cap=cap).collect()}
    raw = [(t or "").encode() for t in texts]
    often = collections.Counter(b[i:i + 100] for b in raw for i in range(len(b) - 99))
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if often[b[s:s + 100]] > 1:
                gone[s:s + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.digest(docs_of(spark, texts).limit(0)).count() == 0


def test_suffix_array_and_matches():
    rng = np.random.default_rng(0)
    for _ in range(500):
        s = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)), 0)
        order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert suffix_array(s).tolist() == order
    s = np.array([3, 4, 1, 3, 4, 5, 1, 0])
    assert neighbour_matches(s, suffix_array(s), 1).tolist() == [2, 1, 0, 2, 1, 0, 0, 0]


def test_pipeline(spark, sf):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = docs.columns
    for name, apply in corpus_pipeline.STAGES[:-1]:
        new = apply(spark, docs, sf)
        assert new.columns == want and 0 < new.count() <= docs.count(), name
        docs = new
    odd = docs_of(spark, [None, "", "12"]).select(*want)
    for _, apply in corpus_pipeline.STAGES:
        assert apply(spark, odd, sf).count() <= 3
        assert apply(spark, odd.limit(0), sf).count() == 0


def test_pipeline_cuts_each_text_once(spark):
    """The filter on what is left must not cut the texts a second time, in a
    second Python worker a task."""
    passage = " ".join(f"p{k}" for k in range(120))
    docs = docs_of(spark, [f"a b c {passage} d", f"e f {passage} g h", passage, "alone"])
    cut = suffix_dedup.cut_repeats(docs, min_len=256)
    assert sorted(r.text for r in cut.collect()) == ["a b cd", "alone", "e fg h"]
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_pipeline_near_copies_link_at_five_words_and_80_percent(spark, sf):
    import corpus_pipeline
    words = [f"w{k}" for k in range(235)]
    spread = [f"x{k}" if k in (30, 75, 120, 165, 210) else w for k, w in enumerate(words)]
    run = [f"v{k}" for k in range(200)]
    replaced = [f"y{k}" if 90 <= k < 104 else w for k, w in enumerate(run)]
    loose = [f"z{k}" for k in range(200)]
    apart = [f"q{k}" if k % 30 == 15 else w for k, w in enumerate(loose)]             # 7 changed words: J 0.70
    docs = docs_of(spark, [" ".join(x) for x in (words, spread, run, replaced, loose, apart)])
    assert sorted(r.doc_id for r in corpus_pipeline.jaccard_join(spark, docs, sf).collect()) == [0, 2, 4, 5]
    assert sorted({r.component_id for r in jaccard_join.near_duplicates(docs).collect()}) == [0, 1, 2, 3, 4, 5]


def test_packing_reads_added_tokens_as_the_library_does(spark):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(packing.tokenizer_path())
    end = "<|endoftext|>"
    held = [f"a {end} b", end, end * 3, f"x{end}y\n{end} ", f"  {end}  z", f"{end[:-1]} {end}>", f"<{end}", f"don't{end}'s é", "<|endof" + "text|", f"{end}\n\n  {end}"]
    mine = packing.encoder(packing.tokenizer_path())
    ids = [np.array(coder.encode(t, add_special_tokens=False).ids + [1], "<u4") for t in held]
    assert [mine.encode(t, b"\1\0\0\0") for t in held] == [x.tobytes() for x in ids]
    assert ids[0].tolist() == [64, 220, 50256, 275, 1]
    got = packing.pack(docs_of(spark, held)).collect()
    assert all((r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())) for r in got)
    assert sum(r.length for r in got) == sum(map(len, ids))


def test_every_labelled_language_is_learned(spark):
    rng = random.Random(8)
    pool = [chr(c) for c in (*range(0x4E00, 0x4E00 + 1500), *range(0x430, 0x450), *range(0x3B1, 0x3C9))]
    words = [["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(60)] for letters in (rng.sample(pool, 25) for _ in range(70))]
    rows = [(k * 100 + n, " ".join(rng.choice(words[k]) for _ in range(40)), f"l{k:02d}") for k in range(70) for n in range(9 if k < 66 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.fit(docs).langs) == 70
    got = language_id.identify(docs).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: l for i, _, l in rows}


def test_keep_known_keeps_clean_texts_of_large_alphabets(spark):
    rng = random.Random(9)
    signs, latin = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)], ["cat", "dog", "the", "mat", "sat", "on", "and"]
    text = lambda: "".join(rng.choice(signs) for _ in range(300))
    rows = [(i, text(), "zh") for i in range(40)] + [(i, " ".join(rng.choice(latin) for _ in range(60)), "en") for i in range(40, 80)]
    new = [(100, text(), None), (101, "I", None), (102, chr(0x9000), None), (103, "the cat " + text()[:30], None)]
    gone = [(110, "\u03b1\u03b2\u03b3 " * 30, None), (111, "12 !", None), (112, None, None), (113, "", None), (114, "cat " + "\u0434\u0430 " * 9, None)]
    docs = spark.createDataFrame(rows + new + gone, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language_id.keep_known(docs).collect()) == [*range(80), 100, 101, 102, 103]


def test_pipeline_equals_plain_version(spark, tmp_path):
    import unicodedata

    import corpus_pipeline
    from tokenizers import Tokenizer
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 2000)]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    zh = lambda n: "".join(rng.choice(signs) for _ in range(n))
    texts = [words(rng.randint(20, 200)) for _ in range(25)] + [zh(300) for _ in range(25)]
    langs = {i: "en" if i < 25 else "zh" for i in range(50)}
    base, passage, signs_passage = words(200).split(), words(120), zh(180)
    for n in (0, 1, 3, 4, 5, 6, 7, 8, 9, 11):              # five-word J from 1 down to about 0.6
        w = list(base)
        for k in range(n):
            w[10 + k * 17] = f"new{n}"
        texts.append(" ".join(w))
    texts += [words(40) + " " + passage + " " + words(40) for _ in range(3)] + [zh(90) + signs_passage + zh(70) for _ in range(3)] + [passage]
    texts += [None, "", " 12 !", "I", "i", chr(0x9000), "αβγ " * 40, "cat " + "да " * 9, "the cat " + zh(9), "a <|endoftext|> b", words(3000)]
    texts += texts[3:6] + texts[28:31] + [texts[50].upper()]

    docs = docs_of(spark, texts, langs)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.defaultdict(list)
    windows = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))

    script = lambda c: unicodedata.name(c).split()[0]
    learned = {script(c) for i in langs if not _out(i) for c in texts[i].lower() if c.isalpha()}
    letters = {i: [c for c in (t or "").lower() if c.isalpha()] for i, t in enumerate(texts)}
    left = {i: t for i, t in enumerate(texts) if letters[i] and 2 * sum(script(c) not in learned for c in letters[i]) <= len(letters[i])}
    assert len(texts) - len(left) == 5
    left = {i: t for t, i in {t: i for i, t in sorted(left.items())}.items()}
    sets = {}
    for i, t in left.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    near = {i: [j for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in sets}
    gone = set()
    for i in sorted(sets):
        front = [i]
        while front and i not in gone:
            front = [k for j in front for k in near[j] if k != i and k not in gone]
            gone.update(front)
    assert 0 < len(gone) < 15
    raw = {i: t.encode() for i, t in left.items() if i not in gone}
    long = corpus_pipeline.PASSAGE_BYTES
    often = collections.Counter(b[s:s + long] for b in raw.values() for s in range(len(b) - long + 1))
    want = {}
    for i, b in raw.items():
        cut = bytearray(len(b))
        for s in range(len(b) - long + 1):
            if often[b[s:s + long]] > 1:
                cut[s:s + long] = b"\1" * long
        kept = bytes(c for c, g in zip(b, cut) if not g).decode("utf-8", "ignore")
        if kept:
            want[i] = kept
    assert len(want) < len(raw) and any(want[i] != left[i] for i in want)
    coder = Tokenizer.from_file(packing.tokenizer_path())
    assert set(got) == set(want)
    for i, t in want.items():
        ids, at = np.array(coder.encode(t, add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + r.length].tobytes())), i
            at += r.length
        assert at == len(ids)
    for parts in windows.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip([(0, 0), *parts], parts)) and sum(n for _, n in parts) <= 2048
