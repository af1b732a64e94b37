import collections
import hashlib
import math

from pyspark.sql import functions as F

from chorus.functions.arrays import exploded_counts
from chorus.functions.bloom import BloomFilter
from chorus.operators import lda
from chorus.operators import topics as TP
from chorus.operators.hot import frequent_join, hot_size


def corpus(spark):
    words = [["cat", "dog", "pet"], ["cat", "pet", "food"], ["stock", "market", "trade"],
             ["market", "trade", "price"], ["dog", "food", "pet"], ["price", "stock", "trade"],
             ["lonely"], ["cat", "dog"]]
    return spark.createDataFrame([(i, w) for i, w in enumerate(words)], "comment_id long, token_clean_topic array<string>")


def test_vocabulary_bounds(spark):
    docs = corpus(spark)
    v = {r.term: r.doc_freq for r in TP.vocabulary(docs, no_above=0.5).collect()}
    assert "lonely" not in v and all(2 <= d <= 4 for d in v.values())
    bags = TP.bag_of_words(docs, TP.vocabulary(docs, no_above=0.5))
    assert bags.filter(F.col("term") == "lonely").count() == 0
    st = TP.corpus_stats(docs, TP.vocabulary(docs, no_above=0.5)).collect()[0]
    assert st.documents == 8 and st.vocabulary_size == len(v)


def test_lda_invariants(spark):
    docs = corpus(spark)
    m = TP.fit_topics(docs, k=2, no_above=0.5)
    a = m.assignments.collect()
    assert len(a) == 8                                   # every document gets a topic
    assert all(r.topic_id in (0, 1) and 0 < r.topic_score <= 1 for r in a)
    kw = TP.topic_keywords(m.topics)
    assert sorted(r.topic_id for r in kw.collect()) == [0, 1]
    assert all(len(r.topic_name.split(" / ")) <= 3 for r in kw.collect())
    s = TP.topic_summary(m.assignments, kw).collect()
    assert sum(r.comment_count for r in s) == 8
    assert TP.topic_comments(m.assignments, 3).count() == 3


def digamma(x):
    """By the recurrence far up, where the logarithm's first terms do."""
    total = 0.0
    while x < 1000:
        total, x = total - 1 / x, x + 1
    return total + math.log(x) - 1 / (2 * x) - 1 / (12 * x * x)


def plain_fit(docs, k, passes, seed, below=2, above=0.5):
    df = collections.Counter(t for _, ts in docs for t in set(ts))
    vocab = sorted(t for t, n in df.items() if below <= n <= int(above * len(docs)))
    bags = {d: {t: n for t, n in collections.Counter(ts).items() if t in vocab} for d, ts in docs}
    start = lambda t, i: 1 / k - math.log((int(hashlib.md5(f"{t}|{i}|{seed}".encode()).hexdigest()[:7], 16) + 0.5) / 16 ** 7)
    lam = {t: [start(t, i) for i in range(k)] for t in vocab}
    prior, gam = [1 / k] * k, None
    for _ in range(passes):
        total = [sum(v[i] for v in lam.values()) for i in range(k)]
        new_l, new_g = {t: [1 / k] * k for t in vocab}, {}
        for d, bag in bags.items():
            if not bag:
                continue
            theta = [1.0] * k if gam is None else [math.exp(digamma(g) - digamma(sum(gam[d]))) for g in gam[d]]
            mix = list(prior)
            for t, n in bag.items():
                p = [theta[i] * math.exp(digamma(lam[t][i]) - digamma(total[i])) for i in range(k)]
                for i in range(k):
                    share = n * p[i] / sum(p)
                    mix[i] += share
                    new_l[t][i] += share
            new_g[d] = mix
        lam, gam = new_l, new_g
        prior = [sum(g[i] / sum(g) for g in gam.values()) / len(gam) for i in range(k)]
    return lam, gam, prior


def test_lda_equals_plain_variational_steps(spark):
    docs = corpus(spark)
    rows = [(r.comment_id, r.token_clean_topic) for r in docs.collect()]
    for k, blocks in ((2, 200_000), (3, 2)):             # weights dealt over blocks give the same model
        lam, gam, prior = plain_fit(rows, k, 6, 99)
        vocab = TP.vocabulary(docs, no_above=0.5)
        bags = TP.bag_of_words(docs, vocab).withColumnRenamed("count", "n")
        weights, mixtures, got_prior = lda.fit(bags.repartition(3), vocab, k, 6, 99, block_rows=blocks)
        for r in weights.collect():
            assert all(math.isclose(r[f"l{i}"], lam[r.term][i], rel_tol=1e-5) for i in range(k))
        got = {r.comment_id: r for r in mixtures.collect()}
        assert set(got) == set(gam)
        assert all(math.isclose(got[d][f"g{i}"], gam[d][i], rel_tol=1e-5) for d in gam for i in range(k))
        assert all(math.isclose(a, b, rel_tol=1e-5) for a, b in zip(got_prior, prior))


def test_topics_part_what_does_not_mix(spark):
    """Two vocabularies that never meet fall into different topics."""
    rows = [(i, [f"{'ab'[i % 2]}{(i * 7 + j) % 12}" for j in range(10)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "comment_id long, token_clean_topic array<string>")
    m = TP.fit_topics(docs, k=2, passes=25)
    by = collections.defaultdict(set)
    for r in m.assignments.collect():
        by[r.comment_id % 2].add(r.topic_id)
    assert len(by[0]) == len(by[1]) == 1 and by[0] != by[1]


def test_empty_vocabulary_gives_empty_tables(spark):
    docs = spark.createDataFrame([(1, ["aa"]), (2, ["bb"])], "comment_id long, token_clean_topic array<string>")
    m = TP.fit_topics(docs)
    assert m.topics.count() == m.assignments.count() == TP.topic_keywords(m.topics).count() == 0


def test_empty_corpus_gives_empty_tables(spark):
    docs = spark.createDataFrame([], "comment_id long, token_clean_topic array<string>")
    m = TP.fit_topics(docs)
    assert m.topics.count() == m.assignments.count() == TP.topic_keywords(m.topics).count() == 0
    assert TP.topic_summary(m.assignments, TP.topic_keywords(m.topics)).count() == TP.topic_comments(m.assignments).count() == 0


def test_lda_keeps_every_term_of_the_vocabulary(spark):
    terms = 101_000
    docs = spark.range(2000).select(F.col("id").alias("comment_id"), F.transform(
        F.sequence(F.lit(0), F.lit(100)), lambda j: F.format_string("t%06d", F.col("id") % 1000 * 101 + j)).alias("token_clean_topic"))
    vocab = TP.vocabulary(docs)
    weights, _, _ = lda.fit(TP.bag_of_words(docs, vocab).withColumnRenamed("count", "n"), vocab, 2, 1, 99)
    assert weights.count() == vocab.count() == terms


def test_user_stop_words(spark):
    words = TP.topic_stopwords(spark, " Foo , ,BAR baz,,foo,\tq ", domain=["dom"])
    assert {"foo", "bar baz", "q", "dom", "the"} <= set(words) and "" not in words
    assert words == sorted(set(words))


def test_terms_counted_in_the_row(spark):
    rows = [(1, ["b", "a", "b", "b"]), (2, []), (3, None), (4, ["x"]), (5, ["é", "e", "é"])]
    d = spark.createDataFrame(rows, "id int, t array<string>")
    got = sorted((r.id, r.term, r.n) for r in exploded_counts(d, ["id"], F.col("t")).collect())
    assert got == [(1, "a", 1), (1, "b", 3), (4, "x", 1), (5, "e", 1), (5, "é", 2)]


def test_bloom_filter_passes_every_key(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("w"))
    bloom = BloomFilter.of(keys, "w")
    rows = spark.range(200_000).select((F.col("id") < 20_000).alias("key"), F.concat(F.lit("k"), "id").alias("w"))
    got = {r["key"]: (r.n, r.ok) for r in rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if(bloom.may_hold("w")).alias("ok")).collect()}
    assert got[True] == (20_000, 20_000) and got[False][1] < 0.06 * got[False][0]
    assert keys.filter(BloomFilter.of(keys.limit(0), "w").may_hold("w")).count() == 0


def test_lda_of_frequent_and_rare_terms(spark):
    """Terms met by a broadcast and those met by a shuffle make one model."""
    docs = corpus(spark)
    rows = [(r.comment_id, r.token_clean_topic) for r in docs.collect()]
    lam, gam, _ = plain_fit(rows, 3, 4, 99)
    vocab = TP.vocabulary(docs, no_above=0.5)
    bags = TP.bag_of_words(docs, vocab).withColumnRenamed("count", "n")
    for hot in (0, 3):
        assert hot_size(vocab, "doc_freq", hot_keys=hot) > vocab.agg(F.min("doc_freq")).first()[0]
        weights, mixtures, _ = lda.fit(bags, vocab, 3, 4, 99, hot_terms=hot)
        got = {r.term: r for r in weights.collect()}
        assert set(got) == set(lam) and all(math.isclose(got[t][f"l{i}"], lam[t][i], rel_tol=1e-5) for t in lam for i in range(3))
        mix = {r.comment_id: r for r in mixtures.collect()}
        assert set(mix) == set(gam) and all(math.isclose(mix[d][f"g{i}"], gam[d][i], rel_tol=1e-5) for d in gam for i in range(3))


def test_join_of_hot_and_rare_keys(spark):
    rows = spark.range(3000).select(F.expr("cast(floor(sqrt(id)) as string)").alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k != '7'")
    want = sorted(map(tuple, rows.join(table, "k").select("k", "id", "n").collect()))
    for keys, most in ((0, 200_000), (0, 50), (10, 200_000), (100_000, 200_000)):
        got = frequent_join(rows, table, "k", "n", most, keys).select("k", "id", "n")
        assert sorted(map(tuple, got.collect())) == want
