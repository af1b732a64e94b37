from chorus.operators import reports as R
from chorus.operators import topics as TP


def results_fixture(spark):
    rows = [  # comment_id, lexicon, binary, ternary labels and scores
        (1, "positive", 0.9, "positive", 0.8, "positive", 0.7),
        (2, "neutral", 0.0, "negative", 0.6, "neutral", 0.5),
        (3, "negative", -0.5, "negative", 0.6, "negative", 0.9),
        (4, "neutral", 0.0, "positive", 0.55, None, None),
    ]
    return spark.createDataFrame(rows, "comment_id long, lexicon_label string, lexicon_score double, "
                                       "binary_label string, binary_score double, "
                                       "ternary_label string, ternary_score double")


def test_comparison_label_used_by_one_model_and_null_label(spark):
    r = results_fixture(spark)
    wide = {x.sentiment_label: (x.lexicon_count, x.binary_count, x.ternary_count)
            for x in R.model_comparison(r).collect()}
    assert wide == {"negative": (1, 2, 1), "neutral": (2, 0, 1), "positive": (1, 2, 1)}
    long = R.model_comparison_long(R.model_comparison(r)).collect()
    assert len(long) == 9 and sum(x.comment_count for x in long if x.model == "binary") == 4
    dist = {(x.model, x.sentiment_label): x.share for x in R.label_distribution(r).collect()}
    assert abs(sum(v for (m, _), v in dist.items() if m == "ternary") - 1.0) < 1e-12


def test_top_lists_ties_and_short_labels(spark):
    r = results_fixture(spark)
    top = R.top_by_score(r, n=2, cols=())
    pos = [x.comment_id for x in top.filter("direction = 'positive'").orderBy("rank").collect()]
    neg = [x.comment_id for x in top.filter("direction = 'negative'").orderBy("rank").collect()]
    assert pos == [1, 2] and neg == [3, 2]                 # tie at 0.0 broken by comment_id
    tl = R.top_by_label(r, "binary", n=10, cols=()).collect()
    by = {}
    for x in tl:
        by.setdefault(x.binary_label, []).append((x.rank, x.comment_id))
    assert sorted(by["negative"]) == [(1, 2), (2, 3)]      # tie at 0.6 broken by comment_id
    assert sorted(by["positive"]) == [(1, 1), (2, 4)]      # fewer than n rows: all kept


def test_vocabulary_exact_thresholds(spark):
    # N = 10 documents: 'edge7' in 7 (= 70%), 'over8' in 8, 'two' in exactly 2, 'one' in 1
    docs = []
    for i in range(10):
        t = ["filler%d" % i]
        if i < 7:
            t.append("edge7")
        if i < 8:
            t.append("over8")
        if i < 2:
            t.append("two")
        if i == 9:
            t.append("one")
        docs.append((i, t))
    df = spark.createDataFrame(docs, "comment_id long, token_clean_topic array<string>")
    v70 = {x.term for x in TP.vocabulary(df, no_above=0.7).collect()}
    v80 = {x.term for x in TP.vocabulary(df, no_above=0.8).collect()}
    assert v70 == {"edge7", "two"}
    assert v80 == {"edge7", "over8", "two"}


def test_topic_docs_drop_all_filtered(spark):
    df = spark.createDataFrame([(1, ["the", "video", "ab"]), (2, ["cat", "cat"]), (3, [])],
                               "comment_id long, token_clean array<string>")
    docs = TP.topic_docs(df, TP.topic_stopwords(spark)).collect()
    assert [(d.comment_id, d.token_clean_topic) for d in docs] == [(2, ["cat", "cat"])]
    empty = spark.createDataFrame([(1, [])], "comment_id long, token_clean_topic array<string>")
    model = TP.fit_topics(empty)
    keywords = TP.topic_keywords(model.topics)
    assert model.topics.columns == ["topic_id", "rank", "term", "weight"]
    assert model.assignments.columns == ["comment_id", "token_clean_topic", "topic_id", "topic_score"]
    assert keywords.columns == ["topic_id", "topic_keywords", "topic_name"]
    assert all(t.isEmpty() for t in (model.topics, model.assignments, keywords))
