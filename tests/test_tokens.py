from chorus.operators import tokens as TK
from chorus.operators import topics as TP


def test_tokens_and_lemmas(spark):
    rows = [(1, "Don't stop the videos in 2024 or 99 now"), (2, "Supercalifragilistic abc u.s. comedies classes"),
            (3, ""), (4, "Cafe cats cats running was")]
    df = spark.createDataFrame(rows, "comment_id long, clean_comment string")
    out = {r.comment_id: r for r in TK.lemmatize_comments(df).collect()}
    assert out[1].tokens == ["don", "stop", "the", "videos", "in", "or", "now"]
    assert "2024" in out[1].token_clean and "99" not in out[1].token_clean
    assert "video" in out[1].token_clean and "the" not in out[1].token_clean
    assert "supercalifragilistic" not in out[2].tokens          # longer than 15
    assert "comedy" in out[2].token_clean and "class" in out[2].token_clean
    assert out[3].tokens == [] and out[3].token_clean == [] and out[3].token_count == 0
    assert out[4].token_clean == ["cafe", "cat", "cat", "running"]   # repeats kept, 'was' is a stop word


def test_topic_tokens_keep_repeats_and_user_words(spark):
    stops = TP.topic_stopwords(spark, "  Foo, BAR ,, baz,")
    assert {"foo", "bar", "baz", "video", "the"} <= set(stops)
    assert "" not in stops


def test_topic_filter(spark):
    df = spark.createDataFrame([(1, ["cat", "video", "cat", "ab", "foo"])], "comment_id long, token_clean array<string>")
    out = TP.add_topic_tokens(df, TP.topic_stopwords(spark, "foo")).collect()[0]
    assert out.token_clean_topic == ["cat", "cat"]


def test_word_counts_and_top(spark):
    df = spark.createDataFrame([(1, ["a1x", "b2y", "a1x"]), (2, ["a1x"])], "comment_id long, token_clean array<string>")
    wc = {r.word: r["count"] for r in TK.word_counts(df).collect()}
    assert wc == {"a1x": 3, "b2y": 1}
    top = TK.top_words(TK.word_counts(df), 1).collect()
    assert top[0].word == "a1x" and top[0].share == 1.0
    assert TK.unique_words(df).collect()[0].unique_words == 2


def test_lemmas_from_a_table(spark):
    from chorus.operators import tokens as TK
    rows = [(1, "Running dogs ran running"), (2, ""), (3, "the and"), (4, "mice 2024 geese running")]
    df = spark.createDataFrame(rows, "comment_id long, clean_comment string")
    table = spark.createDataFrame([("running", "run"), ("geese", "goose"), ("unseen", "x")], "form string, lemma string")
    got = {r.comment_id: r.token_clean for r in TK.add_lemma_tokens_from_table(df, table).collect()}
    plain = {r.comment_id: r.token_clean for r in TK.add_lemma_tokens(df).collect()}
    assert got[1] == ["run"] + plain[1][1:3] + ["run"] and got[2] == got[3] == []
    assert got[4] == plain[4][:2] + ["goose", "run"]
    none = table.limit(0)
    assert {r.comment_id: r.token_clean for r in TK.add_lemma_tokens_from_table(df, none).collect()} == plain


def test_a_lemma_table_of_100_000_forms(spark):
    from pyspark.sql import functions as F
    from chorus.operators import tokens as TK
    table = spark.range(100_000).select(F.concat(F.lit("form"), "id").alias("form"), F.concat(F.lit("lemma"), "id").alias("lemma"))
    df = spark.range(500).select(F.col("id").alias("comment_id"), F.concat(F.lit("form"), F.col("id") * 300, F.lit(" zebra")).alias("clean_comment"))
    got = {r.comment_id: r.token_clean for r in TK.add_lemma_tokens_from_table(df, table).collect()}
    assert all(got[i] == [f"lemma{300 * i}" if 300 * i < 100_000 else f"form{300 * i}", "zebra"] for i in range(500))
