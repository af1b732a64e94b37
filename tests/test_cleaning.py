from pyspark.sql import functions as F

from chorus.operators import cleaning as C


# (text, strict outcome, light outcome), written by hand
EXPECTED = [
    (None, "", ""), ("a\r\nb", "a b", "a b"), ("http://x.com start", "start", "start"),
    ("mid https://y.org/p?q=1 mid", "mid mid", "mid mid"), ("end www.z.com", "end", "end"), ("gluedhttp://a.b", "glued", "glued"),
    ("UP HTTP://A.B", "UP HTTP A.B", "UP HTTP://A.B"), ("awwwesome", "a", "a"), ("bare www", "bare www", "bare www"),
    ("\U0001F600\U0001F600", "", "\U0001F600\U0001F600"), ("caf\u00e9 d\u00e9j\u00e0 vu", "caf d j vu", "caf\u00e9 d\u00e9j\u00e0 vu"),
    ("nbsp http://u.v next", "nbsp next", "nbsp next"), ("   \t  ", "", ""),
    ("Don't stop!! Really??", "Don't stop!! Really??", "Don't stop!! Really??"), ("x" * 50, "x" * 50, "x" * 50),
]
CASES = [e[0] for e in EXPECTED]


def test_clean_outcomes(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "comment_id long, comment string")
    for strict in (True, False):
        got = {r.comment_id: r.clean_comment for r in C.add_clean_comment(df, strict=strict).collect()}
        assert [got[i] for i in range(len(CASES))] == [e[1 if strict else 2] for e in EXPECTED]


def test_clean_is_idempotent(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "comment_id long, comment string")
    once = C.add_clean_comment(df)
    twice = C.add_clean_comment(once.select("comment_id", F.col("clean_comment").alias("comment")))
    a = {r.comment_id: r.clean_comment for r in once.collect()}
    b = {r.comment_id: r.clean_comment for r in twice.collect()}
    assert a == b


def test_prepare_drops_empty_and_keeps_first(spark):
    rows = [(5, "v1", "Same text"), (2, "v2", "Same text"), (3, "v1", "same text"),
            (4, "v3", "Same   text\n"), (1, "v1", "   "), (6, "v2", None), (7, "v1", "other")]
    df = spark.createDataFrame(rows, "comment_id long, video_id string, comment string")
    out = sorted((r.comment_id, r.clean_comment) for r in C.prepare_comments(df).collect())
    assert out == [(2, "Same text"), (3, "same text"), (7, "other")]


def test_dedup_plan_has_partial_group_limit(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "comment_id long, clean_comment string")
    plan = C.dedup_keep_first(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_null_profile_and_preview(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "b", None), (3, None, None)],
                               "comment_id long, a string, b string")
    prof = {r.column: r.nulls for r in C.null_profile(df).collect()}
    assert prof == {"comment_id": 0, "a": 2, "b": 2}
    assert [r.comment_id for r in C.preview(df, 2).collect()] == [1, 2]


def test_strict_cleaning_joins_the_kept_runs(spark):
    """As Python's replace, collapse and strip; and without a replacement for
    every gap between words, which took most of a query's time."""
    import re
    texts = ["", " ", None, "\n", " a b\u0085", "é!?..", "!!!", "a\tb\r\n", "😀 x 😀 ", "\x00a\x1cb", "l'été, déjà. ok?"]
    out = C.add_clean_comment(spark.createDataFrame([(t,) for t in texts], "comment string"))
    want = [re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9\s'.,!?]", " ", t or "")).strip() for t in texts]
    assert [r.clean_comment for r in out.collect()] == want
    assert "[^A-Za-z0-9" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_null_profile_query_holds_the_fetched_rows_too(spark, sf):
    """Every 13th comment as fetched lacks its likes; of all comments none does."""
    from chorus.plans import catalog
    got = {r.column: r.nulls for r in catalog.QUERIES["null_profile"](spark, sf).collect()}
    rows = catalog.QUERIES["comments_from_pages"](spark, sf)
    assert got["like_count"] == 0 and got["fetched_like_count"] == rows.filter("like_count is null").count() > 0
    assert len(got) == 14 and got["fetched_comment_id"] == 0
