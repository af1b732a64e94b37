"""Distribution of token counts and word sketches against plain Python."""

import math
import statistics

import pytest

from chorus.operators import profile as PR


def counts_of(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "comment_id long, token_count long")
    return df, PR.value_counts(df)


@pytest.mark.parametrize("values", [
    [1, 2, 2, 3, 3, 3, 4, 5, 40], [7] * 5, [0], [0, 1000], [3] * 50 + [4] * 3 + [9999], list(range(100)),
])
def test_box_and_outliers(spark, values):
    df, counts = counts_of(spark, [*values, None])
    q1, q2, q3 = statistics.quantiles(values, n=4, method="inclusive") if len(values) > 1 else values * 3
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in values if low <= v <= high]
    b = PR.box(counts).first()
    assert (b.comments, b.min, b.max) == (len(values), min(values), max(values))
    assert (b.q25, b.q50, b.q75) == pytest.approx((q1, q2, q3))
    assert (b.whisker_low, b.whisker_high, b.outliers) == (min(inside), max(inside), len(values) - len(inside))
    points = PR.outliers(df, counts).collect()
    assert sorted(r.token_count for r in points) == sorted(v for v in values if not low <= v <= high)
    assert all(r.side == ("low" if r.token_count < low else "high") for r in points)


@pytest.mark.parametrize("values", [[1, 2, 2, 3, 3, 3, 4, 5, 40], [7] * 5, [0, 1000], [3] * 50 + [4] * 3 + [9999]])
def test_density_equals_the_plain_sum(spark, values):
    _, counts = counts_of(spark, values)
    rows = sorted(PR.density(counts).collect())
    lo, hi, n = min(values), max(values), len(values)
    if lo == hi:
        bw = 1.0
    else:
        q1, _, q3 = statistics.quantiles(values, n=4, method="inclusive")
        bw = max(1.059 * min(statistics.stdev(values), (q3 - q1) / 1.349) * n ** -0.2, (hi - lo) / 100)
    assert rows[0].x == pytest.approx(lo - 2 * bw) and rows[-1].x == pytest.approx(hi + 2 * bw)
    assert len(rows) <= 314 and [r.point for r in rows] == list(range(len(rows)))
    for r in rows:
        plain = sum(math.exp(-0.5 * ((r.x - v) / bw) ** 2) for v in values) / (n * bw * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(plain, abs=1e-12)


def test_no_comments(spark):
    df, counts = counts_of(spark, [None])
    b = PR.box(counts).first()
    assert (b.comments, b.outliers, b.q50, b.whisker_low) == (0, 0, None, None)
    assert PR.outliers(df, counts).count() == 0 and PR.density(counts).count() == 0


def nlp(spark, rows):
    return spark.createDataFrame(rows, "video_id string, clean_comment string, token_clean array<string>")


def test_sketches_merge_to_the_whole(spark):
    a = nlp(spark, [("v1", "one two", ["one", "two"]), ("v1", "", []), (None, "two", ["two", "two"]), ("v2", "x", [])])
    b = nlp(spark, [("v1", "three", ["three"])])
    both = PR.word_sketches(a).union(PR.word_sketches(b))
    per = {r.video_id: r for r in PR.merged(both, "video_id").collect()}
    assert (per["v1"].total_comments, per["v1"].words, per["v1"].unique_words, per["v1"].avg_length) == (3, 3, 3, 4.0)
    assert (per["v2"].total_comments, per["v2"].unique_words) == (1, 0) and per[None].unique_words == 1
    total = PR.merged(both).first()
    assert (total.total_comments, total.words, total.unique_words) == (5, 5, 3)
    none = PR.merged(PR.word_sketches(a.limit(0))).first()
    assert (none.total_comments, none.avg_length, none.unique_words) == (0, None, 0)


def test_sketch_error_on_many_words(spark):
    from pyspark.sql import functions as F
    df = spark.range(200_000).select(F.concat(F.lit("v"), F.col("id") % 7).alias("video_id"), F.lit("c").alias("clean_comment"),
                                     F.array(F.concat(F.lit("w"), F.col("id") % 150_000)).alias("token_clean"))
    got = PR.merged(PR.word_sketches(df)).first().unique_words
    assert abs(got - 150_000) <= 0.03 * 150_000           # over three standard errors


def test_sketched_kpis_of_the_comments(spark, sf):
    from chorus.plans import catalog
    exact = catalog.QUERIES["kpis"](spark, sf).first()
    out = catalog.QUERIES["video_kpis_sketched"](spark, sf).collect()
    total, = [r for r in out if r.level == "all"]
    rows = {r.video_id: r for r in out if r.level == "video"}
    assert (total.total_comments, total.avg_length) == (exact.total_comments, exact.avg_length)
    assert sum(r.total_comments for r in rows.values()) == exact.total_comments
    assert abs(total.unique_words - exact.unique_words) <= 0.03 * exact.unique_words
