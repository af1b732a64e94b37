import json

from pyspark.sql import functions as F

from chorus import sources as S


def test_video_id_fixtures(spark):
    cases = [(None, None), ("", None), ("   ", ""), ("https://youtu.be/abc123?t=42", "abc123"),
             ("https://www.youtube.com/watch?v=XYZ&list=PL1", "XYZ"),
             ("https://www.youtube.com/shorts/Sh0rt", "Sh0rt"),
             ("https://www.youtube.com/shorts/zzz?v=first", "first"),
             ("https://x.com/?nav=abc", "abc"), ("https://www.youtube.com/watch?v=id1#x", "id1#x"),
             ("  bareID  ", "bareID")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, url_or_id string")
    got = {r.i: r.video_id for r in S.with_video_id(df).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, cases[i]


def item(i, text="t", likes=1, inner=True):
    sn = {"publishedAt": "d", "textDisplay": text, "authorDisplayName": "a"}
    if likes is not None:
        sn["likeCount"] = likes
    return {"id": str(i), "snippet": {"topLevelComment": {"snippet": sn}} if inner else {}}


def page(items, token=True):
    d = {"items": items}
    if token:
        d["nextPageToken"] = "t"
    return json.dumps(d)


def pages_df(spark):
    rows = [
        ("a", 0, page([item(1), item(2, likes=None)])),
        ("a", 1, page([item(3)])),
        ("a", 2, json.dumps({"error": {"message": "boom"}})),
        ("a", 3, page([item(4)])),
        ("b", 0, page([])),
        ("b", 1, page([item(5), item(6, inner=False)], token=False)),
        ("b", 2, page([item(7)])),
        ("c", 0, page([item(8)])),
        ("c", 1, page([item(9)])),
        ("c", 2, page([item(10)])),
        ("c", 3, page([item(11)])),
        ("c", 4, page([item(12)], token=False)),
    ]
    return spark.createDataFrame(rows, "video_id string, page_no long, body string")


def ids(df):
    return sorted(r.comment_id for r in df.collect())


def test_paging_semantics(spark):
    p = pages_df(spark)
    assert ids(S.comments_from_pages(p)) == [1, 2, 3, 5, 8, 9, 10, 11, 12]
    assert ids(S.page_cap(p, 1)) == [1, 2, 8]
    assert ids(S.page_cap(p, 4)) == [1, 2, 3, 5, 8, 9, 10, 11]
    assert ids(S.page_cap(p, None)) == ids(S.comments_from_pages(p))
    errs = [(r.video_id, r.page_no, r.message) for r in S.page_errors(p).collect()]
    assert errs == [("a", 2, "boom")]
    assert S.page_errors(p, 2).count() == 0
    rows = {r.comment_id: r for r in S.comments_from_pages(p).collect()}
    assert rows[2].like_count is None and rows[1].like_count == 1
    from chorus.sources.pages import rejected_items
    assert [(r.video_id, r.page_no, r.pos) for r in rejected_items(p).collect()] == [("b", 1, 1)]
    assert ids(S.multi_video(S.comments_from_pages(p), ["b", "c"])) == [5, 8, 9, 10, 11, 12]


def test_cap_counts_pages_read(spark):
    rows = [("d", n, page([item(n)])) for n in (5, 6, 7)]
    p = spark.createDataFrame(rows, "video_id string, page_no long, body string")
    assert ids(S.page_cap(p, 2)) == [5, 6] and ids(S.page_cap(p, 9)) == [5, 6, 7]


def test_landed_pages_contract(spark, sf):
    lp = S.landed_pages(spark, sf)
    per = lp.groupBy("video_id").agg(F.count("*").alias("n"), F.max("page_no").alias("mx")).collect()
    assert all(r.n == r.mx + 1 for r in per)          # page numbers run 0..n-1
    assert S.comments_from_pages(lp).count() <= S.comments(spark, sf).count()
