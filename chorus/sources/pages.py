"""Ingest of landed response pages (ops 1-5).

A landed page is a row ``(video_id, page_no, body)``: ``body`` is the JSON
text of one API response, ``page_no`` its 0-based fetch order within the
video.  The reference's paging loop -- read pages in order, stop after
``max_pages``, after the first page with no ``nextPageToken`` or at the first
error page -- becomes a per-video aggregate (first stopping page) joined back
to the pages: no window, so a video holding a third of all pages still
splits across tasks (partial aggregation + AQE skew join).
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.functions.text import video_id as _video_id_expr

_SNIPPET = T.StructType([
    T.StructField("publishedAt", T.StringType()),
    T.StructField("textDisplay", T.StringType()),
    T.StructField("likeCount", T.LongType()),
    T.StructField("authorDisplayName", T.StringType()),
])
PAGE_SCHEMA = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("snippet", T.StructType([
            T.StructField("topLevelComment", T.StructType([
                T.StructField("snippet", _SNIPPET)]))])),
    ]))),
    T.StructField("nextPageToken", T.StringType()),
    T.StructField("error", T.StructType([T.StructField("message", T.StringType())])),
])


def with_video_id(df: DataFrame, src: str = "url_or_id", out: str = "video_id") -> DataFrame:
    """Op 1: normalise a URL or bare ID column to a video ID."""
    return df.withColumn(out, _video_id_expr(src))


def _parsed(pages: DataFrame) -> DataFrame:
    return pages.select("video_id", "page_no",
                        F.from_json("body", PAGE_SCHEMA).alias("p"))


def _page_state(pages: DataFrame, max_pages: int | None) -> DataFrame:
    """Per page: parsed body plus ``read`` (the loop reaches this page)."""
    p = _parsed(pages).select(
        "video_id", "page_no", "p",
        (F.col("p.error").isNotNull()).alias("is_error"),
        (F.col("p.error").isNull() & F.col("p.nextPageToken").isNull()).alias("is_final"))
    stops = (p.filter(F.col("is_error") | F.col("is_final"))
             .groupBy("video_id").agg(F.min("page_no").alias("stop_page")))
    p = p.join(stops, "video_id", "left")
    read = F.col("stop_page").isNull() | (F.col("page_no") <= F.col("stop_page"))
    if max_pages is not None:
        # pages read are counted, whatever their numbers; the first few of a
        # video are picked by id (a partial group limit before the shuffle)
        order = Window.partitionBy("video_id").orderBy("page_no")
        first = pages.select("video_id", "page_no").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= int(max_pages))
        p = p.join(first, ["video_id", "page_no"], "left")
        read = read & F.col("nth").isNotNull()
    return p.withColumn("read", read)


def _rows(state: DataFrame) -> DataFrame:
    kept = state.filter(F.col("read") & ~F.col("is_error"))
    items = kept.select("video_id", "page_no", F.posexplode("p.items").alias("pos", "it"))
    sn = F.col("it.snippet.topLevelComment.snippet")
    return items.filter(sn.isNotNull()).select(
        F.col("it.id").cast("long").alias("comment_id"),
        "video_id",
        sn["publishedAt"].alias("date"),
        sn["textDisplay"].alias("comment"),
        sn["likeCount"].alias("like_count"),
        sn["authorDisplayName"].alias("author"),
    )


def comments_from_pages(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Op 2 (+3, +4): one row per top-level comment of every page read.

    Items with no inner ``snippet`` come out as nulls, not errors; they are
    returned by ``rejected_items``.
    """
    return _rows(_page_state(pages, max_pages))


def rejected_items(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    st = _page_state(pages, max_pages).filter(F.col("read") & ~F.col("is_error"))
    it = st.select("video_id", "page_no", F.posexplode("p.items").alias("pos", "it"))
    return it.filter(F.col("it.snippet.topLevelComment.snippet").isNull()).select(
        "video_id", "page_no", "pos")


def page_cap(pages: DataFrame, max_pages: int | None) -> DataFrame:
    """Op 3: comments of the first ``max_pages`` pages per video (null =
    unlimited), stopping early at a final or error page."""
    return comments_from_pages(pages, max_pages)


def page_errors(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Op 4: the reject output -- one row per error page the loop reached."""
    st = _page_state(pages, max_pages)
    return st.filter(F.col("read") & F.col("is_error")).select(
        "video_id", "page_no", F.col("p.error.message").alias("message"))


def multi_video(df: DataFrame, video_ids: str | Iterable[str], col: str = "video_id") -> DataFrame:
    """Op 5: keep the rows of one or several videos (a pushed-down ``IN``)."""
    ids = [video_ids] if isinstance(video_ids, str) else list(video_ids)
    return df.filter(F.col(col).isin(ids))
