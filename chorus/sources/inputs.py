"""Standard inputs derived from the given tables.

``comments`` stands for the fetched comments: ``documents.doc_id`` ->
``comment_id``, ``source`` -> ``video_id``, ``text`` -> ``comment``; ``date``,
``like_count`` and ``author`` are fixed formulas of ``doc_id`` (the oracle SQL
writes the same formulas).  ``landed_pages`` re-creates response pages as
landed JSON (one row per page) so the ingest operators run on real bodies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.data import fixed_values as fv


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("comment_id"),
        F.col("source").alias("video_id"),
        F.format_string("2024-%02d-%02dT%02d:00:00Z", i % 12 + 1, i % 28 + 1, i % 24).alias("date"),
        F.col("text").alias("comment"),
        ((i * 37) % 1000).alias("like_count"),
        F.concat(F.lit("user_"), (i % 997).cast("string")).alias("author"),
    )


def short_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of ``conversations`` as short comments, one video per
    conversation."""
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"),
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("video_id"),
        F.col("text").alias("comment"),
    )


def url_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs plus URL shapes built from ``page_id``: watch links with
    extra parameters, short links, shorts links, bare IDs with spaces,
    ``v=`` after another parameter with a fragment, and empty input."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    i = F.col("page_id")
    vid = F.concat(F.lit("vid"), i.cast("string"))
    raw = (F.when(i % 7 == 0, F.col("url"))
           .when(i % 7 == 1, F.concat(F.lit("https://www.youtube.com/watch?v="), vid, F.lit("&list=PL"), i.cast("string")))
           .when(i % 7 == 2, F.concat(F.lit("https://youtu.be/"), vid, F.lit("?t="), (i % 60).cast("string")))
           .when(i % 7 == 3, F.concat(F.lit("https://www.youtube.com/shorts/"), vid))
           .when(i % 7 == 4, F.concat(F.lit("  "), vid, F.lit("  ")))
           .when(i % 7 == 5, F.concat(F.lit("https://m.youtube.com/watch?feature=share&v="), vid, F.lit("#x")))
           .otherwise(F.lit("")))
    return p.select("page_id", raw.alias("url_or_id"))


def landed_pages(spark: SparkSession, sf_dir: str,
                 per_page: int = fv.COMMENTS_PER_PAGE) -> DataFrame:
    """Response pages as landed JSON: ``(video_id, page_no, body)``.

    Page ``p`` of a video holds its comments with ``comment_id`` in
    ``[p*per_page, (p+1)*per_page)``, so no page exceeds ``per_page`` items
    however large a video is.  Every page but a video's last carries a
    ``nextPageToken``; in some videos the last page but one is an error body,
    so all but its rows and those behind it are read; every
    13th comment lacks ``likeCount``.
    """
    c = comments(spark, sf_dir)
    page_no = F.floor(F.col("comment_id") / per_page).cast("long")
    inner = F.struct(
        F.col("date").alias("publishedAt"),
        F.col("comment").alias("textDisplay"),
        F.when(F.col("comment_id") % 13 != 0, F.col("like_count")).alias("likeCount"),
        F.col("author").alias("authorDisplayName"),
    )
    item = F.struct(
        F.col("comment_id").cast("string").alias("id"),
        F.struct(F.struct(inner.alias("snippet")).alias("topLevelComment")).alias("snippet"),
    )
    pages = (c.select("video_id", page_no.alias("page_no"), F.col("comment_id"), item.alias("item"))
             .groupBy("video_id", "page_no")
             .agg(F.array_sort(F.collect_list(F.struct("comment_id", "item"))).alias("its")))
    # ``doc_id`` is dense, so page numbers run 0, 1, 2, ... per video (the
    # fetch order the ingest operators expect).  Last page per video: a
    # per-video aggregate over page rows.
    last = pages.groupBy("video_id").agg(F.max("page_no").alias("last_page"))
    pages = pages.join(last, "video_id")
    is_error = (F.ascii(F.right(F.col("video_id"), F.lit(1))) % 5 == 0) & (F.col("page_no") == F.col("last_page") - 1)
    token = F.when(F.col("page_no") < F.col("last_page"),
                   F.concat(F.lit("tok"), (F.col("page_no") + 1).cast("string")))
    ok_body = F.to_json(F.struct(
        F.transform("its", lambda s: s["item"]).alias("items"),
        token.alias("nextPageToken")))
    err_body = F.to_json(F.struct(F.struct(
        F.concat(F.lit("quota exceeded on page "), F.col("page_no").cast("string")).alias("message")
    ).alias("error")))
    return pages.select("video_id", "page_no",
                        F.when(is_error, err_body).otherwise(ok_body).alias("body"))
