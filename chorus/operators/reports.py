"""Sentiment results and reports (ops 18-24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.data import fixed_values as fv
from chorus.operators import classify as CL
from chorus.operators import lexicon as LX

MODELS = ("lexicon", "binary", "ternary")


def sentiment_results(prepared: DataFrame, labels: DataFrame,
                      lexicon: DataFrame | None = None, id_col: str = "comment_id") -> DataFrame:
    """Op 18: one row per comment with all three labels and scores.

    The lexicon and the two classifiers, which share one pass over the
    tokens, each yield a small keyed table (id + partial sums, text-free);
    the comments are joined to both on ``comment_id``, so the text rows move
    once whatever the number of models.
    """
    return _scored(prepared, prepared, labels, lexicon, id_col)


def sentiment_scores(prepared: DataFrame, labels: DataFrame,
                     lexicon: DataFrame | None = None, id_col: str = "comment_id") -> DataFrame:
    """Op 18 without the comments: their ids with all three labels and
    scores, a hundred bytes each, for results that take the texts from
    elsewhere."""
    return _scored(prepared.select(id_col), prepared, labels, lexicon, id_col)


def _scored(rows: DataFrame, prepared: DataFrame, labels: DataFrame, lexicon: DataFrame | None, id_col: str) -> DataFrame:
    key = prepared.select(id_col, "clean_comment")
    lx = LX.lexicon_sums(key, lexicon, id_col=id_col)
    models = CL.fit_schemes(prepared, labels, ("binary", "ternary"), id_col=id_col)
    out = rows.join(lx, id_col, "left").join(CL.scheme_sums(key, models, id_col=id_col), id_col, "left")
    out = LX.finish_lexicon(out)
    for s, m in models.items():
        out = CL.finish_naive_bayes(out, m, s)
    return out


def label_long(results: DataFrame, models=MODELS, id_col: str = "comment_id") -> DataFrame:
    """``(comment_id, model, sentiment_label)`` -- one row per comment and model."""
    wide = results.select(id_col, *[F.col(f"{m}_label").alias(m) for m in models])
    return wide.unpivot([id_col], list(models), "model", "sentiment_label")


def label_distribution(results: DataFrame, models=MODELS) -> DataFrame:
    """Op 19: ``(model, sentiment_label, comment_count, share)``; the share
    window runs over the aggregated rows (models x labels), never raw rows."""
    counts = (label_long(results, models).filter(F.col("sentiment_label").isNotNull())
              .groupBy("model", "sentiment_label").agg(F.count("*").alias("comment_count")))
    w = Window.partitionBy("model")
    return counts.withColumn("share", F.col("comment_count") / F.sum("comment_count").over(w))


def model_comparison(results: DataFrame, models=MODELS) -> DataFrame:
    """Op 20: one row per label used by any model, one count column per
    model (``<model>_count``), missing -> 0; null labels excluded."""
    long = label_long(results, models).filter(F.col("sentiment_label").isNotNull())
    wide = long.groupBy("sentiment_label").pivot("model", list(models)).count().na.fill(0)
    return wide.select("sentiment_label", *[F.col(m).cast("long").alias(f"{m}_count") for m in models]) \
        .orderBy("sentiment_label")


def model_comparison_long(wide: DataFrame, models=MODELS) -> DataFrame:
    """Op 21: melt the wide table to ``(sentiment_label, model, comment_count)``;
    zeros are kept."""
    renamed = wide.select("sentiment_label", *[F.col(f"{m}_count").alias(m) for m in models])
    return renamed.unpivot(["sentiment_label"], list(models), "model", "comment_count")


def top_by_score(results: DataFrame, n: int = fv.TOP_COMMENTS, score_col: str = "lexicon_score",
                 label_col: str = "lexicon_label", id_col: str = "comment_id",
                 cols=("date", "comment")) -> DataFrame:
    """Op 22: the ``n`` highest and ``n`` lowest scored comments, no label
    filter; each side is a TakeOrderedAndProject (top-k per task, then
    merge), ties broken by ``comment_id``."""
    keep = [id_col, *cols, label_col, score_col]
    hi = results.orderBy(F.col(score_col).desc(), F.col(id_col)).limit(n).select(
        F.lit("positive").alias("direction"), *keep)
    lo = results.orderBy(F.col(score_col).asc(), F.col(id_col)).limit(n).select(
        F.lit("negative").alias("direction"), *keep)
    both = hi.unionByName(lo)
    w = Window.partitionBy("direction").orderBy(
        F.when(F.col("direction") == "positive", -F.col(score_col)).otherwise(F.col(score_col)), F.col(id_col))
    return both.withColumn("rank", F.row_number().over(w))


def top_by_label(results: DataFrame, prefix: str, n: int = fv.TOP_COMMENTS,
                 id_col: str = "comment_id", cols=("date", "comment"),
                 labels: tuple[str, ...] | None = None) -> DataFrame:
    """Op 23: per label of one classifier, the ``n`` most confident comments.
    ``row_number() <= n`` is planned with a partial group limit before the
    shuffle, so a label holding most rows is cut per task first."""
    label_col, score_col = f"{prefix}_label", f"{prefix}_score"
    df = results if labels is None else results.filter(F.col(label_col).isin(list(labels)))
    w = Window.partitionBy(label_col).orderBy(F.col(score_col).desc(), F.col(id_col))
    return (df.select(id_col, *cols, label_col, score_col)
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n))
