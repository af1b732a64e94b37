"""Tokens and word frequency (ops 24-33).

Token lists are built inside each row with built-in array functions:
regex extraction, a lemma lookup (small irregular-form table behind an
``INSET`` pre-check, then suffix rules) and a stop-word ``INSET`` filter.
No explode and no shuffle is needed to make them; order and repeats are
kept.  Counting words explodes and aggregates with map-side partial
aggregation, so frequent words do not concentrate rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.data import fixed_values as fv
from chorus.functions.bloom import BloomFilter
from chorus.functions.text import explode_tokens, lemma_of, simple_tokens, word_tokens


def general_stopwords() -> list[str]:
    """The general English stop list (Spark ML's 181 words, a fixed list)."""
    return list(fv.ENGLISH_STOPWORDS)


def add_simple_tokens(df: DataFrame, text_col: str = "clean_comment", out: str = "tokens") -> DataFrame:
    """Op 25: lower-case, accent-folded alphabetic tokens of 2-15 letters."""
    return df.withColumn(out, simple_tokens(text_col))


def add_lemma_tokens(df: DataFrame, text_col: str = "clean_comment", out: str = "token_clean",
                     stopwords: list[str] | None = None, min_len: int = 3) -> DataFrame:
    """Op 26: lemmas of the word tokens that are not stop words (tested on
    the surface form) and whose lemma has at least ``min_len`` characters.
    Digits are kept."""
    stops = general_stopwords() if stopwords is None else stopwords
    kept = F.filter(word_tokens(text_col), lambda t: ~t.isin(*stops))
    lem = F.transform(kept, lemma_of)
    return df.withColumn(out, F.filter(lem, lambda t: F.length(t) >= min_len))


def kept_words(text_col: str = "clean_comment", stopwords: list[str] | None = None) -> Column:
    """Word tokens that are not stop words, before lemmas."""
    stops = general_stopwords() if stopwords is None else stopwords
    return F.filter(word_tokens(text_col), lambda t: ~t.isin(*stops))


def add_lemma_tokens_from_table(df: DataFrame, lemmas: DataFrame, text_col: str = "clean_comment", out: str = "token_clean",
                                stopwords: list[str] | None = None, min_len: int = 3, id_col: str = "comment_id") -> DataFrame:
    """Op 26 with a table ``(form, lemma)`` of any size, one row per form;
    forms it lacks take the built-in rules.

    Only words that the table may hold, told by a Bloom filter inside the
    row, move to meet it, with their place and without text; lemmas come
    back to their places by one aggregate per comment.  ``lemmas`` is read
    twice: store it.
    """
    words = df.select(id_col, kept_words(text_col, stopwords).alias("_w"))
    forms = words.select(id_col, F.posexplode_outer("_w").alias("_i", "form")).filter(F.col("form").isNotNull())
    forms = forms.filter(BloomFilter.of(lemmas, "form").may_hold("form"))
    found = forms.join(lemmas.select("form", F.col("lemma").alias("_l")), "form")
    mine = found.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_l"))).alias("_m"))
    both = df.join(words, id_col).join(mine, id_col, "left").withColumn("_m", F.coalesce("_m", F.map_from_entries(
        F.array().cast("array<struct<k:int,v:string>>"))))
    lemma = F.transform("_w", lambda t, i: F.coalesce(F.try_element_at(F.col("_m"), i), lemma_of(t)))
    return both.withColumn(out, F.filter(lemma, lambda t: F.length(t) >= min_len)).drop("_w", "_m")


def add_token_count(df: DataFrame, col: str = "token_clean", out: str = "token_count") -> DataFrame:
    """Op 27."""
    return df.withColumn(out, F.size(col).cast("long"))


def lemmatize_comments(df: DataFrame, text_col: str = "clean_comment") -> DataFrame:
    """Ops 25-27 together: ``tokens``, ``token_clean``, ``token_count``."""
    return add_token_count(add_lemma_tokens(add_simple_tokens(df, text_col), text_col))


def token_count_profile(df: DataFrame, col: str = "token_count") -> DataFrame:
    """Op 28: count, mean, sample std, min, quartiles (linear
    interpolation), max.  The exact percentile keeps one counter per
    distinct token count, which is bounded by the longest comment."""
    c = F.col(col)
    return df.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"),
        F.percentile(c, 0.25).alias("q25"), F.percentile(c, 0.5).alias("q50"),
        F.percentile(c, 0.75).alias("q75"), F.max(c).cast("double").alias("max"))


def token_count_shape(df: DataFrame, col: str = "token_count") -> DataFrame:
    """Op 28 (violin data): number of comments per token count."""
    return df.groupBy(col).agg(F.count("*").alias("comments"))


def short_comments(df: DataFrame, col: str = "token_count", max_tokens: int = 3) -> DataFrame:
    """Op 29."""
    return df.filter(F.col(col) <= max_tokens)


def word_counts(df: DataFrame, col: str = "token_clean") -> DataFrame:
    """Op 30: ``(word, count)`` over all token lists, in no order."""
    words = explode_tokens(df, [], F.col(col), "word")
    return words.groupBy("word").agg(F.count("*").alias("count"))


def unique_words(df: DataFrame, col: str = "token_clean", approximate: bool = False) -> DataFrame:
    """Op 31."""
    words = explode_tokens(df, [], F.col(col), "word")
    agg = F.approx_count_distinct("word") if approximate else F.count_distinct("word")
    return words.agg(agg.alias("unique_words"))


def top_words(counts: DataFrame, n: int = fv.TREEMAP_WORDS) -> DataFrame:
    """Op 32: top ``n`` words (ties by word) and their share of the shown
    total; the share window runs over the ``n`` rows after the limit."""
    top = counts.orderBy(F.col("count").desc(), F.col("word")).limit(n)
    return top.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def word_weights(counts: DataFrame, n: int = fv.WORD_CLOUD_MAX_WORDS) -> DataFrame:
    """Op 33: word-cloud weights, frequency relative to the most frequent
    word, at most ``n`` words."""
    top = counts.orderBy(F.col("count").desc(), F.col("word")).limit(n)
    return top.withColumn("weight", F.col("count") / F.max("count").over(Window.partitionBy()))


def kpis(df: DataFrame, text_col: str = "clean_comment", tokens_col: str = "token_clean", chars: Column | None = None) -> DataFrame:
    """Op 24: total comments, mean cleaned length (1 decimal), distinct
    words.  Two aggregates read as scalar subqueries, no join.  ``chars``:
    the length of the cleaned text, where ``df`` has it and not the text."""
    words = explode_tokens(df, [], F.col(tokens_col), "w").select(F.count_distinct("w")).scalar()
    return df.agg(F.count("*").alias("total_comments"),
                  F.round(F.avg(F.length(text_col) if chars is None else chars), 1).alias("avg_length")).select(
        "total_comments", "avg_length", words.alias("unique_words"))
