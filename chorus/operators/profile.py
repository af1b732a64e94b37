"""Distribution of token counts (op 28) and mergeable word sketches (ops 24, 31).

All numbers of the distribution come from one table of counts per value, as
long as the longest comment has tokens, so comments are read once and neither
quartiles nor density see them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.functions.text import explode_tokens

# fixed values: the box and density rules of the violin chart
WHISKER_IQRS = 1.5
SILVERMAN, NORMAL_IQR = 1.059, 1.349
SPAN_BANDWIDTHS = 2              # the curve goes on this far beyond the least and the largest value
STEPS_A_BANDWIDTH = 3
LEAST_BANDWIDTH = 0.01           # of the range of values

REACH = 8                        # bandwidths; a Gaussian kernel is under 1e-13 of its height beyond
SKETCH_LG_K = 14                 # 16 KB at most a sketch, relative standard error 0.8 %


def value_counts(df: DataFrame, col: str = "token_count") -> DataFrame:
    """``(value, comments)``, nulls left out."""
    return df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("value")).agg(F.count("*").alias("comments"))


def _quartiles(counts: DataFrame) -> DataFrame:
    v, n = F.col("value"), F.col("comments")
    total, mean = F.sum(n), F.sum(v * n) / F.sum(n)
    square = F.sum(v * v * n) - total * mean * mean
    return counts.agg(
        total.alias("comments"), F.min(v).alias("min"), F.max(v).alias("max"),
        *[F.percentile(v, p, n).alias(f"q{round(100 * p)}") for p in (0.25, 0.5, 0.75)],
        F.when(total > 1, F.sqrt(F.greatest(square, F.lit(0.0)) / (total - 1))).otherwise(0.0).alias("std"))


def box(counts: DataFrame) -> DataFrame:
    """One row: quartiles, the whiskers (the outermost values within 1.5
    interquartile ranges of the box) and the number of comments beyond.
    Without comments the numbers are null and the counts 0."""
    q = _quartiles(counts).withColumn("iqr", F.col("q75") - F.col("q25"))
    low, high = F.col("q25") - WHISKER_IQRS * F.col("iqr"), F.col("q75") + WHISKER_IQRS * F.col("iqr")
    rows = counts.crossJoin(F.broadcast(q.select(low.alias("_low"), high.alias("_high"))))      # one row
    v, inside = F.col("value"), F.col("value").between(F.col("_low"), F.col("_high"))
    ends = rows.agg(F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
                    F.coalesce(F.sum(F.when(~inside, F.col("comments"))), F.lit(0)).alias("outliers"))
    return q.withColumn("comments", F.coalesce("comments", F.lit(0))).drop("std").crossJoin(ends)


def outliers(df: DataFrame, counts: DataFrame, col: str = "token_count", id_col: str = "comment_id") -> DataFrame:
    """The points beyond the whiskers: ``(id, count, side)``.  The whiskers
    arrive as scalars, so the comments are filtered where they are read."""
    b = box(counts)
    low, high = b.select("whisker_low").scalar(), b.select("whisker_high").scalar()
    side = F.when(F.col(col) < low, "low").when(F.col(col) > high, "high")
    return df.select(id_col, col, side.alias("side")).filter(F.col("side").isNotNull())


def density(counts: DataFrame) -> DataFrame:
    """``(point, x, density)``: Gaussian kernel density on a grid of three
    points a bandwidth, from two bandwidths below the least value to two
    above the largest.

    The bandwidth is Silverman's rule over the smaller of the deviation and
    the scaled interquartile range, at least a hundredth of the range, so the
    grid has 313 points at most whatever the data; it is 1 where all values
    are equal.  Each value is dealt to the grid points within eight
    bandwidths, not to all.  Without comments there are no rows.
    """
    q = _quartiles(counts).filter("comments > 0")
    rule = F.least("std", (F.col("q75") - F.col("q25")) / NORMAL_IQR) * SILVERMAN * F.pow(F.col("comments"), F.lit(-0.2))
    width = F.when(F.col("max") > F.col("min"), F.greatest(rule, (F.col("max") - F.col("min")) * LEAST_BANDWIDTH)).otherwise(1.0)
    b = q.select("comments", "min", "max", width.alias("bw"))
    span = F.col("max") - F.col("min") + 2 * SPAN_BANDWIDTHS * F.col("bw")
    b = b.withColumn("points", F.ceil(span / (F.col("bw") / STEPS_A_BANDWIDTH)).cast("int"))
    b = b.select(F.col("comments").alias("_n"), "bw", "points", (span / F.col("points")).alias("step"),
                 (F.col("min") - SPAN_BANDWIDTHS * F.col("bw")).alias("start"))
    grid = b.select("start", "step", F.explode(F.sequence(F.lit(0), "points")).alias("point"))
    place = lambda v: (v - F.col("start")) / F.col("step")
    reach = REACH * F.col("bw")
    near = F.sequence(F.greatest(F.lit(0), F.ceil(place(F.col("value") - reach)).cast("int")),
                      F.least(F.col("points"), F.floor(place(F.col("value") + reach)).cast("int")))
    dealt = counts.crossJoin(F.broadcast(b)).select("*", F.explode(near).alias("point"))        # one row
    z = (F.col("start") + F.col("point") * F.col("step") - F.col("value")) / F.col("bw")
    height = F.exp(-0.5 * z * z) * F.col("comments") / (F.col("_n") * F.col("bw") * F.sqrt(2 * F.pi()))
    curve = dealt.groupBy("point").agg(F.sum(height).alias("density"))
    return grid.join(curve, "point", "left").select(
        F.col("point").cast("long").alias("point"), (F.col("start") + F.col("point") * F.col("step")).alias("x"),
        F.coalesce("density", F.lit(0.0)).alias("density"))


# ---------------------------------------------------------------- word sketches

def word_sketches(df: DataFrame, by: str = "video_id", text_col: str = "clean_comment", tokens_col: str = "token_clean",
                  lg_k: int = SKETCH_LG_K, chars: Column | None = None) -> DataFrame:
    """``(by, comments, chars, words, sketch)``: what the KPIs need of each
    group, in a form that merges.  New groups are appended and ``merged``
    reads them with the old ones; no comment is read again.  ``sketch`` is a
    HyperLogLog of the group's words (null without words); a group's words
    are merged inside each task first, so a group of any size splits.
    ``chars``: the length of the text, where ``df`` has it and not the text."""
    sizes = df.groupBy(by).agg(F.count("*").alias("comments"), F.sum(F.length(text_col) if chars is None else chars).alias("chars"),
                               F.coalesce(F.sum(F.size(tokens_col)), F.lit(0)).cast("long").alias("words"))
    words = explode_tokens(df, [by], F.col(tokens_col), "_word")
    seen = words.groupBy(F.col(by).alias("_by")).agg(F.hll_sketch_agg("_word", lg_k).alias("sketch"))
    return sizes.join(seen, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def merged(sketches: DataFrame, by: str | None = None) -> DataFrame:
    """KPIs off ``word_sketches``, for all groups together or per ``by``:
    comments, mean length (1 decimal), words and about how many different
    ones."""
    groups = sketches.groupBy(by) if by else sketches.groupBy()
    out = groups.agg(F.coalesce(F.sum("comments"), F.lit(0)).alias("total_comments"),
                     F.round(F.sum("chars") / F.sum("comments"), 1).alias("avg_length"),
                     F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
                     F.hll_union_agg("sketch", F.lit(False)).alias("_sketch"))
    return out.withColumn("unique_words", F.coalesce(F.hll_sketch_estimate("_sketch"), F.lit(0).cast("long"))).drop("_sketch")
