"""Rule-based lexicon sentiment (ops 13-14).

Plan: per comment, whitespace tokens with outer punctuation stripped;
``arrays_zip`` of the token array and its shifts pairs each token with the
three before it, ``posexplode`` makes rows, an inner join to the ``(token,
valence)`` table (the shipped one is broadcast) keeps only lexicon hits, the
context rules are column expressions on the hit row, and one aggregate per
comment sums.  Context comes from the array before the explode, so with the
shipped table the only shuffle is the (partially aggregated) sum per comment
and the join back.

Rules: caps emphasis, boosters/dampeners at distance 1-3 with decay,
negation (x -0.74, "never so/this" x 1.25, "without doubt" no flip), "but"
(hits before the first "but" x 0.5, after x 1.5, by position), "!" and "?"
emphasis, ``s / sqrt(s^2 + 15)``, rounded to 4.  Idioms and the special
"no"/"least"/"kind of" cases are not modelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.data import lexicon as L
from chorus.functions.text import count_char, is_all_caps, sentiment_label, strip_outer_punct

BROADCAST_LEXICON = 100_000   # entries (some sixty bytes each) of a shipped mapping that may be broadcast


def lexicon_table(spark: SparkSession, mapping: dict[str, float] | None = None) -> DataFrame:
    """A mapping as ``(token, valence)``; its size is known here, so a short
    one carries a broadcast hint.  A lexicon that is a table already is
    passed to the scorer as it is, of any size and without a hint."""
    m = L.SEED_LEXICON if mapping is None else mapping
    schema = T.StructType([T.StructField("token", T.StringType(), False),
                           T.StructField("valence", T.DoubleType(), False)])
    table = spark.createDataFrame([(k.lower(), float(v)) for k, v in sorted(m.items())], schema)
    return F.broadcast(table) if len(m) <= BROADCAST_LEXICON else table


def vader_tokens(text: Column) -> Column:
    toks = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")     # outer space leaves empty ones
    return F.transform(toks, strip_outer_punct)


def _booster(lp: Column) -> Column:
    return (F.when(lp.isin(*L.BOOSTERS), F.lit(L.BOOSTER_INCREMENT))
            .when(lp.isin(*L.DAMPENERS), F.lit(-L.BOOSTER_INCREMENT))
            .otherwise(F.lit(0.0)))


def _negated(lp: Column) -> Column:
    return lp.isin(*L.NEGATIONS) | lp.contains(L.NEGATION_SUFFIX)


def _with_valence(df: DataFrame, cap_diff: str = "_capdiff") -> DataFrame:
    """Apply the distance-1..3 context rules in order, as the method does.

    Word-class tests (booster value, negation, caps) are computed once per
    neighbour as plain columns; each rule step is then its own projection
    over named columns (``_v0`` .. ``_v3``), so no expression repeats
    another one and generated code stays small.
    """
    caps = F.col(cap_diff)
    cols = {}
    for d in (1, 2, 3):
        p = F.col(f"p{d}")
        lp = F.lower(p)
        cols[f"_l{d}"] = lp
        cols[f"_b{d}"] = F.coalesce(_booster(lp), F.lit(0.0))
        cols[f"_n{d}"] = F.coalesce(_negated(lp), F.lit(False))
        cols[f"_c{d}"] = F.coalesce(is_all_caps(p), F.lit(False)) & caps
    out = df.withColumns(cols)
    l1, l2 = F.col("_l1"), F.col("_l2")
    special = {
        2: ((F.col("_l2") == "never") & F.coalesce(l1.isin("so", "this"), F.lit(False)),
            (F.col("_l2") == "without") & F.coalesce(l1 == "doubt", F.lit(False))),
        3: ((F.col("_l3") == "never") & F.coalesce(l2.isin("so", "this") | l1.isin("so", "this"), F.lit(False)),
            (F.col("_l3") == "without") & F.coalesce((l2 == "doubt") | (l1 == "doubt"), F.lit(False))),
    }
    for d in (1, 2, 3):
        v, b, c = F.col(f"_v{d - 1}"), F.col(f"_b{d}"), F.col(f"_c{d}")
        out = out.withColumn("_s", F.when(v < 0, -b).otherwise(b))
        s = F.col("_s")
        s = F.when((s != 0) & c, F.when(v > 0, s + L.CAPS_INCREMENT).otherwise(s - L.CAPS_INCREMENT)).otherwise(s)
        out = out.withColumn("_w", F.when(F.col(f"p{d}").isNull(), v)
                             .otherwise(v + s * F.lit(L.DISTANCE_DECAY[d - 1])))
        w, neg = F.col("_w"), F.col(f"_n{d}")
        if d == 1:
            nxt = F.when(neg, w * L.NEGATION_SCALAR).otherwise(w)
        else:
            never_so, without_doubt = special[d]
            nxt = (F.when(F.coalesce(never_so, F.lit(False)), w * 1.25)
                   .when(F.coalesce(without_doubt, F.lit(False)), w)
                   .when(neg, w * L.NEGATION_SCALAR)
                   .otherwise(w))
        out = out.withColumn(f"_v{d}", nxt)
    return out


def lexicon_sums(df: DataFrame, lexicon: DataFrame | None = None,
                 text_col: str = "clean_comment", id_col: str = "comment_id") -> DataFrame:
    """Keyed partial result ``(<id_col>, _sum, _amp)`` for comments with at
    least one lexicon hit.  A comment without a hit scores 0, so callers can
    left-join this small table instead of re-shuffling the text."""
    spark = df.sparkSession
    lex = lexicon_table(spark) if lexicon is None else lexicon
    lex = lex.select(F.lower("token").alias("_lt"), F.col("valence").cast("double").alias("_val"))

    text = F.col(text_col)
    ep = F.least(count_char(text, "!"), F.lit(L.EXCLAMATION_MAX)) * L.EXCLAMATION_STEP
    qm = count_char(text, "?")
    qa = (F.when((qm > 1) & (qm <= 3), qm * L.QUESTION_STEP)
          .when(qm > 3, F.lit(L.QUESTION_MAX_AMP)).otherwise(F.lit(0.0)))
    base = df.select(F.col(id_col).alias("_id"), vader_tokens(text).alias("_toks"),
                     (ep + qa).alias("_amp"))
    n_caps = F.size(F.filter("_toks", is_all_caps))
    nothing = F.lit(None).cast("string")
    flags = base.select(
        "_id", "_amp",
        ((n_caps > 0) & (n_caps < F.size("_toks"))).alias("_capdiff"),
        (F.array_position(F.transform("_toks", F.lower), "but") - 1).alias("_but"),
        F.col("_toks").alias("tok"),
        *[F.concat(F.array(*[nothing] * d), "_toks").alias(f"p{d}") for d in (1, 2, 3)],
    )
    # Zipped with itself shifted by one, two and three places, the token array
    # gives each token its neighbours before the explode (outer form: no
    # inferred size filter pushed into the scan), so whatever join the lexicon
    # table's size calls for moves four words a row and never an array.
    ctx = flags.select("_id", "_amp", "_capdiff", "_but",
                       F.posexplode_outer(F.arrays_zip("tok", "p1", "p2", "p3")).alias("pos", "_w"))
    ctx = ctx.filter(F.col("_w.tok").isNotNull()).select(
        "_id", "_amp", "_capdiff", "_but", "pos", *[F.col(f"_w.{c}").alias(c) for c in ("tok", "p1", "p2", "p3")])
    hits = ctx.join(lex, F.lower(F.col("tok")) == F.col("_lt")).drop("_lt")
    v0 = F.col("_val")
    hits = hits.withColumn("_v0", F.when(
        is_all_caps(F.col("tok")) & F.col("_capdiff"),
        F.when(v0 > 0, v0 + L.CAPS_INCREMENT).otherwise(v0 - L.CAPS_INCREMENT)).otherwise(v0))
    hits = _with_valence(hits)
    but = (F.when(F.col("_but") < 0, 1.0)
           .when(F.col("pos") < F.col("_but"), L.BUT_BEFORE)
           .when(F.col("pos") > F.col("_but"), L.BUT_AFTER)
           .otherwise(1.0))
    return (hits.groupBy("_id", "_amp").agg(F.sum(F.col("_v3") * but).alias("_sum"))
            .withColumnRenamed("_id", id_col))


def finish_lexicon(df: DataFrame, score_col: str = "lexicon_score",
                   label_col: str = "lexicon_label", title_case: bool = False) -> DataFrame:
    """Turn ``_sum``/``_amp`` (null = no hit) into the compound score and label."""
    out = df.withColumns({"_s": F.coalesce(F.col("_sum"), F.lit(0.0)),
                          "_a": F.coalesce(F.col("_amp"), F.lit(0.0))})
    s, amp = F.col("_s"), F.col("_a")
    out = out.withColumn("_s2", F.when(s > 0, s + amp).when(s < 0, s - amp).otherwise(s))
    s2 = F.col("_s2")
    comp = s2 / F.sqrt(s2 * s2 + L.NORMALIZE_ALPHA)
    out = out.withColumn(score_col, F.round(F.greatest(F.least(comp, F.lit(1.0)), F.lit(-1.0)), 4))
    return (out.drop("_sum", "_amp", "_s", "_a", "_s2")
            .withColumn(label_col, sentiment_label(score_col, title_case)))


def lexicon_scores(df: DataFrame, lexicon: DataFrame | None = None,
                   text_col: str = "clean_comment", id_col: str = "comment_id",
                   score_col: str = "lexicon_score", label_col: str = "lexicon_label",
                   title_case: bool = False) -> DataFrame:
    """Ops 13 + 14: add ``score_col`` (compound in [-1, 1], rounded to 4) and
    ``label_col`` (>= 0.05 positive, <= -0.05 negative, else neutral)."""
    sums = lexicon_sums(df, lexicon, text_col, id_col)
    return finish_lexicon(df.join(sums, id_col, "left"), score_col, label_col, title_case)
