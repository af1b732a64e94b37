"""Trained text classifiers (ops 15-17).

The transformer pipelines of the analysed application cannot run offline,
so the classifier is re-aimed as a Spark scoring job: a multinomial naive
Bayes model trained from aggregates only (counts per class and term, class
priors, Laplace smoothing) and applied with a count in the row -> join -> sum
per comment -> softmax plan, in which a comment's distinct terms move and not
its tokens.  Whole texts are trained on and scored: the input
limit of the transformer pipelines is theirs, a sum over tokens has none.

* binary:  positive / negative
* ternary: positive / neutral / negative

The summed log-likelihood is divided by the number of scored tokens before
the softmax, so long comments do not saturate at probability 1.  Unseen
terms are ignored; a comment with no known term gets the priors.  Ties go
to the alphabetically first class.  Score = probability of the winning
class.

The weights table grows with the training vocabulary, so no broadcast hint
is given: AQE broadcasts it when its measured size is under the threshold
and keeps a shuffle join otherwise, in which hot terms are salted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.functions.arrays import exploded_counts
from chorus.functions.text import model_tokens
from chorus.operators.hot import frequent_join, salted_join
from chorus.sources.files import Files

HOT_TERMS = 200_000              # terms whose weights are copied to every task: some 20 MB

CLASSES = {
    "binary": ("negative", "positive"),
    "ternary": ("negative", "neutral", "positive"),
}


@dataclass
class NaiveBayesModel:
    classes: tuple[str, ...]
    weights: DataFrame              # term, uses, lp_<class> ...
    log_prior: dict[str, Column]    # scalar subqueries
    joint_weights: DataFrame        # term, uses, lp_<scheme>_<class> ... of all schemes trained together


def _hits(df: DataFrame, weights: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Each comment's distinct terms, counted in the row, with their weights."""
    counts = exploded_counts(df, [id_col], model_tokens(F.col(text_col)))
    return salted_join(counts, weights, "term", "uses", F.col(id_col))


def naive_bayes_sums(df: DataFrame, model: NaiveBayesModel, prefix: str,
                     text_col: str = "clean_comment", id_col: str = "comment_id") -> DataFrame:
    """Keyed partial result ``(<id_col>, <prefix>_s_<class>..., <prefix>_m)``
    for comments with at least one known term (others get the priors)."""
    return _hits(df, model.weights, text_col, id_col).groupBy(id_col).agg(
        *[F.sum(F.col("n") * F.col(f"lp_{c}")).alias(f"{prefix}_s_{c}") for c in model.classes],
        F.sum("n").alias(f"{prefix}_m"))


def scheme_sums(df: DataFrame, models: dict[str, NaiveBayesModel],
                text_col: str = "clean_comment", id_col: str = "comment_id") -> DataFrame:
    """``naive_bayes_sums`` of schemes that ``fit_schemes`` trained together,
    side by side: one join, one aggregate.  The weights of the ``HOT_TERMS``
    most used terms, which are nearly all of a text, are broadcast and add up
    to a row per comment inside the task; only the others' rows are shuffled.
    ``df`` is read twice: store it."""
    counts = exploded_counts(df, [id_col], model_tokens(F.col(text_col)))
    hits = frequent_join(counts, next(iter(models.values())).joint_weights, "term", "uses", hot_keys=HOT_TERMS)
    return hits.groupBy(id_col).agg(
        *[F.sum(F.col("n") * F.col(f"lp_{s}_{c}")).alias(f"{s}_s_{c}") for s, m in models.items() for c in m.classes],
        *[F.sum("n").alias(f"{s}_m") for s in models])


def finish_naive_bayes(df: DataFrame, model: NaiveBayesModel, prefix: str) -> DataFrame:
    """Softmax over classes from the (possibly null) keyed sums."""
    classes = model.classes
    m = F.col(f"{prefix}_m")
    out = df.withColumns({
        f"_z_{c}": model.log_prior[c] + F.coalesce(F.col(f"{prefix}_s_{c}") / m, F.lit(0.0))
        for c in classes})
    out = out.withColumn("_zmax", F.greatest(*[F.col(f"_z_{c}") for c in classes]))
    out = out.withColumns({f"_e_{c}": F.exp(F.col(f"_z_{c}") - F.col("_zmax")) for c in classes})
    out = out.withColumn("_den", sum((F.col(f"_e_{c}") for c in classes[1:]), F.col(f"_e_{classes[0]}")))
    # argmax, ties to the alphabetically first class
    order = sorted(classes)
    best, best_e = F.lit(order[0]), F.col(f"_e_{order[0]}")
    for c in order[1:]:
        e = F.col(f"_e_{c}")
        best = F.when(e > best_e, F.lit(c)).otherwise(best)
        best_e = F.greatest(e, best_e)
    out = out.withColumns({f"{prefix}_label": best, f"{prefix}_score": best_e / F.col("_den")})
    tmp = [f"{prefix}_s_{c}" for c in classes] + [f"_z_{c}" for c in classes] + \
          [f"_e_{c}" for c in classes] + [f"{prefix}_m", "_zmax", "_den"]
    return out.drop(*tmp)


def naive_bayes_scores(df: DataFrame, model: NaiveBayesModel, prefix: str,
                       text_col: str = "clean_comment", id_col: str = "comment_id") -> DataFrame:
    """Add ``<prefix>_label`` and ``<prefix>_score`` to ``df``."""
    sums = naive_bayes_sums(df, model, prefix, text_col, id_col)
    return finish_naive_bayes(df.join(sums, id_col, "left"), model, prefix)


def _scheme_label(scheme: str):
    if scheme == "binary":
        return F.when(F.col("quality") == 1, "positive").otherwise("negative")
    if scheme == "ternary":
        return (F.when(F.col("toxic") == 1, "negative")
                .when(F.col("quality") == 1, "positive").otherwise("neutral"))
    raise ValueError(scheme)


def fit_schemes(df: DataFrame, labels: DataFrame, schemes=("binary", "ternary"),
                text_col: str = "clean_comment", id_col: str = "comment_id") -> dict[str, NaiveBayesModel]:
    """Train several label schemes on the same labelled texts in one pass:
    terms counted in the row, one aggregate of per-(scheme, class) counts per
    term, written once; each scheme's weights and priors are then read off
    that table.  ``uses`` is a term's number of labelled texts."""
    from chorus.plans.stage import stage_large
    lab = labels.select(F.col("doc_id").alias(id_col), "quality", "toxic")
    train = df.select(id_col, text_col).join(lab, id_col).select(
        text_col, *[_scheme_label(s).alias(f"_y_{s}") for s in schemes])
    toks = exploded_counts(train, [f"_y_{s}" for s in schemes], model_tokens(F.col(text_col)))
    counts = stage_large(toks.groupBy("term").agg(F.count("*").alias("uses"), *[
        F.sum(F.when(F.col(f"_y_{s}") == c, F.col("n")).otherwise(0)).alias(f"n_{s}_{c}")
        for s in schemes for c in CLASSES[s]]), "nb-counts")
    vocab = counts.select(F.count("*").cast("double")).scalar()
    docs = train.agg(*[F.count_if(F.col(f"_y_{s}") == c).cast("double").alias(f"d_{s}_{c}")
                       for s in schemes for c in CLASSES[s]], F.count("*").cast("double").alias("_all"))
    totals = {(s, c): counts.select(F.sum(f"n_{s}_{c}").cast("double")).scalar() for s in schemes for c in CLASSES[s]}
    joint = counts.select("term", "uses", *[
        F.ln((F.col(f"n_{s}_{c}") + 1.0) / (total + vocab)).alias(f"lp_{s}_{c}") for (s, c), total in totals.items()])
    models = {}
    for s in schemes:
        cs = CLASSES[s]
        weights = joint.select("term", "uses", *[F.col(f"lp_{s}_{c}").alias(f"lp_{c}") for c in cs])
        log_prior = {c: docs.select(F.ln(F.col(f"d_{s}_{c}") / F.col("_all"))).scalar() for c in cs}
        models[s] = NaiveBayesModel(cs, weights, log_prior, joint)
    return models


def fit_scheme(df: DataFrame, labels: DataFrame, scheme: str,
               text_col: str = "clean_comment") -> NaiveBayesModel:
    return fit_schemes(df, labels, (scheme,), text_col=text_col)[scheme]


def classifier_scores(df: DataFrame, labels: DataFrame, scheme: str,
                      text_col: str = "clean_comment") -> DataFrame:
    """Ops 15 / 16: train on the labelled rows of ``df``, score every row."""
    return naive_bayes_scores(df, fit_scheme(df, labels, scheme, text_col), scheme, text_col=text_col)


# ---------------------------------------------------------------- op 17: user batch model

def export_model(model: NaiveBayesModel, path: str) -> str:
    """Write the model as parquet (weights + one priors row) to a shared
    folder of any file system that Spark writes to."""
    model.weights.write.mode("overwrite").parquet(f"{path}/weights")
    spark = model.weights.sparkSession
    spark.range(1).select(*[model.log_prior[c].alias(c) for c in model.classes]) \
        .write.mode("overwrite").parquet(f"{path}/priors")
    return path


def ship_model(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Have Spark bring the files of an exported model to every executor's
    own disk (``addFile``: each executor fetches them once, through Spark's
    file systems); the names of the weight and prior files there.  The model
    does not pass through the driver's memory.  Spark's part names are unique,
    so any number of models can be shipped."""
    files = Files(spark, path)
    names = []
    for part in ("weights", "priors"):
        found = sorted(p for p, _, _ in files.files(f"{path}/{part}") if p.endswith(".parquet"))
        for p in found:
            spark.sparkContext.addFile(p)
        names.append([p.rsplit("/", 1)[-1] for p in found])
    return names[0], names[1]


def make_predict_fn(weights: list[str], priors: list[str], classes: tuple[str, ...]):
    """``make_predict_fn`` for ``predict_batch_udf``: opens the shipped model
    once per Python worker and scores batches of token lists (joined by
    spaces) with NumPy.  Same smoothing and tie rule as ``naive_bayes_scores``.

    All workers of an executor read one memory-mapped copy of the model.
    """

    def load():
        import numpy as np
        from pyspark import SparkFiles

        from chorus.functions.mapped_table import MappedTable

        table = MappedTable.of_parquet([SparkFiles.get(w) for w in weights], "term", [f"lp_{c}" for c in classes])
        prior = MappedTable.rows_of([SparkFiles.get(p) for p in priors], list(classes))[0]
        order = np.argsort(np.array(classes))          # alphabetical tie rule
        names = np.array(classes, dtype=object)

        def predict(texts):
            n = len(texts)
            z = np.tile(prior, (n, 1))
            lists = ["" if t is None else t for t in texts]
            place, text = table.find([t.split() for t in lists])
            if place.size:
                uses = np.bincount(text, minlength=n)
                hit = uses > 0
                for c in range(len(classes)):
                    total = np.bincount(text, weights=table.values[place, c], minlength=n)
                    z[hit, c] += total[hit] / uses[hit]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            best = order[np.argmax(p[:, order], axis=1)]
            return {"label": names[best], "score": p[np.arange(n), best]}

        return predict

    return load


def batch_model_scores(df: DataFrame, path: str, classes: tuple[str, ...], prefix: str,
                       text_col: str = "clean_comment", batch_size: int = 32) -> DataFrame:
    """Op 17: score ``text_col`` with an exported model through
    ``predict_batch_udf`` (Arrow batches of ``batch_size`` texts).  Texts are
    split into tokens by Spark; a null text has none and gets the priors."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T
    rt = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
    weights, priors = ship_model(df.sparkSession, path)
    udf = predict_batch_udf(make_predict_fn(weights, priors, tuple(classes)), return_type=rt, batch_size=batch_size)
    out = df.withColumn("_pred", udf(F.coalesce(F.array_join(model_tokens(F.col(text_col)), " "), F.lit(""))))
    return out.withColumns({f"{prefix}_label": F.col("_pred.label"),
                            f"{prefix}_score": F.col("_pred.score")}).drop("_pred")
